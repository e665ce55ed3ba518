"""A stated set of vectors against all rows: row files and blocks of askers on shared storage, and work units that pair them.

Rows and askers are written once. A unit is a block of askers and a group of row files; its task reads both, so nothing is
copied per block and only what a task keeps is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import written
from placescore.llm.warc import shared_files
from placescore.session import scratch_path

#: Rows in a file and scored at once, most files that a task takes together, most units.
FILE_ROWS, CHUNK_ROWS, UNIT_FILES, MOST_TASKS = 200_000, 8_192, 64, 20_000
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def usable(vector: Column) -> Column:
    """A vector that is not null or empty and whose components are finite."""
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as whole numbers in doubles; what a double cannot hold stops at its largest."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(vectors * scale))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of every row of ``a`` with every row of ``b``; beyond 64 bits they stop at the ends."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2**53:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole number that a double holds
    left = [[int(x) for x in r] for r in a.tolist()]
    right = [[int(x) for x in r] for r in b.tolist()]
    return np.array([[min(MOST, max(LEAST, sum(x * y for x, y in zip(p, q, strict=True)))) for q in right] for p in left], np.int64).reshape(len(left), len(right))


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of each vector, all components)."""
    return np.asarray(column.value_lengths(), np.int64), np.asarray(column.flatten(), np.float64)


def by_length(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, positions, matrix) for the vectors of each length."""
    n, flat = vectors_of(column)
    first = np.cumsum(n) - n
    for d in np.unique(n).tolist():
        at = np.flatnonzero(n == d)
        yield d, at, whole(flat[first[at][:, None] + np.arange(d)], scale)


def in_blocks(anchors: DataFrame, blocks: int, name: str) -> str:
    """Anchors written as a folder per block, which tasks read."""
    path = scratch_path(anchors.sparkSession, name)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    dealt.repartition(blocks, "block").sortWithinPartitions("block").write.partitionBy("block").parquet(path)
    return path


def block_of(folder: str, block: int) -> pa.Table | None:
    """The askers of a block, None when there are none."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileType

    fs, path = shared_files(folder)
    if fs.get_file_info(f"{path}/block={block}").type == FileType.NotFound:
        return None
    return ds.dataset(f"{path}/block={block}", format="parquet", filesystem=fs).to_table().combine_chunks()


def chunks_of(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of several files, some at a time."""
    import pyarrow.parquet as pq

    for file in files:
        fs, path = shared_files(file)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


def row_files(df: DataFrame, name: str, rows: int) -> DataFrame:
    """The rows written to files of at most so many."""
    folder = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def units(rows: DataFrame, blocks: int) -> DataFrame:
    """(files, block): every block of askers with every group of row files."""
    files = written(rows.select(F.input_file_name().alias("file")).distinct(), "unit-files")
    n = files.count()
    together = min(UNIT_FILES, max(1, n * blocks // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    part = F.pmod(F.xxhash64("file"), F.lit(max(1, n // together)))
    grouped = files.groupBy(part.alias("part")).agg(F.collect_list("file").alias("files"))  # about ``together`` names
    pairs = grouped.select("files", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return pairs.repartition(min(MOST_TASKS, max(1, n // together * blocks)))
