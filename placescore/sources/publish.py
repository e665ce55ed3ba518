"""Atomic publication, compaction, fingerprints and manifest-gated reads."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.sources.readers import path_exists

ROW_GROUP_ROWS = 250_000
SCHEMA_VERSION = "1.0"


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Rename the staged folder into place; the old one is moved aside first and dropped afterwards."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    backup = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, backup):
        raise RuntimeError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(backup, target)
        raise RuntimeError(f"could not publish {path}")
    if had:
        fs.delete(backup, True)


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Write beside the target (zstd, 250 000-row groups), check what was written, then swap."""
    spark = df.sparkSession
    staged = f"{path}.part-{uuid.uuid4().hex}"
    (
        df.write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .option("parquet.block.row.count.limit", str(ROW_GROUP_ROWS))
        .parquet(staged)
    )
    if check is not None:
        check(spark.read.parquet(staged))
    _swap(spark, staged, path)


def cluster_layout(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition by the first key and sort inside, so row-group statistics prune on it."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def compact(spark: SparkSession, path: str, keys: Sequence[str], partitions: int | None = None) -> None:
    """Rewrite a table in clustered layout; row count and schema must survive."""
    before = spark.read.parquet(path)
    rows, schema = before.count(), before.schema

    def same(after: DataFrame) -> None:
        if after.count() != rows or after.schema != schema:
            raise RuntimeError(f"compaction of {path} would change it")

    publish(cluster_layout(before, keys, partitions), path, same)


def rebuild(df: DataFrame, path: str, gate: Callable[[DataFrame], DataFrame]) -> None:
    """Publish only when the gate aggregates of the written rows are all zero."""

    def check(written: DataFrame) -> None:
        row = gate(written).first().asDict()
        bad = {k: v for k, v in row.items() if v}
        if bad:
            raise RuntimeError(f"gate refused {path}: {bad}")

    publish(df, path, check)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON records, one per line; missing values are written as null."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def geojson_lines(df: DataFrame, lon: str, lat: str, properties: Sequence[str]) -> DataFrame:
    """One feature per row with typed properties."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_geojsonl(df: DataFrame, path: str, lon: str, lat: str, properties: Sequence[str]) -> None:
    geojson_lines(df, lon, lat, properties).write.mode("errorifexists").text(path)


#: Files from this size on are hashed as a stream: a row cannot hold them whole.
STREAMED_BYTES, READ_BYTES = 1 << 30, 1 << 24


def fingerprint(spark: SparkSession, path: str, streamed_bytes: int = STREAMED_BYTES) -> DataFrame:
    """(path, sha256, size_bytes) per file below a path, hashed on the executors.

    Smaller files are read as rows. Of larger ones only path and length are, and a task hashes each in pieces, whatever its size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") < streamed_bytes).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    large = files.where(F.col("length") >= streamed_bytes).select("path", F.col("length").alias("size_bytes"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for name in b.column("path").to_pylist():
                store, inside = pyarrow.fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                digest = hashlib.sha256()
                with store.open_input_stream(inside, compression=None) as f:
                    while piece := f.read(READ_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(digests, pa.string()), b.column("size_bytes")], names=["path", "sha256", "size_bytes"])

    return small.unionByName(large.mapInArrow(stream, "path string, sha256 string, size_bytes bigint"))


def folded(digests: DataFrame, digest: str = "sha256") -> DataFrame:
    """One digest of a multiset of digests, whatever their order: four sums of 60 bits of each, added up pairwise by the tasks.

    A digest that occurs twice counts twice, so a doubled file changes the result.
    """
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_{i}") for i in range(4)]
    sums = digests.agg(F.count(F.lit(1)).alias("_n"), *lanes)
    return sums.select(F.sha2(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in sums.columns]), 256).alias(digest))


def table_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row for a whole table folder: an order-free digest of the files' hashes, and the total size."""
    f = fingerprint(spark, path).where(F.col("path").rlike(r"\.parquet$|\.csv$|\.json$|\.txt$"))
    return folded(f).join(f.agg(F.sum("size_bytes").alias("size_bytes")), F.lit(True))


def make_manifest(spark: SparkSession, path: str, methodology: str) -> DataFrame:
    df = spark.read.parquet(path)
    return table_fingerprint(spark, path).join(df.agg(F.count(F.lit(1)).alias("row_count")), F.lit(True)).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(methodology).alias("methodology_version"),
        F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("file"),
        "sha256",
        "size_bytes",
        "row_count",
        F.lit(",".join(df.columns)).alias("columns"),
    )


def read_published(spark: SparkSession, path: str, manifest: DataFrame | None, methodology: str) -> DataFrame | None:
    """The table when everything the manifest declares holds, otherwise None; without a manifest existence is enough."""
    if not path_exists(spark, path):
        return None
    table = spark.read.parquet(path)
    if manifest is None:
        return table
    actual = make_manifest(spark, path, methodology)
    same = manifest.join(actual, list(actual.columns), "left_semi").where(F.col("row_count") > 0)
    return None if same.isEmpty() else table


def stamp_inputs(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(name, sha256, size_bytes) per registered input."""
    parts = [table_fingerprint(spark, p).withColumn("name", F.lit(n)) for n, p in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stamp_difference(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Inputs that are new, gone or changed."""
    a = stored.select("name", F.struct("sha256", "size_bytes").alias("a"))
    b = now.select("name", F.struct("sha256", "size_bytes").alias("b"))
    j = a.join(b, "name", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(
        "name", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("changed").alias("change")
    )


def validate_snapshot(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared (file, sha256, size_bytes) rows that the files on disk do not meet."""
    name = F.substring_index("path", "/", -1)
    have = actual.select(name.alias("file"), F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    j = declared.join(have, "file", "left")
    ok = F.coalesce((F.col("sha256") == F.col("_sha")) & (F.col("size_bytes") == F.col("_size")), F.lit(False))
    return j.where(~ok).select("file")
