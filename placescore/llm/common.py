"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from placescore.session import scratch_path

#: Documents turned into Python texts at once.
ROWS_AT_ONCE = 1_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is tested against a brute-force version."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: later steps neither recompute nor lose rows with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in order, at most ROWS_AT_ONCE at a time, so the Python texts of a whole Arrow batch are never held together."""
    for b in batches:
        for begin in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(begin, ROWS_AT_ONCE)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed): texts compressed before they are shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for b in few_rows(batches):
            small = pa.array([press.compress(t.encode("utf-8", "replace")) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), small], names=["doc_id", "key", "packed"])

    return docs.select("doc_id", "key", "text").mapInArrow(pack, "doc_id bigint, key bigint, packed binary")
