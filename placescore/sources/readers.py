"""Scans: text with late typing, parquet with projection, features, runs, and the source ladder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placescore.functions import clean


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of a delimited file from its first line."""
    return spark.read.option("encoding", encoding).csv(path, header=True, sep=sep, inferSchema=False).columns


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    ignore_errors: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """All-text scan of a delimited file; typing happens later with try_cast, so no inference pass.

    ``multi_line`` is for quoted line breaks only: such a file cannot be split between tasks.
    """
    names = header_of(spark, path, sep, encoding)
    reader = (
        spark.read.schema(text_schema(names))
        .option("encoding", encoding)
        .option("mode", "DROPMALFORMED" if ignore_errors else "PERMISSIVE")
    )
    df = reader.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multi_line)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_csv_na(spark: SparkSession, path: str) -> DataFrame:
    """CSV with NA tokens as NULL; UTF-8 with or without mark, else Latin-1.

    UTF-8 decoding never fails in the reader, it leaves replacement characters, so their presence
    decides for Latin-1. The check stops at the first hit.
    """
    df = read_csv(spark, path)
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit("�")), F.lit(False))
    if not df.where(bad).limit(1).isEmpty():
        df = read_csv(spark, path, encoding="ISO-8859-1")
    names = [c.lstrip("﻿") for c in df.columns]
    return df.select(*[clean.blank_na(F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, names, strict=True)])


def count_strict(spark: SparkSession, path: str) -> int:
    """Rows of a file that must parse throughout."""
    names = header_of(spark, path)
    df = spark.read.schema(text_schema(names)).option("mode", "FAILFAST").option("enforceSchema", False).csv(path, header=True)
    # the hash reads every column, so the parser cannot skip fields that a bare count would prune away
    digest = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    return df.agg(F.count(F.lit(1)), digest).first()[0]


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_acs(spark: SparkSession, path: str, counties: Sequence[str], estimate: str, moe: str) -> DataFrame:
    """Pipe-delimited estimates to (fips, estimate, moe) for tracts of the given county prefixes."""
    df = read_csv(spark, path, sep="|")
    fips = F.substring_index("GEO_ID", "US", -1)
    wanted = F.lit(False)
    for c in counties:
        wanted = wanted | fips.startswith(c)
    return df.where(wanted).select(
        fips.alias("fips"), clean.to_float(F.col(estimate)).alias("estimate"), clean.to_float(F.col(moe)).alias("moe")
    )


_POINT = "array<double>"


def read_features(spark: SparkSession, path: str, properties: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per feature: properties by their first present name variant, shape as nested vertices."""
    variants = sorted({v for names in properties.values() for v in names})
    props = T.StructType([T.StructField(v, T.StringType()) for v in variants])
    schema = T.StructType(
        [
            T.StructField(
                "features",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("properties", props),
                            T.StructField(
                                "geometry",
                                T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
                            ),
                        ]
                    )
                ),
            )
        ]
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    poly = F.from_json("f.geometry.coordinates", f"array<array<{_POINT}>>")
    multi = F.from_json("f.geometry.coordinates", f"array<array<array<{_POINT}>>>")
    nested = F.when(F.col("f.geometry.type") == "Polygon", F.array(poly)).otherwise(multi)
    shape = F.transform(
        nested, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    )
    columns = [F.coalesce(*[F.col(f"f.properties.`{v}`") for v in names]).alias(n) for n, names in properties.items()]
    return rows.select(*columns, shape.alias("shape"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of responses as (case_id, response JSON); a bare row counts as its own response."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    case = F.get_json_object("value", "$.case_id")
    inner = F.get_json_object("value", "$.response")
    return raw.select(case.alias("case_id"), F.coalesce(inner, F.col("value")).alias("response"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def resolve_source(spark: SparkSession, ladder: Sequence[tuple[str, str]]) -> tuple[str, DataFrame] | None:
    """First readable rung of (kind, path): ready and processed are parquet, raw is CSV."""
    for kind, path in ladder:
        if not path_exists(spark, path):
            continue
        try:
            return kind, read_csv(spark, path) if kind == "raw" else read_table(spark, path)
        except AnalysisException:
            continue
    return None


def dataset_coverage(spark: SparkSession, required: Sequence[str], available: Sequence[str]) -> DataFrame:
    """Required names with whether each is available; every name is one or the other."""
    need = spark.createDataFrame([(n,) for n in required], "dataset string")
    have = spark.createDataFrame([(n, True) for n in available], "dataset string, available boolean")
    return need.join(have, "dataset", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Late typing: failures become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


