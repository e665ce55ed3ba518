"""Address and landmark search for many queries at once, and declarative row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.functions import clean, compare, text
from placescore.session import cut_lineage


def search(queries: DataFrame, sources: Sequence[DataFrame], limit: int = 5) -> DataFrame:
    """Best names per query: every token must occur as a whole word, shortest name first.

    ``queries`` is (query_id, query); each source is (place_id, name[, borough]) and the first source
    with a hit wins. Names are inverted once to (word, place); a query meets only the postings of its
    rarest word and its other words are then tested on the place's own word list, so a common word
    never drags in its whole posting list unless the query has nothing rarer. Queries with the same words
    are answered once, so a query repeated in a third of the rows costs one search.
    """
    asked_by = queries.select("query_id", text.parse_query(F.col("query")).alias("_q")).select(
        "query_id", F.array_sort(F.array_distinct("_q.tokens")).alias("tokens"), "_q.borough"
    ).where(F.size("tokens") > 0).withColumn("_set", F.concat_ws(" ", F.col("tokens"))).withColumn(
        "_in", F.coalesce("borough", F.lit(""))
    )
    parsed = asked_by.groupBy("_set", "_in").agg(F.first("tokens").alias("tokens"), F.first("borough").alias("borough"))
    parsed = parsed.withColumn("query_id", F.struct("_set", "_in")).select("query_id", "tokens", "borough")
    ranked = [
        (source if "borough" in source.columns else source.withColumn("borough", F.lit(None).cast("string"))).select(
            "place_id", "name", "borough", F.lit(rank).alias("source_rank")
        )
        for rank, source in enumerate(sources)
    ]
    # all sources at once; one row per distinct (name, borough): a name repeated in a third of the rows is matched once
    names = cut_lineage(
        reduce(DataFrame.unionByName, ranked)
        .groupBy("source_rank", "name", "borough")
        .agg(F.min("place_id").alias("place_id"))
        .withColumn("_words", clean.words_of(F.col("name")))
    )
    postings = names.withColumn("_w", F.explode("_words"))
    frequency = postings.groupBy("source_rank", "_w").agg(F.count(F.lit(1)).alias("_f"))
    ranks = F.array(*[F.lit(r) for r in range(len(ranked))])
    probe = (
        parsed.select("query_id", F.explode("tokens").alias("_w"))
        .withColumn("source_rank", F.explode(ranks))
        .join(frequency, ["source_rank", "_w"], "left")
        .groupBy("query_id", "source_rank")
        .agg(F.min_by("_w", F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_w").alias("w"))).alias("_w"))
    )
    asked = parsed.withColumnRenamed("borough", "_want").join(probe, "query_id")
    found = (
        asked.join(postings, ["source_rank", "_w"])
        .where(F.size(F.array_except("tokens", "_words")) == 0)
        .where(F.col("_want").isNull() | F.col("borough").isNull() | (F.upper("borough") == F.col("_want")))
        .select("query_id", "source_rank", "place_id", "name")
    )
    # rows of the first source come first, so its rows have the first ranks and the others are told by their source
    w = Window.partitionBy("query_id").orderBy("source_rank", F.length("name"), "name")
    answers = (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
        .withColumn("_first", F.min("source_rank").over(Window.partitionBy("query_id")))
        .where(F.col("source_rank") == F.col("_first"))
        .select("query_id._set", "query_id._in", "source_rank", "place_id", "name", "rank")
    )
    return asked_by.select("query_id", "_set", "_in").join(answers, ["_set", "_in"]).drop("_set", "_in")


def fold_filters(df: DataFrame, filters: Mapping[str, object]) -> tuple[Column, list[str], list[str]]:
    """Filter document to one condition, plus unknown columns and malformed entries.

    Scalar: equality. List: membership, each literal as its own type (empty: ignored). {min, max}: inclusive range; a bound
    that has no order with the column is malformed.
    """
    test, unknown, bad = F.lit(True), [], []
    for name, want in filters.items():
        if name not in df.columns:
            unknown.append(name)
        elif isinstance(want, Mapping):
            bounds = {"gte": want.get("min"), "lte": want.get("max")}
            if not want or set(want) - {"min", "max"} or any(isinstance(x, (list, tuple, dict)) for x in bounds.values()):
                bad.append(name)
                continue
            try:
                for kind, bound in bounds.items():
                    if bound is not None:
                        test = test & compare.ordered(df, name, kind, bound)[0]
            except compare.Incomparable:
                bad.append(name)
        elif isinstance(want, (list, tuple)):
            if want:
                test = test & compare.one_of(df, name, want)[0]
        elif isinstance(want, (str, int, float, bool)):
            test = test & compare.equals(df, name, want)[0]
        else:
            bad.append(name)
    return test, unknown, bad


def query_rows(df: DataFrame, filters: Mapping[str, object], order: Sequence[str], limit: int = 100) -> DataFrame:
    """Matching rows up to ``limit`` in a stated order, each carrying the total counted before the limit.

    Unknown columns are reported in ``unapplied`` and not applied; a malformed entry yields no rows.
    """
    test, unknown, bad = fold_filters(df, filters)
    if bad:
        return df.sparkSession.createDataFrame(
            [(f"unsupported filter for {n}",) for n in bad], "error string"
        )
    kept = df.where(test)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    page = kept.orderBy(*order).limit(limit)
    return page.join(F.broadcast(total), F.lit(True)).withColumn("unapplied", F.lit(",".join(unknown)))
