"""Exact duplicates through an extendible-hash index kept on shared files.

Every text gets a 64-bit key. Equal keys are first aggregated map-side, so a text held by a third of the rows is one index
entry. The directory starts with one bucket and doubles while a bucket is overfull; the leading bits of the key choose the
bucket. Index entries are written to the shared folder by bucket, each task owning whole key ranges. Entries with equal
keys form a chain; members of a chain entry are compared byte by byte with its representative, and a row that differs
starts a chain entry of its own. DataFrame operations only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import query, table, written

#: Rows compared with one copy of a representative; larger groups get several copies.
ROWS_PER_COPY = 2_000
ENTRY = ["_h", "_n", "_sha"]


def fold_case(text: Column) -> Column:
    """Null as empty; A-Z lowered, every other character kept."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def directory(counts: dict[int, int], capacity: int, max_bits: int) -> list[tuple[int, int, int]]:
    """Split overfull buckets by directory doubling.

    ``counts`` holds entries per ``max_bits``-bit prefix, so both it and the result have at most ``2**max_bits`` rows.
    Returns (prefix of max_bits bits, bucket number, local depth).
    """
    sums = [dict() for _ in range(max_bits + 1)]
    for prefix, n in counts.items():
        for depth in range(max_bits + 1):
            key = prefix >> (max_bits - depth)
            sums[depth][key] = sums[depth].get(key, 0) + n
    leaves, open_buckets = [], [(0, 0)]
    while open_buckets:
        depth, key = open_buckets.pop()
        if depth < max_bits and sums[depth].get(key, 0) > capacity:
            open_buckets += [(depth + 1, 2 * key + 1), (depth + 1, 2 * key)]
        else:
            leaves.append((depth, key))
    rows = []
    for bucket, (depth, key) in enumerate(leaves):
        first = key << (max_bits - depth)
        rows += [(first + i, bucket, depth) for i in range(1 << (max_bits - depth))]
    return rows


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 200_000, max_bits: int = 12) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lowering A-Z; null counts as empty. Of equal texts the row with the largest id
    stays. A null id is smaller than any other; in a group of null ids only, keep_id is null and the rows are kept. A row
    repeated with the same id counts in group_size, and each repetition has the same kept. An empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    norm = fold_case(F.col("_text"))
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).select(
        "_id", norm.alias("_text"), F.xxhash64(norm).alias("_h"), F.octet_length(norm).alias("_n"), F.sha2(norm, 256).alias("_sha")
    )
    entries = keyed.groupBy(*ENTRY).agg(F.count("*").alias("_rows"), F.max("_id").alias("_keep"))
    entries = written(entries.withColumn("_prefix", F.shiftrightunsigned("_h", 64 - max_bits).cast("int")), "dedup-entries")

    counts = {r["_prefix"]: r["n"] for r in entries.groupBy("_prefix").agg(F.count("*").alias("n")).collect()}  # 2**max_bits rows at most
    pages = spark.createDataFrame(directory(counts, capacity, max_bits), "_prefix int, bucket int, depth int")
    index = entries.join(F.broadcast(pages), "_prefix")
    index = written(index.repartition("bucket").sortWithinPartitions("bucket", *ENTRY), "dedup-index")

    repeated = index.where("_rows > 1").select(*ENTRY, "_rows", "_keep")
    members = written(keyed.join(repeated, ENTRY), "dedup-members")
    copies = F.ceil(F.col("_rows") / ROWS_PER_COPY).cast("int")
    dealt = members.withColumn("_copy", F.pmod(F.xxhash64("_id"), copies).cast("int"))
    heads = members.where(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy(*ENTRY, "_rows").agg(F.first("_text").alias("_head"))
    heads = heads.select(*ENTRY, "_head", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"))
    compared = dealt.join(heads, [*ENTRY, "_copy"]).withColumn("_chain", F.when(F.col("_text") == F.col("_head"), F.lit("")).otherwise(F.col("_text")))
    compared = written(compared.select("_id", *ENTRY, "_rows", "_chain", "_copy"), "dedup-compared")

    links = compared.groupBy(*ENTRY, "_rows", "_chain").agg(F.count("*").alias("group_size"), F.max("_id").alias("keep_id"))
    links = links.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_rows")
    grouped = compared.join(links, [*ENTRY, "_chain", "_copy"])
    single = index.where("_rows = 1").select(F.col("_keep").alias("_id"), "_sha", F.lit(1).cast("bigint").alias("group_size"), F.col("_keep").alias("keep_id"))
    rows = grouped.select("_id", "_sha", "group_size", "keep_id").unionByName(single)
    return rows.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@query("op3_exact_dedup", SQL)
def op3(spark, sf):
    return exact_groups(table(spark, sf, "documents"))
