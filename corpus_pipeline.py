"""From raw documents to packed training sequences: five stages, each written before the next reads it.

Every stage takes (spark, docs, sf_dir). The first four return the columns of documents; the last returns packed pieces. Columns beyond doc_id,
text, lang and source pass through. Rows are told apart by id and text, so null or repeated ids do not lose documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.llm import exact_dedup, jaccard, language, packing, pii
from placescore.llm.common import written


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but for those with an id and text hash among ``rows`` (_id, _key)."""
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(rows, (own == rows["_key"]) & docs["doc_id"].eqNullSafe(rows["_id"]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is not established; null and empty texts are judged by declaration and source."""
    judged = language.identify(docs).where("NOT accepted").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return without(docs, judged)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the row with the largest id stays, once."""
    row_of = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)
    kept = exact_dedup.exact_groups(docs).where("kept").select(row_of(F.col("text_sha256")).alias("_row")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), row_of(F.sha2(exact_dedup.fold_case(F.col("text")), 256)).alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 over five-word shingles the one with the smallest id stays. A null id stays unless a linked document has an id."""
    found = jaccard.similar(docs, k=5, percent=80)
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return without(docs, dropped)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace e-mail and internet addresses, card and phone numbers by their kind; n_chars follows the text."""
    cleaned = pii.redact(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else cleaned


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as possible."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]
#: Trained language and span models have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
