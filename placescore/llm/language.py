"""Language of documents by fusing evidence: text, declared language, address suffix, and what the host usually publishes.

Text likelihoods come from character trigrams counted over all documents with a declared language. The host's prior is
smoothed towards its parent domain, and that towards the whole corpus; the sums behind priors and behind the reliability of declarations and
suffixes are grouped aggregates of the text's own posterior, with the document itself taken out of its host's sums. A class for text that
fits no language takes what none explains. Every declared language is a class: one with too few trigrams for a likelihood is decided by
declaration and host.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import few_rows, query, table, written
from placescore.llm.url_filters import host_of
from placescore.llm.words import LETTER, char_classes

#: Hash buckets of character trigrams.
BUCKETS = 4096
#: Class of text that fits no language.
UNKNOWN = "und"
#: Letters whose trigrams are counted together: a dozen arrays of 8 bytes each are held for them.
CHARS_AT_ONCE = 250_000
#: What UNKNOWN pays per trigram, so that only text far from every language goes there.
UNKNOWN_COST = 1.0
#: With fewer trigrams a language has no likelihood: one it never showed would cost less than under UNKNOWN, so it would draw in whatever fits no language.
LEAST_TRIGRAMS = math.ceil(BUCKETS * (math.exp(UNKNOWN_COST) - 1) / 2)
#: Languages whose text fits worse by more cannot win: prior, declaration and suffix together move a logarithm by at most 93 (for up to 1e12 rows); the other 42 keep posteriors exact.
REACH = 135.0
#: Declarations count as right in RIGHT of TRIALS cases before any is seen.
RIGHT, TRIALS = 19.0, 20.0


def trigrams(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(position, bucket counts) of each text: one trigram per letter; case does not count, what is no letter is a blank."""
    done = 0
    while done < len(texts):
        part, size = [], 0
        while done + len(part) < len(texts) and (not part or size < CHARS_AT_ONCE):
            part.append(" " + texts[done + len(part)].lower() + " ")
            size += len(part[-1])
        cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = char_classes()[cp] == LETTER
        cp[~letter] = 32
        h = cp[:-2] * np.uint64(0x9E3779B97F4A7C15) + cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + cp[2:] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(31)
        bucket = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64)
        bucket[~letter[1:-1]] = BUCKETS
        at = 0
        for i, text in enumerate(part):
            yield done + i, np.bincount(bucket[at : at + max(0, len(text) - 2)], minlength=BUCKETS)[:BUCKETS]
            at += len(text)
        done += len(part)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(declared, bucket, n) over all documents that declare a language; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows():
            for declared, n in sums.items():
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([declared] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["declared", "bucket", "n"])

        for batch in few_rows(batches):
            declared, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, n in trigrams(texts):
                if declared[i] not in sums and len(sums) >= 512:
                    yield from rows()
                    sums.clear()
                sums[declared[i]] = sums.get(declared[i], 0) + n
        yield from rows()

    labelled = docs.where(F.col("declared").isNotNull()).select("declared", "text")
    return labelled.mapInArrow(count, "declared string, bucket int, n bigint").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages with LEAST_TRIGRAMS and their log-likelihood per trigram bucket, the last class being UNKNOWN.

    The model has BUCKETS numbers per language of that size, however many there are; its counts come to the driver one language at a time.
    """
    counts = written(trigram_counts(docs), "language-trigrams")
    sizes = counts.groupBy("declared").agg(F.sum("n").alias("_size")).where((F.col("_size") >= LEAST_TRIGRAMS) & (F.col("declared") != UNKNOWN))
    rows = counts.join(sizes, "declared").groupBy("declared").agg(F.collect_list(F.struct("bucket", "n")).alias("_n"))
    rows = rows.select("declared", F.col("_n.bucket").alias("bucket"), F.col("_n.n").alias("n"))
    model = {}
    for r in rows.toLocalIterator():
        n = np.full(BUCKETS, 0.5)
        n[r["bucket"]] += r["n"]
        model[r["declared"]] = np.log(n / n.sum()).astype(np.float32)
    known = sorted(model)
    flat = np.full(BUCKETS, -np.log(BUCKETS) - UNKNOWN_COST, np.float32)
    return [*known, UNKNOWN], np.vstack([*[model[x] for x in known], flat])


CLASS = "struct<lang:string,fit:double,p:double>"


def evidence(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """Per document the classes in reach (UNKNOWN always): log-likelihood of its text and the posterior from text alone.

    ``thin`` tells that the declared language has no likelihood, ``read`` that the text has a trigram.
    """
    modelled = set(languages)
    names = np.array(languages, object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(5).to_pylist()]
            kept, fits, shares, ends, best, read = [], [], [], [0], [], []
            for _, n in trigrams(texts):
                seen = np.flatnonzero(n)
                fit = model[:, seen] @ n[seen].astype(np.float64)
                p = np.exp(fit - fit.max())
                p /= p.sum()
                near = fit >= fit.max() - REACH
                near[-1] = True
                kept.extend(names[near])
                fits.append(fit[near])
                shares.append(p[near])
                ends.append(ends[-1] + int(near.sum()))
                best.append(languages[int(fit.argmax())])
                read.append(len(seen) > 0)
            flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.float64())
            classes = pa.StructArray.from_arrays([pa.array(kept, pa.string()), flat(fits), flat(shares)], names=["lang", "fit", "p"])
            classes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), classes)
            thin = [x is not None and x not in modelled for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(best, pa.string()), pa.array(read, pa.bool_()), pa.array(thin, pa.bool_()), classes], names=["doc_id", "text_key", "declared", "suffix", "host", "text_language", "read", "thin", "classes"])

    columns = docs.select("doc_id", "text_key", "declared", "suffix", "host", "text")
    return columns.mapInArrow(score, f"doc_id bigint, text_key bigint, declared string, suffix string, host string, text_language string, read boolean, thin boolean, classes array<{CLASS}>")


def with_thin(rows: DataFrame) -> DataFrame:
    """Add the declared language to the classes where it has no likelihood.

    The text says nothing of it, so it is believed as often as the text bears out declarations that can be tested.
    """
    of_declared = F.aggregate("classes", F.lit(0.0), lambda a, x: a + F.when(x["lang"] == F.col("declared"), x["p"]).otherwise(0.0))
    tested = rows.where("declared IS NOT NULL AND NOT thin AND read").agg(F.sum(of_declared).alias("s"), F.count("*").alias("n")).first()
    right = (RIGHT + (tested["s"] or 0.0)) / (TRIALS + tested["n"])
    top = F.array_max(F.transform("classes", lambda x: x["fit"]))
    others = F.transform("classes", lambda x: F.struct(x["lang"].alias("lang"), x["fit"].alias("fit"), (x["p"] * (1 - right)).alias("p")))
    own = F.struct(F.col("declared").alias("lang"), (top + math.log(right / (1 - right))).alias("fit"), F.lit(right).alias("p"))
    return rows.withColumn("classes", F.when(F.col("thin"), F.concat(others, F.array(own))).otherwise(F.col("classes")))


def sums_by(rows: DataFrame, key: str, world: DataFrame) -> DataFrame:
    """Per key the map language -> (summed posterior s, that of all rows w, thin), and the sum over all languages."""
    exploded = rows.where(F.col(key).isNotNull()).select(key, F.explode("classes").alias("x"))
    sums = exploded.groupBy(key, F.col("x.lang").alias("lang")).agg(F.sum("x.p").alias("s")).join(world, "lang")
    entry = F.struct("lang", F.struct("s", "w", F.col("rare").alias("rare")))
    return sums.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_sums"), F.sum("s").alias("_total"))


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    min_posterior: float = 0.5,
    host_weight: float = 20.0,
) -> DataFrame:
    """doc_id, text_key, language, posterior, text_language, accepted: one row per input row; ``text_key`` is the 64-bit hash of the text.

    ``language`` has the largest fused posterior (ties to the first by name, UNKNOWN last). A document is rejected when that is the class UNKNOWN or
    below ``min_posterior``. Null or empty text gives no evidence, so declaration, suffix and host decide; where these are missing as
    well, the corpus decides. A language of fewer than LEAST_TRIGRAMS is a class for documents that declare it, and for undeclared ones whose
    host or domain publishes it. ``text_language`` is the best of the others. A suffix defaults to the host's last label. Null ids and repeated
    rows are judged like any other. If no row declares a language, all are rejected. An empty table gives an empty result. Columns that are not
    named are not read.
    """
    column = lambda c: F.lower(F.trim(F.col(c).cast("string"))) if c else F.lit(None).cast("string")
    none_if_empty = lambda c: F.when(c != "", c)
    host = none_if_empty(column(host_col))
    suffix = none_if_empty(column(suffix_col)) if suffix_col else F.when(host.contains("."), F.substring_index(host, ".", -1))
    named = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), none_if_empty(column(declared_col)).alias("declared"), suffix.alias("suffix"), host.alias("host"), F.col(text_col).cast("string").alias("text")
    ).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    languages, model = train(named)
    rows = with_thin(written(evidence(named, languages, model), "language-evidence"))
    rows = rows.withColumn("domain", F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)))

    # summed posteriors of the whole table; only the modelled languages come to the driver
    world = rows.select(F.explode("classes").alias("x")).groupBy("x.lang").agg((F.sum("x.p") + 1.0).alias("w"))
    modelled = F.lit(languages)
    world = written(world.withColumn("rare", ~F.array_contains(modelled, F.col("lang"))), "language-world")
    whole = {x: 1.0 for x in languages} | {r["lang"]: r["w"] for r in world.where("NOT rare").collect()}
    size = sum(whole.values()) + (world.where("rare").agg(F.sum("w")).first()[0] or 0.0)
    weights = F.map_from_arrays(modelled, F.lit([whole[x] for x in languages]))

    def joined(out: DataFrame, key: str) -> DataFrame:
        return out.join(sums_by(rows, key, world), key, "left")

    def summed(x: Column) -> Column:
        return F.coalesce(F.col("_sums")[x["lang"]]["s"], F.lit(0.0))

    def given(x: Column, key: str) -> Column:
        """log P(declaration or suffix | language), by the documents whose text speaks for that language."""
        return F.when(F.col(key).isNull(), 0.0).otherwise(F.log((summed(x) + 0.01) / x["w"]))

    def entry(lang: Column, p: Column, w: Column, rare: Column, prior: Column, log: Column) -> Column:
        return F.struct(lang.alias("lang"), p.alias("p"), w.alias("w"), rare.alias("rare"), prior.alias("prior"), log.alias("log"))

    def placed(out: DataFrame, key: str) -> DataFrame:
        """Priors of the key: posterior mean under a Dirichlet prior at the parent, the document itself left out of the sums.

        A rare language keeps the document, which is all that tells of it. An undeclared document gets the rare ones of its key, at what UNKNOWN pays.
        """
        unknown = F.element_at(F.filter("classes", lambda x: x["lang"] == UNKNOWN), 1)["log"]
        more = F.filter(F.map_entries("_sums"), lambda e: e["value"]["rare"] & ~F.exists("classes", lambda x: x["lang"] == e["key"]))
        more = F.transform(more, lambda e: entry(e["key"], F.lit(0.0), e["value"]["w"], F.lit(True), F.lit(0.0), F.col("_unknown")))
        out = joined(out, key).withColumn("_unknown", unknown)
        out = out.withColumn("classes", F.when(F.col("declared").isNull() & F.col("_sums").isNotNull(), F.concat("classes", more)).otherwise(F.col("classes")))
        rest = F.greatest(F.col("_total") - 1.0, F.lit(0.0))

        def share(x: Column) -> Column:
            others = F.greatest(summed(x) - F.when(x["rare"], 0.0).otherwise(x["p"]), F.lit(0.0))
            return F.when(F.col("_sums").isNull(), x["prior"]).otherwise((others + x["prior"] * host_weight) / (rest + host_weight))

        classes = F.transform("classes", lambda x: entry(x["lang"], x["p"], x["w"], x["rare"], share(x), x["log"]))
        return out.withColumn("classes", classes).drop("_sums", "_total", "_unknown")

    out = joined(rows, "declared")

    def weighed(x: Column) -> Column:
        rare = F.col("thin") & (x["lang"] == F.col("declared"))
        w = F.when(rare, F.col("_sums")[x["lang"]]["w"]).otherwise(weights[x["lang"]])
        return entry(x["lang"], x["p"], w, rare, w / size, x["fit"])

    out = out.withColumn("classes", F.transform("classes", weighed))
    out = out.withColumn("classes", F.transform("classes", lambda x: entry(x["lang"], x["p"], x["w"], x["rare"], x["prior"], x["log"] + given(x, "declared")))).drop("_sums", "_total")
    out = joined(placed(placed(out, "domain"), "host"), "suffix")
    final = lambda x: F.struct((x["log"] + F.log(x["prior"] + 1e-12) + given(x, "suffix")).alias("log"), (x["lang"] == UNKNOWN).alias("none"), x["lang"].alias("lang"))
    out = out.withColumn("classes", F.transform("classes", final)).withColumn("_best", F.array_max(F.transform("classes", lambda x: x["log"])))
    first = F.array_min(F.transform(F.filter("classes", lambda x: x["log"] == F.col("_best")), lambda x: F.struct(x["none"].alias("none"), x["lang"].alias("lang"))))
    posterior = F.lit(1.0) / total_of(F.transform("classes", lambda x: F.exp(x["log"] - F.col("_best"))))
    result = out.select("doc_id", "text_key", first["lang"].alias("language"), F.round(posterior, 6).alias("posterior"), "text_language")
    return result.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= min_posterior))


#: What a page shows nobody: comments, scripts, styles and tags. Where each ends once it has begun.
ENDS = {"comment": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "tag": re.compile(">")}
NAMED, TAG = re.compile(r"<(script|style)\b", re.I), re.compile("<[a-z/!?]", re.I)


def shown_text(markup: str) -> str:
    """The text of a page, each piece of markup a blank. It only moves forward: an end that is not found is never sought again."""
    out, at, none = [], 0, set()

    def end_of(kind: str, start: int) -> int:
        if kind in none:
            return -1
        found = ENDS[kind].search(markup, start)
        if found is None:
            none.add(kind)
            return -1
        return found.end()

    begin = markup.find("<")
    while begin >= 0:
        end = -1
        if markup.startswith("<!--", begin):
            end = end_of("comment", begin + 4)
        elif (named := NAMED.match(markup, begin)) is not None:
            end = end_of(named[1].lower(), named.end())
        if end < 0 and TAG.match(markup, begin):
            end = end_of("tag", begin + 2)
        if end >= 0:
            out += [markup[at:begin], " "]
            at = end
        begin = markup.find("<", max(at, begin + 1))
    return "".join([*out, markup[at:]])


def of_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text, lang, host, suffix of (page_id, url, html): shown text, language of the html tag without its region, host and its last label.

    Addresses without a dot in the host and numeric ones have no suffix.
    """

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [None if t is None else html.unescape(shown_text(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["doc_id", "lang", "host", "text"])

    markup = F.col("html").cast("string")
    attributes = F.regexp_extract(markup, r"(?is)<html\b([^>]*+)", 1)  # of the first such tag
    declared = F.regexp_extract(attributes, r"""(?is)\slang\s*+=\s*+["']?([a-z]+)""", 1)
    columns = pages.select(F.col("page_id").cast("bigint").alias("doc_id"), declared.alias("lang"), host_of(F.col("url").cast("string")).alias("host"), markup.alias("html"))
    texts = columns.mapInArrow(shown, "doc_id bigint, lang string, host string, text string")
    last = F.substring_index("host", ".", -1)
    return texts.withColumn("suffix", F.when(F.col("host").contains(".") & ~last.rlike("^[0-9]+$"), last))


@query("op4_language_id")
def op4(spark, sf):
    """The whole pages table; documents, which have no address, are judged in the pipeline."""
    return identify(of_pages(table(spark, sf, "pages")), host_col="host", suffix_col="suffix")
