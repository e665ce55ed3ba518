"""Self-join of documents by the Jaccard similarity of their word shingles, with prefix filters under several token orders.

Documents with equal sets are one node. Under a global order of all tokens, two sets that are similar enough share a token among the first few
of each (the prefix). The first order puts rare tokens first: document frequencies are counted exactly for the tokens whose hash lies below a
bound, which is a little more than a prefix; all other tokens follow by hash. Nodes that share a prefix token are joined by a star per token, not by
pairs, and the connected parts are what is looked at further. Each part is dealt in blocks; two blocks meet in one task, where pairs must also
share prefix tokens under further orders before their overlap is counted. A task returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm import shingles
from placescore.llm.common import packed, query, table, written
from placescore.operators.cluster import connected_components

#: Nodes of a connected part in one block.
BLOCK = 256
#: Document frequencies are told apart up to this one.
MOST = 100_000
#: Seeds of the further token orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEY = ["fp1", "fp2", "n"]


def needed(n, percent: int):
    """Least overlap with any similar set, for a set of ``n``."""
    return (percent * n + 99) // 100


def _columns(sets: shingles.Sets):
    fp1, fp2 = shingles.fingerprints(sets)
    return [pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(np.diff(sets.at), pa.int64())]


def set_keys(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, fp1, fp2, n) per row of ``docs`` (doc_id, text)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, sets in shingles.in_chunks(b.column(2).to_pylist(), k):
                own = [c.slice(first, last - first) for c in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, *_columns(sets)], names=["doc_id", "text_key", *KEY])

    marked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return marked.mapInArrow(keys, "doc_id bigint, text_key bigint, fp1 bigint, fp2 bigint, n bigint")


def set_heads(docs: DataFrame, k: int, percent: int, share: float) -> DataFrame:
    """(doc_id, fp1, fp2, n, head, rest): tokens below the bound, and those after it that a prefix may still need."""
    bound = np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, sets in shingles.in_chunks(b.column(1).to_pylist(), k):
                n = np.diff(sets.at)
                doc = np.repeat(np.arange(len(n)), n)
                low = sets.values < bound
                prefix = n - needed(n, percent) + 1
                rest = ~low & (np.arange(len(doc)) - sets.at[doc] < prefix[doc])
                lists = []
                for mask in (low, rest):
                    at = np.concatenate([[0], np.cumsum(mask)])[sets.at]
                    lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(shingles.ordered_int(sets.values[mask]))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), *_columns(sets), *lists], names=["doc_id", *KEY, "head", "rest"])

    return docs.select("doc_id", "text").mapInArrow(heads, "doc_id bigint, fp1 bigint, fp2 bigint, n bigint, head array<bigint>, rest array<bigint>")


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (token, node) in the order of token those whose token has several, with their number as ``df``.

    Above MOST the number is MOST: the order of tokens stays the same for all, and a token of any size passes as a stream.
    """
    none = np.zeros(0, np.int64)
    token, node = none, none  # the last run, which may go on
    open_run = None  # a token known to have MOST rows
    for b in batches:
        token, node = np.concatenate([token, b.column(0).to_numpy()]), np.concatenate([node, b.column(1).to_numpy()])
        last = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if len(token) - last >= MOST:
            open_run, last = token[-1], len(token)
        yield _with_df(token[:last], node[:last], open_run)
        token, node = token[last:], node[last:]
    yield _with_df(token, node, open_run)


def _with_df(token: np.ndarray, node: np.ndarray, open_run) -> pa.RecordBatch:
    begins = np.flatnonzero(np.diff(token, prepend=token[:1] - 1)) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, len(token)))
    size = np.where(token[begins] == open_run, MOST, np.minimum(size, MOST)) if open_run is not None else np.minimum(size, MOST)
    df = np.repeat(size, np.diff(np.append(begins, len(token))))
    keep = df > 1
    return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep]), pa.array(df[keep], pa.int64())], names=["token", "node", "df"])


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, token): prefix tokens under the order by frequency that some other node holds as well."""
    postings = nodes.select(F.explode("head").alias("token"), "node")
    common = postings.repartition("token").sortWithinPartitions("token").mapInArrow(shared_tokens, "token bigint, node bigint, df bigint")
    by_order = Window.partitionBy("node").orderBy("df", "token")
    ranked = common.withColumn("_rank", F.row_number().over(by_order)).withColumn("_common", F.count("*").over(Window.partitionBy("node")))
    size = nodes.select("node", "n", F.size("head").alias("_head"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    own = ranked.join(size, "node").where(F.col("_head") - F.col("_common") + F.col("_rank") <= F.col("n") - least + 1)
    later = nodes.where(F.size("rest") > 0).select("node", F.explode("rest").alias("token"))
    return own.select("node", "token").unionByName(later)


def compare(a: pd.DataFrame, b: pd.DataFrame | None, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of the nodes of ``a`` (followed by those of ``b``), each counted with the copies it stands for, and a spanning forest.

    With ``b`` only pairs across count, without it all pairs of ``a``.
    """
    rows = a if b is None else pd.concat([a, b], ignore_index=True)
    sets = [np.asarray(t, np.int64).view(np.uint64) for t in rows["tokens"]]
    n = np.array([len(s) for s in sets])
    copies, node = rows["copies"].to_numpy(), rows["node"].to_numpy()
    split = len(a)

    def lists(parts: list[np.ndarray]):
        """Tokens of all nodes numbered, and per token the nodes that hold it."""
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        _, number = np.unique(flat, return_inverse=True)
        order = np.argsort(number, kind="stable")
        begin = np.searchsorted(number[order], np.arange(number.max() + 2))
        return np.split(number, np.cumsum([len(p) for p in parts])[:-1]), owner[order], begin

    def sharing(i: int, index) -> np.ndarray:
        """How many tokens each node has in common with node i."""
        numbers, holders, begin = index
        mine = numbers[i]
        size = begin[mine + 1] - begin[mine]
        where = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(holders[where], minlength=len(sets))

    keep = n - needed(n, percent) + 1
    filters = [lists([s[np.argsort(shingles.mix(s * np.uint64(seed)))[:p]] for s, p in zip(sets, keep, strict=True)]) for seed in ORDERS]
    full = lists(sets)
    links, forest, parent = np.zeros(len(sets), np.int64), [], list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(split if b is not None else len(sets)):
        may = (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (n > 0)
        may[: i + 1 if b is None else split] = False
        for f in filters:
            if may.any():
                may &= sharing(i, f) > 0
        if not may.any():
            continue
        both = sharing(i, full)
        for j in np.flatnonzero(may & (100 * both >= percent * (n[i] + n - both))).tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                forest.append((int(node[i]), int(node[j])))
    return links, forest


def dealt_in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Copies of the nodes (part, n, …) for every pair of blocks that may hold links: columns _cell, _low, _high, _block.

    A part of at most BLOCK nodes is one block. A larger one is first cut into bands of set size, each ``percent`` of the next, as linked sets lie in
    one band or in neighbours; a cell compares a band with itself (_low <= _high < 0) or with the next (_low < 0 <= _high).
    """
    large = F.col("part_nodes") > BLOCK
    band = F.when(large, F.floor(F.log("n") / F.lit(-np.log(percent / 100))).cast("int")).otherwise(F.lit(0))
    banded = members.withColumn("_band", band)
    sizes = banded.groupBy("part", "_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    upper = sizes.select("part", (F.col("_band") - 1).alias("_band"), F.col("_blocks").alias("_above"))
    lower = sizes.select("part", (F.col("_band") + 1).alias("_band"), F.col("_blocks").alias("_below"))
    around = sizes.join(upper, ["part", "_band"], "left").join(lower, ["part", "_band"], "left")
    banded = banded.join(around, ["part", "_band"])
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int")
    banded = banded.withColumn("_own", own)
    pair = lambda cell, low, high, block: F.struct(cell.alias("cell"), low.alias("low"), high.alias("high"), block.alias("block"))
    mine, cell = F.col("_own"), F.col("_band")
    none = F.array().cast("array<struct<cell:int,low:int,high:int,block:int>>")
    inside = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: pair(cell, -1 - F.greatest(mine, i), -1 - F.least(mine, i), -1 - mine))
    to_next = F.when(F.col("_above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("_above") - 1), lambda i: pair(cell, -1 - mine, i, -1 - mine))).otherwise(none)
    from_last = F.when(F.col("_below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("_below") - 1), lambda i: pair(cell - 1, -1 - i, mine, mine))).otherwise(none)
    dealt = banded.withColumn("_to", F.explode(F.concat(inside, to_next, from_last)))
    return dealt.select("part", "_to.*", *[c for c in ("node", "copies", "tokens") if c in members.columns])


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """(node, other, links) from the nodes of connected parts: an edge of a forest, or a count with no other node."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        a, b = rows[rows["block"] == low].reset_index(drop=True), rows[rows["block"] == high].reset_index(drop=True)
        out = []
        if len(a) and (low == high or len(b)):
            links, forest = compare(a, None if low == high else b, percent)
            nodes = a["node"] if low == high else pd.concat([a["node"], b["node"]])
            out = [(int(x), None, int(c)) for x, c in zip(nodes, links, strict=True) if c] + [(x, y, 0) for x, y in forest]
        return pd.DataFrame(out, columns=["node", "other", "links"]).astype({"node": "Int64", "other": "Int64", "links": "Int64"})

    dealt = dealt_in_blocks(members, percent)
    return dealt.groupBy("part", "cell", "low", "high").applyInPandas(judge, "node bigint, other bigint, links bigint")


def with_tokens(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Add the whole set to every wanted node (node, first_id, fp1, fp2, …), from the text of a document that has it."""
    extra = [c for c in wanted.columns if c not in ("node", "first_id", "fp1", "fp2")]
    # a row of documents repeated with the id, or another text under it, is told apart by the fingerprint
    texts = packed(docs.select("doc_id", F.lit(0).cast("bigint").alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["first_id"])).select("packed", "node", "fp1", "fp2", *extra)
    kinds = dict(wanted.dtypes)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [unpack.decompress(x).decode("utf-8") for x in b.column(0).to_pylist()]
            for first, last, sets in shingles.in_chunks(texts, k):
                part = b.slice(first, last - first)
                fp1, fp2 = shingles.fingerprints(sets)
                same = (part.column(2).to_numpy() == fp1.view(np.int64)) & (part.column(3).to_numpy() == fp2.view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(sets.at.astype(np.int32)), pa.array(sets.values.view(np.int64)))
                out = pa.RecordBatch.from_arrays([part.column(1), *part.columns[4:], lists], names=["node", *extra, "tokens"])
                yield out.filter(pa.array(same))

    schema = ", ".join(f"{c} {kinds[c]}" for c in ["node", *extra]) + ", tokens array<bigint>"
    return rows.mapInArrow(tokens, schema).dropDuplicates(["node"])


def similar(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, text_key (64-bit hash of the text): one row per input row.

    Two documents are linked when the overlap of their sets is at least ``percent`` of the union; ``component_id`` is the smallest id
    reachable by links, ``n_links`` the number of linked documents. Null or empty text, or white space alone, has no shingle and no link and is its own
    component. Rows repeated with an id are documents of their own that are linked by their text. Null ids are linked like others, and are no component's id unless it has no other.
    An empty table gives an empty result; other columns are not read.
    """
    share = share or min(1.0, 1.1 - percent / 100)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    heads = set_heads(docs, k, percent, share).where("n > 0").groupBy(*KEY)
    nodes = heads.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("head").alias("head"), F.first("rest").alias("rest"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")

    shared = written(prefixes(nodes, percent), "jaccard-prefixes")
    star = shared.groupBy("token").agg(F.min("node").alias("hub"))
    edges = shared.join(star, "token").where("node <> hub").select(F.col("hub").alias("ga"), F.col("node").alias("gb"))
    parts = connected_components(shared.select("node").distinct(), edges).withColumnRenamed("label", "part")
    parts = parts.join(parts.groupBy("part").agg(F.count("*").alias("part_nodes")).where("part_nodes > 1"), "part")
    wanted = parts.join(nodes.select("node", "first_id", "fp1", "fp2", "n", "copies"), "node")
    found = written(block_links(with_tokens(docs, wanted, k), percent), "jaccard-links")

    forest = found.where("other IS NOT NULL").select(F.col("node").alias("ga"), F.col("other").alias("gb"))
    touched = forest.select(F.explode(F.array("ga", "gb")).alias("node")).distinct()
    linked = connected_components(touched, forest)
    linked = linked.join(found.groupBy("node").agg(F.sum("links").alias("others")), "node")
    firsts = nodes.select("node", *KEY, "copies", "first_id").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = firsts.groupBy("label").agg(F.min("first_id").alias("component_id"))
    info = firsts.join(lowest, "label").select(*KEY, "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))

    keyed = set_keys(docs, k)
    out = keyed.join(info, KEY, "left")
    empty = F.col("n") == 0
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        "text_key",
    )


@query("op5_ngram_jaccard_join")
def op5(spark, sf):
    return similar(table(spark, sf, "documents"))
