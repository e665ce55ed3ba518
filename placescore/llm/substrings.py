"""Removal of byte strings that occur earlier, by a column-wise collection suffix order over the places where repeats can be.

A window of ``width`` bytes is owned by its minimiser: the leftmost smallest hash among the ``gram``-byte strings in it. Equal windows have equal
minimisers at equal distances, so only places with a common minimiser can repeat each other. The bytes of all windows that a minimiser
owns at one place are its region. Equal regions are settled by a key; from each class only the earliest place goes on, and
only where a minimiser has several classes. These regions are the documents of the column-wise construction: each round
puts one more column of up to eight symbols in front of every region's suffix and rewrites the collection's transform in order, until all suffixes are
sorted; neighbours that agree on a whole window repeat each other. Rounds over whole documents would follow the bytes of the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import packed, query, table, written
from placescore.llm.shingles import mix
from placescore.llm.words import _powers, chunks

GRAM = 28
#: Regions sorted together; a minimiser with more classes than that is dealt by window.
BLOCK = 2_048
PLACES = "h bigint, r bigint, key bigint, lo int, hi int, sure boolean"


def _roll(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * inverse[begin])


def _sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[: len(buf)], out=sums[1:])
    return sums, inverse


def owners(raw: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(document, minimiser hash, region hash, first and last window start) of every minimiser; starts count from the document's first byte."""
    buf = np.frombuffer(b"".join(raw), np.uint8)
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=first[1:])
    none = np.zeros(0, np.int64)
    if len(buf) < width:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums, inverse = _sums(buf)
    grams = np.arange(len(buf) - GRAM + 1)
    h = _roll(sums, inverse, grams, grams + GRAM)
    span = width - GRAM + 1
    low, reach = grams.astype(np.int32), 1
    while reach * 2 <= span:  # leftmost smallest of the next ``reach`` grams
        a, b = low[:-reach], low[reach:]
        low, reach = np.where(h[a] <= h[b], a, b), reach * 2
    a, b = low[: len(low) - (span - reach)], low[span - reach :]
    low = np.where(h[a] <= h[b], a, b)  # per window start
    doc = np.repeat(np.arange(len(raw)), np.diff(first))[: len(low)]
    whole = np.arange(len(low)) + width <= first[doc + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.ones(len(at), bool)
    new[1:] = (low[at][1:] != low[at][:-1]) | (at[1:] != at[:-1] + 1)
    begin = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    place = low[begin]
    shape = ((place - begin) * (width + 1) + (end - begin)).astype(np.uint64)
    region = mix(_roll(sums, inverse, begin, end + width) + shape * np.uint64(0x9E3779B97F4A7C15))
    d = doc[begin]
    return d, h[place], region, begin - first[d], end - first[d]


def places(docs: DataFrame, width: int) -> DataFrame:
    """PLACES over all documents (key, text). Equal regions of a batch go on as the earliest; the others are sure to repeat it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for at, part in chunks(b.column(1).to_pylist()):
                d, h, r, lo, hi = owners([t.encode("utf-8", "replace") for t in part], width)
                key = keys[at + d]
                order = np.lexsort((lo, key, r, h))
                h, r, key, lo, hi = h[order], r[order], key[order], lo[order], hi[order]
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else lo
                sure = same & ((key != key[head]) | (lo != lo[head]))
                h = np.where(sure, mix(h ^ (key.view(np.uint64) * np.uint64(0xD1B54A32D192ED03) + lo.astype(np.uint64))), h)  # settled: need not meet the others
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(r.view(np.int64)), pa.array(key), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(sure)],
                    names=["h", "r", "key", "lo", "hi", "sure"],
                )

    return docs.select("key", "text").mapInArrow(find, PLACES)


def settle(found: DataFrame) -> DataFrame:
    """(h, key, lo, hi, open): places that repeat an earlier equal region, and (open) the earliest of each class where a minimiser has several.

    Rows come in order; a class or minimiser of any size passes as a stream.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last_r = None
        head = (None, None)  # key and lo of the class at hand
        classes, pending = 0, None  # of the minimiser at hand; its only class so far
        for b in batches:
            h, r, key, lo, hi, sure = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            n = len(h)
            if not n:
                continue
            new_h, new_r = np.ones(n, bool), np.ones(n, bool)
            new_h[1:], new_r[1:] = h[1:] != h[:-1], r[1:] != r[:-1]
            new_h[0] = last_h is None or h[0] != last_h
            new_r[0] = last_r is None or r[0] != last_r
            fresh = new_h | new_r
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            head_key = np.where(first >= 0, key[np.maximum(first, 0)], head[0] if head[0] is not None else 0)
            head_lo = np.where(first >= 0, lo[np.maximum(first, 0)], head[1] if head[1] is not None else 0)
            repeat = sure | ~fresh & ((key != head_key) | (lo != head_lo))
            fresh &= ~sure
            run = np.cumsum(new_h)  # 0: goes on from the last batch
            seen = np.bincount(run[fresh], minlength=run[-1] + 1)
            seen[0] += classes
            is_open = fresh & (seen[run] > 1)
            told = np.flatnonzero(repeat | is_open)
            columns = [x[told] for x in (h, key, lo, hi, is_open)]
            late = pending if pending is not None and run[0] == 0 and seen[0] > 1 else None
            if late is not None:
                columns = [np.append(c, v) for c, v in zip(columns, (*late, True), strict=True)]
            if run[-1] > 0 or late is not None:
                pending = None
            classes = int(seen[-1])
            only = np.flatnonzero(fresh & (run == run[-1]))
            if classes == 1 and len(only):
                i = only[0]
                pending = (h[i], key[i], lo[i], hi[i])
            last_h, last_r, head = h[-1], r[-1], (head_key[-1], head_lo[-1])
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h", "key", "lo", "hi", "open"])

    ordered = found.repartition("h").sortWithinPartitions("h", "r", "key", "lo", "sure")
    return ordered.mapInArrow(stream, "h bigint, key bigint, lo int, hi int, open boolean")


def regions(docs: DataFrame, settled: DataFrame, width: int) -> DataFrame:
    """(h, key, lo, bytes) of the open places; a minimiser with very many classes gives a row per window, under the window's own hash."""
    open_places = settled.where("open")
    crowded = open_places.groupBy("h").agg(F.count("*").alias("_classes")).where(F.col("_classes") > BLOCK).select("h", F.lit(True).alias("crowded"))
    marked = open_places.join(crowded, "h", "left").groupBy("key").agg(F.collect_list(F.struct("h", "lo", "hi", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("found"))
    rows = packed(docs).join(marked, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for key, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = unpack.decompress(text)
                for x in found:
                    if not x["crowded"]:
                        out.append((x["h"], key, x["lo"], raw[x["lo"] : x["hi"] + width]))
                    else:
                        for s in range(x["lo"], x["hi"] + 1):
                            window = raw[s : s + width]
                            out.append((int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), key, s, window))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["h", "key", "lo", "bytes"])

    return rows.select("key", "packed", "found").mapInArrow(cut, "h bigint, key bigint, lo int, bytes binary")


def columns_of(text: np.ndarray, left_of_end: np.ndarray) -> tuple[int, np.ndarray]:
    """(width, rank of the symbols from each place on): as many symbols to a column as have at most 65,536 different fillings.

    A column that reaches past the end of its string is filled with the end's symbol.
    """
    rank, wide = np.unique(text, return_inverse=True)[1].reshape(-1), 1
    while wide < 8:
        after = np.zeros(len(text), np.int64)
        after[:-wide] = rank[wide:] if len(text) > wide else 0
        after[left_of_end < wide] = 0  # the end is the smallest symbol, and so is a column of nothing else
        found, twice = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
        if len(found) > 1 << 16:
            break
        rank, wide = twice.reshape(-1), wide * 2
    return wide, rank.astype(np.uint16)


def collection_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start) of all non-empty suffixes in order, by the column-wise construction, and the text they lie in.

    A round knows the order of the suffixes up to some size and, for each, the column before it: the collection's transform.
    Dealing the transform by column, in order, is the order of the suffixes one column longer. A column has as many symbols
    as 16 bits can tell apart, so a round deals by a radix of that size.
    """
    count = len(strings)
    length = np.array([len(s) for s in strings])
    first = np.zeros(count + 1, np.int64)
    np.cumsum(length + 1, out=first[1:])
    text = np.zeros(first[-1], np.int16)  # 0 ends a string
    flat = np.frombuffer(b"\xff".join(strings), np.uint8)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    text[inner] = np.delete(flat, first[1:-1] - 1).astype(np.int16) + 1
    left = np.arange(first[-1]) - np.repeat(first[:-1], length + 1)  # symbols before a suffix in its string
    size = np.repeat(length, length + 1) - left
    wide, column = columns_of(text, size)
    short = np.flatnonzero(size < wide)
    order = short[np.argsort(column[short], kind="stable")]
    for _ in range(int(length.max(initial=0)) // wide):
        before = order[left[order] >= wide] - wide
        every = np.concatenate([short, before])
        order = every[np.argsort(column[every], kind="stable")]
    owner = np.repeat(np.arange(count), length + 1)
    order = order[count:]
    return owner[order], left[order], order


def repeats(strings: list[bytes], key: np.ndarray, lo: np.ndarray, width: int) -> np.ndarray:
    """For each (string, window) whether an equal window lies at an earlier (key, start): a boolean row per string, padded with False."""
    owner, start, order = collection_order(strings)
    length = np.array([len(s) for s in strings])
    windows = int(length.max()) - width + 1
    out = np.zeros((len(strings), windows), bool)
    whole = length[owner] - start >= width
    owner, start = owner[whole], start[whole]
    flat = np.frombuffer(b"".join(strings), np.uint8)
    at = (np.cumsum(length) - length)[owner] + start
    view = np.lib.stride_tricks.sliding_window_view(flat, width)
    same = np.zeros(len(at), bool)
    for i in range(0, len(at) - 1, 50_000):  # common prefix of neighbours, up to the window
        j = min(i + 50_000, len(at) - 1)
        same[i + 1 : j + 1] = (view[at[i:j]] == view[at[i + 1 : j + 1]]).all(axis=1)
    group = np.cumsum(~same)
    by_place = np.lexsort((lo[owner] + start, key[owner], group))
    later = np.zeros(len(at), bool)
    g, k, s = group[by_place], key[owner][by_place], (lo[owner] + start)[by_place]
    begins = np.ones(len(g), bool)
    begins[1:] = g[1:] != g[:-1]
    head = np.maximum.accumulate(np.where(begins, np.arange(len(g)), 0))
    later[by_place] = (k != k[head]) | (s != s[head])
    out[owner[later], start[later]] = True
    return out


def resolve(rows: DataFrame, width: int) -> DataFrame:
    """(key, lo, hi): runs of windows that repeat an earlier one, from regions that share a minimiser."""

    def judged(block: list[tuple]) -> pa.RecordBatch:
        key, lo = np.array([x[1] for x in block]), np.array([x[2] for x in block])
        hit = repeats([x[3] for x in block], key, lo, width)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return runs_of(key[i], lo[i] + a, lo[i] + b - 1)

    def runs_of(key, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["key", "lo", "hi"])

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # regions to be sorted together
        at, first = None, {}  # the hash at hand and its distinct strings; BLOCK at most but for clashes of a window's hash
        for b in batches:
            whole = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != at:
                    if len(first) > 1:
                        held += first.values()
                    at, first = row[0], {}
                    if len(held) >= BLOCK:
                        yield judged(held)
                        held = []
                known = first.setdefault(row[3], row)
                if known[1:3] != row[1:3]:
                    whole.append((row[1], row[2], row[2] + len(row[3]) - width))
            if whole:
                yield runs_of(*zip(*whole, strict=True))
        if len(first) > 1:
            held += first.values()
        if held:
            yield judged(held)

    return rows.repartition("h").sortWithinPartitions("h", "key", "lo").mapInArrow(sort_blocks, "key bigint, lo int, hi int")


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): the id itself where ids tell documents apart; else numbers in the order of id (nulls last) and text hash."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    odd = marks.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("doc_id IS NULL OR a <> b")
    if odd.isEmpty():
        return docs.select("doc_id", F.col("doc_id").alias("key"), "text")
    ordered = marks.distinct().orderBy(F.col("doc_id").asc_nulls_last(), "mark").withColumn("key", F.monotonically_increasing_id())
    numbers = written(ordered.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "key"), "substring-keys")
    joined = docs.withColumn("mark", F.xxhash64("text")).join(numbers, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return written(joined.select("doc_id", "key", "text"), "substring-documents")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the bytes left as ``kept``: one row per input row.

    A byte goes when a string of ``width`` bytes over it also starts earlier: in a document with a smaller id, or earlier in the same one.
    Null text is empty; texts shorter than ``width`` stay whole, very long ones are taken whole. Rows repeated with id and text are one
    document and get the same result; other texts under one id count in the order of their hash, null ids after all others. An empty
    table gives an empty result; other columns are not read. ``width`` is more than GRAM.
    """
    rows = with_keys(docs, id_col, text_col)
    settled = written(settle(places(rows, width)), "substring-places")
    runs = resolve(regions(rows, settled, width), width)
    every = settled.where("NOT open").select("key", "lo", "hi").unionByName(runs)
    by_key = every.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(names)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = unpack.decompress(text)
                change = np.zeros(len(raw) + 1, np.int32)
                for x in found or ():
                    change[x["lo"]] += 1
                    change[x["hi"] + width] -= 1
                gone = np.cumsum(change)[: len(raw)] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    joined = packed(rows).join(by_key, "key", "left").select("doc_id", "packed", "runs")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return joined.mapInArrow(keep, schema).withColumnRenamed("doc_id", id_col)


@query("op2_suffix_dedup")
def op2(spark, sf):
    return remove_repeats(table(spark, sf, "documents"))
