"""Alignment of two tokenizers over a corpus: links between their tokens, counted by external spill counting.

1. Texts are cut at every space that follows a character which is no white space. Both tokenizers have a token boundary
   there, so each distinct stretch is encoded and aligned once per worker, and a document is the sum of its stretches.
2. The pair-document records of a run of documents are sorted by (first id, second id, document). The run's pairs and the
   number of its documents that hold each are radix-partitioned by first id into zstd frames; the records stay in one
   zstd blob with their run.
3. Frames are counted by k-way heap merges, FAN_IN at a time, in a tree whose inner results are written tables. No task
   sees more than FAN_IN frames, and an id that every document holds is one entry of each.
4. At the root a frame is ordered by first id, so each id's highest count is known when its stretch ends. Counts then go
   down the same tree, to each frame only what it holds, and meet the run's records, which gives every document its share.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.llm import words
from placescore.llm.common import query, table, written
from placescore.llm.packing import shown_bytes

#: Frames merged at once, partitions of the first id, records and documents after which a run ends.
FAN_IN, RADIX, RUN_RECORDS, RUN_DOCS = 32, 16, 2_000_000, 20_000
SPACE_MARK = "▁"
DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
RUNS = "run bigint, radix int, frame binary, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"
_pairs_of: dict = {}


# ---- the two tokenizers --------------------------------------------------------------------------


class TokenizerPair:
    """Encodes stretches by both tokenizers and aligns them by bytes."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        back = {chr(c): bytes([b]) for b, c in shown_bytes().items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        shown = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [b"".join(back.get(c, c.encode()) for c in t) for t in shown]
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)]
        self.nb = len(names)
        #: a piece with a space after another character could cross a cut; then a text is one stretch
        self.cuts = not any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names)
        self.lone_space = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # how an id is shown inside a group and at its end
        self.a_shown, self.b_shown = ([np.array([b"%d%c" % (i, c) for i in range(n)] + [b""], object)[:-1] for c in marks] for n, marks in ((size, b",|"), (self.nb, b",;")))
        self.clear_notes()
        owner = self

        class Stretches(words.Dictionary):
            def clear(self) -> None:
                super().clear()
                owner.clear_notes()

        self.known = Stretches(self.align, limit=800_000, weight=32_000_000, dtype=np.uint64)

    def clear_notes(self) -> None:
        self.numbers = np.zeros((0, 4), np.int64)  # ids of A, ids of B, groups, whether it can be aligned
        self.shown: list[bytes] = []

    def align(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of links, all links as a_id * nb + b_id) of each stretch; counts and the shown groups are noted in the same order."""
        a = [x.ids for x in self.a.encode_batch_fast(found, add_special_tokens=False)]
        b = [x or self.lone_space for x in self.b.encode([t[1:] for t in found], num_threads=1)]
        raw = [t.encode("utf-8", "surrogatepass") for t in found]
        fits = self.spelled(a, self.a_bytes, raw) & self.spelled(b, self.b_bytes, raw)
        kept = np.flatnonzero(fits).tolist()
        n_a, n_b = (np.where(fits, np.fromiter(map(len, x), np.int64, len(x)), 0) for x in (a, b))
        a, b = (np.fromiter((i for k in kept for i in x[k]), np.int64) for x in (a, b))
        # the stretches one after the other: ends of tokens, of both tokenizers' tokens, of stretches
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends, both = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = np.cumsum(np.where(fits, np.fromiter(map(len, raw), np.int64, len(raw)), 0))
        links = a[np.searchsorted(ends_a, ends)] * self.nb + b[np.searchsorted(ends_b, ends)]
        groups = np.bincount(np.searchsorted(last, both), minlength=len(found))
        # shown ids in the order of groups: A's ids of a group, then B's
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        done_a, done_b = np.cumsum(np.bincount(group_a, minlength=len(both))), np.cumsum(np.bincount(group_b, minlength=len(both)))
        shown = np.empty(len(a) + len(b), object)
        close_a, close_b = both[group_a] == ends_a, both[group_b] == ends_b
        shown[np.arange(len(a)) + np.concatenate([[0], done_b])[group_a]] = np.where(close_a, self.a_shown[1][a], self.a_shown[0][a])
        shown[np.arange(len(b)) + done_a[group_b]] = np.where(close_b, self.b_shown[1][b], self.b_shown[0][b])
        shown, upto = shown.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.shown += [b"".join(shown[i:j])[:-1] for i, j in zip(upto[:-1], upto[1:], strict=True)]
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, groups, fits], axis=1).astype(np.int64)])
        return np.bincount(np.searchsorted(last, ends), minlength=len(found)), links.astype(np.uint64)

    @staticmethod
    def spelled(ids: list[list[int]], pieces: list[bytes], raw: list[bytes]) -> np.ndarray:
        """Which stretches the bytes of their tokens spell out."""
        return np.array([b"".join([pieces[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)], bool)

    def stretches(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``words.split``, of a space and each text, cut where both tokenizers have a boundary."""
        spaced = [" " + t for t in texts]
        joined = "".join(spaced)
        cp = words.code_points(joined)
        firsts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in spaced], out=firsts[1:])
        mark = np.zeros(len(cp) + 1, bool)
        if self.cuts:
            mark[1:-1] = (cp[1:] == 32) & (words.char_classes()[cp[:-1]] != words.SPACE)
        mark[firsts] = True
        bounds = np.flatnonzero(mark)
        starts, ends = bounds[:-1], bounds[1:]
        return joined, starts, ends, words._hash(cp, starts, ends), np.searchsorted(starts, firsts)

    def documents(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256) of each text, and its distinct links: (text, pair, times), by text."""
        joined, starts, ends, h, bounds = self.stretches(texts)
        slots = self.known.slots(joined, starts, ends, h)
        sums = np.zeros((len(slots) + 1, 4), np.int64)
        np.cumsum(self.numbers[slots], axis=0, out=sums[1:])
        own = sums[bounds[1:]] - sums[bounds[:-1]]
        whole = (own[:, 3] == np.diff(bounds)) & np.array([len(t) > 0 for t in texts])
        links, at = self.known.gather(slots)
        at = np.concatenate([[0], at])[bounds]
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        links, doc = links[whole[doc]], doc[whole[doc]]
        record, times = np.unique(links.astype(np.int64) * len(texts) + doc, return_counts=True)
        pair, doc = np.divmod(record, len(texts))
        rows, names = [], slots.tolist()
        for i in range(len(texts)):
            if whole[i]:
                digest = hashlib.sha256(b";".join([self.shown[s] for s in names[bounds[i] : bounds[i + 1]]])).hexdigest()
                rows.append((*own[i, :3].tolist(), int(at[i + 1] - at[i]), digest))
            else:
                rows.append((0, 0, 0, 0, ""))
        return rows, doc, pair, times


def tokenizer_pair(paths: tuple[str, str]) -> TokenizerPair:
    """One per worker process."""
    if paths not in _pairs_of:
        _pairs_of.clear()
        _pairs_of[paths] = TokenizerPair(*paths)
    return _pairs_of[paths]


# ---- runs and frames -----------------------------------------------------------------------------


def pressed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other, ascending ones as differences by the caller."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def opened(frame: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(frame)
    width = sum(np.dtype(t).itemsize for t in types)
    n, at, out = len(raw) // width, 0, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def frame_of(pair: np.ndarray, n: np.ndarray, *more: np.ndarray) -> bytes:
    return pressed(np.diff(pair, prepend=0), n, *more)


def entries(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = opened(frame, np.int64, np.int64)
    return np.cumsum(step), n


def spill(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Runs of documents: one row without radix (records, documents) and a frame of pairs per radix."""

    def run_rows(run: int, rows: list, parts: list, nb: int) -> Iterator[pa.RecordBatch]:
        doc, pair, times = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(pair, kind="stable")  # documents stay ascending within a pair
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        n = np.diff(np.append(first, len(pair)))
        held = pair[first]
        columns = [[run], [None], [pressed(doc.astype(np.int32), times.astype(np.int32))], [[dict(zip(DOC.names, r, strict=True)) for r in rows]]]
        radix = held // nb % RADIX
        for r in np.unique(radix).tolist():
            mine = radix == r
            for c, v in zip(columns, (run, r, frame_of(held[mine], n[mine]), None), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.list_(DOC)), strict=True)], names=["run", "radix", "frame", "docs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, run = tokenizer_pair(paths), TaskContext.get().partitionId() << 24
        rows, parts, size = [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, some in words.chunks(texts):
                numbers, doc, links, times = pair.documents(some)
                parts.append((doc + len(rows), links, times))
                rows += [(keys[first + i], *x) for i, x in enumerate(numbers)]
                size += len(links)
                if size >= RUN_RECORDS or len(rows) >= RUN_DOCS:
                    yield from run_rows(run, rows, parts, pair.nb)
                    rows, parts, size, run = [], [], 0, run + 1
        if rows:
            yield from run_rows(run, rows, parts, pair.nb)

    return docs.mapInArrow(cut, RUNS)


# ---- the merge tree ------------------------------------------------------------------------------


def heap_merged(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs ascending, summed counts) of several frames by a k-way heap merge."""

    def stream(frame: bytes) -> Iterator[tuple[int, int]]:
        pair, n = entries(frame)
        for at in range(0, len(pair), 65_536):
            yield from zip(pair[at : at + 65_536].tolist(), n[at : at + 65_536].tolist(), strict=True)

    pairs, sums, last = [], [], None
    for pair, n in heapq.merge(*map(stream, frames)):
        if pair == last:
            sums[-1] += n
        else:
            pairs.append(pair)
            sums.append(n)
            last = pair
    return np.array(pairs, np.int64), np.array(sums, np.int64)


def merge_level(frames: DataFrame) -> DataFrame:
    """Frames of a node, given as (radix, node, frame), merged into one."""

    def merge(group: pa.Table) -> pa.Table:
        merged = frame_of(*heap_merged(group.column("frame").to_pylist()))
        return pa.table({"radix": group.column("radix").slice(0, 1), "node": group.column("node").slice(0, 1), "frame": pa.array([merged], pa.binary())})

    return frames.groupBy("radix", "node").applyInArrow(merge, "radix int, node bigint, frame binary")


def with_maxima(root: DataFrame, nb: int) -> DataFrame:
    """Root frames with a mark on the pairs whose count is the highest of their first id."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for frame in b.column("frame").to_pylist():
                pair, n = entries(frame)
                side = pair // nb
                first = np.flatnonzero(np.diff(side, prepend=-1))
                highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(side)))) if len(n) else n
                out.append(frame_of(pair, n, (n == highest).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([b.column("radix"), b.column("node"), pa.array(out, pa.binary())], names=["radix", "node", "frame"])

    return root.mapInArrow(mark, "radix int, node bigint, frame binary")


def down_level(parents: DataFrame, children: DataFrame, keep_own: bool = False) -> DataFrame:
    """(radix, child, frame): the parent's counts for the pairs that each child holds; ``children`` has radix, node, child, frame.

    ``keep_own`` adds the child's own number of documents beside each count.
    """

    def hand(parent: pa.Table, child: pa.Table) -> pa.Table:
        out = []
        if len(child):
            step, n, best = opened(parent.column("frame")[0].as_py(), np.int64, np.int64, np.uint8)
            pair = np.cumsum(step)
            for frame in child.column("frame").to_pylist():
                mine, own = entries(frame)
                at = np.searchsorted(pair, mine)
                out.append(frame_of(mine, n[at], best[at], *([own] if keep_own else [])))
        return pa.table({"radix": child.column("radix"), "child": child.column("child"), "frame": pa.array(out, pa.binary())})

    return parents.groupBy("radix", "node").cogroup(children.groupBy("radix", "node")).applyInArrow(hand, "radix int, child bigint, frame binary")


def settle(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """Records of a run meet the counts of its pairs: one row per document."""

    def sums(run: pa.Table, frames: pa.Table) -> pa.Table:
        docs = run.column("docs").combine_chunks().flatten() if len(run) else pa.array([], DOC)
        best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        if len(run) and len(frames):
            doc, times = opened(run.column("frame")[0].as_py(), np.int32, np.int32)
            parts = [opened(f, np.int64, np.int64, np.uint8, np.int64) for f in frames.column("frame").to_pylist()]
            pair, n, top, held = (np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(4))
            order = np.argsort(pair)
            n, top, held = n[order], top[order], held[order]
            times = times.astype(np.int64)
            np.add.at(total, doc, times * np.repeat(n, held))
            np.add.at(best, doc, times * np.repeat(top.astype(np.int64), held))
        f = {name: docs.field(i) for i, name in enumerate(DOC.names)}
        return pa.table({**{k: f[k] for k in DOC.names[:5]}, "n_best": best, "count_sum": total, "groups_sha256": f["groups_sha256"]})

    return runs.groupBy("run").cogroup(counted.groupBy("run")).applyInArrow(sums, OUT)


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level vocabulary over a space and the text, B the piece model over the text. Null and empty texts, and
    texts whose tokens do not spell out the space and the text, have zeros and an empty digest, and count nowhere. Rows
    with a null id or repeated rows are documents like any other. A very long text is aligned whole; it makes a run of its
    own. An empty table gives an empty result; other columns are not read.
    """
    paths = (byte_level, pieces)
    nb = len(tokenizer_pair(paths).b_bytes)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spilled = written(spill(own, paths), "align-runs")
    runs, frames = spilled.where("radix IS NULL").select("run", "frame", "docs"), spilled.where("radix IS NOT NULL").select("radix", "run", "frame")
    nodes = max(1, -(-runs.count() // fan_in))
    level = first = frames.select("radix", F.col("run").alias("child"), F.pmod(F.xxhash64("run"), F.lit(nodes)).alias("node"), "frame")
    levels = []
    while True:
        merged = written(merge_level(level.select("radix", "node", "frame")), "align-merged")
        if nodes == 1:
            break
        level = merged.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / fan_in))
        levels.append(level)
        nodes = -(-nodes // fan_in)
    counts = with_maxima(merged, nb)
    for level in reversed(levels):
        counts = written(down_level(counts, level).withColumnRenamed("child", "node"), "align-counts")
    return settle(runs, down_level(counts, first, keep_own=True).select(F.col("child").alias("run"), "frame"))


@query("op13_token_alignment")
def op13(spark, sf):
    import public_tokenizers as p

    return align(table(spark, sf, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
