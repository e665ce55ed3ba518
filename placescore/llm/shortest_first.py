"""Shortest-pack-first packing over the length histogram, with the rooms that are left filled by cut pieces.

1. Tasks tokenize, cut documents into full pieces and a rest, and number the pieces of each length as they write them.
2. Only the histogram (at most ``capacity`` rows) reaches the driver. There lengths are placed longest first: a piece goes
   onto the shortest open pack if it fits, else a new pack is opened. Packs with equal contents are one pattern with a
   count, so the work follows the number of patterns, not of pieces.
3. Packs that lie beyond the least number of sequences, counted from the fullest, are given up: their pieces become one
   stream that is cut to fill the rooms of the others. What remains in the end, less than one sequence, becomes sequences
   of powers of two. Nothing is padded, and a room costs one cut at most.
4. A piece's number within its length (prefix sums of the counts per task) is its rank; the pattern table tells from the
   rank alone where it goes.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm import words
from placescore.llm.common import query, table, written
from placescore.llm.packing import with_special, word_encoder

PIECES = "task int, nth bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, capacity: int) -> DataFrame:
    """Full pieces and one rest per document; ids of a rest go along, since it may be cut again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        dictionary, special = word_encoder(vocabulary, 600_000)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, part in words.chunks(texts):
                joined, starts, ends, h, bounds = words.split(part)
                ids, at = dictionary.gather(dictionary.slots(joined, starts, ends, h))
                at = np.concatenate([[0], at])[bounds]
                rows = []
                for i, text in enumerate(part):
                    own = ids[at[i] : at[i + 1]]
                    if any(s in text for s in special):
                        own = with_special(text, special, dictionary)
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        raw = own[start : start + capacity].tobytes()
                        size = len(raw) // 4
                        rows.append((task, seen[size], keys[first + i], start, size, zlib.crc32(raw), len(own), raw if size < capacity else None))
                        seen[size] += 1
                types = (pa.int32(), *[pa.int64()] * 6, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["task", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


# ---- planning on the histogram -------------------------------------------------------------------


def shortest_pack_first(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Packs by their contents. Every piece, longest first, goes onto the shortest pack; when it does not fit there, a new one."""
    packs: Counter[Pattern] = Counter()
    open_at: dict[int, list[list]] = {}  # room -> [pattern, count], the oldest first
    rooms: list[int] = []  # negated, largest first

    def put(pattern: Pattern, times: int, room: int) -> None:
        if not room:
            packs[pattern] += times
            return
        if not open_at.get(room):
            open_at[room] = []
            heapq.heappush(rooms, -room)
        open_at[room].append([pattern, times])

    def longer(pattern: Pattern, length: int) -> Pattern:
        return (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while rooms and not open_at[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= length:
                held = open_at[room][0]
                times = min(left, held[1])
                held[1] -= times
                if not held[1]:
                    open_at[room].pop(0)
                put(longer(held[0], length), times, room - length)
                left -= times
            else:  # the new pack is the only one that takes the next pieces too, until it is full
                each = capacity // length
                whole, rest = divmod(left, each)
                if whole:
                    put(((length, each),), whole, capacity - each * length)
                if rest:
                    put(((length, rest),), 1, capacity - rest * length)
                left = 0
    for room, waiting in open_at.items():
        for pattern, times in waiting:
            packs[pattern] += times
    return packs


def size_of(pattern: Pattern) -> int:
    return sum(length * k for length, k in pattern)


def table_of(rows: list[tuple], names: str) -> dict[str, np.ndarray]:
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names.split())}


def layout(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], dict, dict, dict]:
    """(first number of each length, kept places, given-up pieces, rooms), all by run and bounded by the number of patterns.

    Kept places: from number ``first`` on, ``each`` pieces of ``length`` in every sequence from ``sequence`` on at ``offset``.
    Given-up pieces: from number ``first`` on pieces of ``length``, the first at ``at`` of the stream. Rooms: from ``at`` of the
    stream on, ``times`` rooms of ``room`` tokens in the sequences from ``sequence`` on at ``offset``.
    """
    begin, total = {}, 0
    for length in sorted(counts):
        begin[length], total = total, total + counts[length]
    tokens = sum(length * n for length, n in counts.items())
    keep = tokens // capacity
    kept, given = [], Counter()
    for pattern, times in sorted(shortest_pack_first(counts, capacity).items(), key=lambda x: (-size_of(x[0]), x[0])):
        stay = min(times, keep)
        keep -= stay
        if stay:
            kept.append((pattern, stay))
        for length, k in pattern:
            if times > stay:
                given[length] += k * (times - stay)
    places, rooms, sequence, following = [], [], 0, dict(begin)
    for pattern, times in kept:
        offset = 0
        for length, k in pattern:
            places.append((following[length], k, sequence, offset, length))
            following[length] += k * times
            offset += k * length
        if offset < capacity:
            rooms.append((capacity - offset, times, sequence, offset))
        sequence += times
    stream, at = [], 0
    for length in sorted(given, reverse=True):
        stream.append((following[length], length, at))
        at += length * given[length]
    at, slots = 0, []
    for room, times, seq, offset in sorted(rooms, reverse=True):
        slots.append((at, room, times, seq, offset))
        at += room * times
    rest = tokens % capacity
    for bit in reversed(range(capacity.bit_length())):
        if rest >> bit & 1:
            slots.append((at, 1 << bit, 1, sequence, 0))
            at, sequence = at + (1 << bit), sequence + 1
    return begin, table_of(sorted(places), "first each sequence offset length"), table_of(sorted(stream), "first length at"), table_of(slots, "at room times sequence offset")


# ---- ranks and places ----------------------------------------------------------------------------


def numbered(pieces: DataFrame, counts: DataFrame, begin: dict[int, int], cut_lengths: list[int]) -> DataFrame:
    """Add ``number``, 0, 1, … over all pieces by length; ids stay with the lengths that may be cut."""
    spark = pieces.sparkSession
    starts = spark.createDataFrame(sorted(begin.items()), "length bigint, begin bigint")  # a row per length at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "task", before.alias("before")).join(F.broadcast(starts), "length").select("length", "task", (F.col("begin") + F.col("before")).alias("base"))
    ids = F.when(F.col("length").isin(cut_lengths), F.col("ids")).alias("ids") if cut_lengths else F.lit(None).cast("binary").alias("ids")
    narrow = pieces.select("task", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens", ids)
    return narrow.join(bases, ["length", "task"]).select((F.col("base") + F.col("nth")).alias("number"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")


def placed(rows: DataFrame, places: dict, stream: dict, rooms: dict) -> DataFrame:
    """Join patterns back by rank: kept pieces as they are, given-up ones cut at the borders of the rooms."""

    def cut(doc_id, start: int, tokens: int, ids: bytes, at: int) -> Iterator[tuple]:
        done, size = 0, len(ids) // 4
        while done < size:
            r = int(np.searchsorted(rooms["at"], at, side="right")) - 1
            nth, inside = divmod(at - int(rooms["at"][r]), int(rooms["room"][r]))
            take = min(int(rooms["room"][r]) - inside, size - done)
            crc = zlib.crc32(ids[4 * done : 4 * (done + take)])
            yield doc_id, start + done, take, crc, tokens, int(rooms["sequence"][r]) + nth, int(rooms["offset"][r]) + inside
            done, at = done + take, at + take

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = OUT.replace(" bigint", "").split(", ")
        for b in batches:
            number, length = b.column("number").to_numpy(), b.column("length").to_numpy()
            fits = np.zeros(len(number), bool)
            if len(places["first"]):
                row = np.searchsorted(places["first"], number, side="right") - 1
                fits = (row >= 0) & (places["length"][row] == length)
                if len(stream["first"]):  # a length's given-up pieces come after its kept ones
                    given = np.searchsorted(stream["first"], number, side="right") - 1
                    fits &= (given < 0) | (stream["first"][given] < places["first"][row])
                row = row[fits]
                inside = number[fits] - places["first"][row]
                each = places["each"][row]
                seq, off = places["sequence"][row] + inside // each, places["offset"][row] + inside % each * length[fits]
                whole = b.filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in names[:5]), pa.array(seq), pa.array(off)], names=names)
            rest = b.filter(pa.array(~fits))
            if len(rest):
                got = number[~fits]
                run = np.searchsorted(stream["first"], got, side="right") - 1
                at = stream["at"][run] + (got - stream["first"][run]) * stream["length"][run]
                columns = (rest.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
                rows = [r for x in zip(*columns, at.tolist(), strict=True) for r in cut(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return rows.mapInArrow(place, OUT)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every sequence but the last ones is full, and those have powers of two. Null text is empty; an empty text is the end
    token alone. A row with a null id or repeated rows are packed like any other. A very long text gives many full pieces.
    An empty table gives an empty result; other columns are not read.
    """
    pieces = written(token_pieces(docs, vocabulary, id_col, text_col, end_id, capacity), "pack-pieces")
    counts = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return docs.sparkSession.createDataFrame([], OUT)
    begin, places, stream, rooms = layout(histogram, capacity)
    return placed(numbered(pieces, counts, begin, [x for x in stream["length"].tolist() if x < capacity]), places, stream, rooms)


@query("op12_shortest_pack_first")
def op12(spark, sf):
    import public_tokenizers

    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
