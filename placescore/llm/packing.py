"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Documents are cut into pieces of at most ``capacity`` tokens. The histogram of piece lengths has at most ``capacity`` rows
whatever the size of the corpus; only it reaches the driver. There, multiplicative weights price lengths, a knapsack
dynamic program finds the best fillings at those prices, and the fractional solution is rounded; what is left is placed
best-fit, longest first, on the histogram as well. Pieces are numbered within their length in parallel, and the number
alone tells sequence and offset.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm import words
from placescore.llm.common import few_rows, query, table, written

#: Pieces numbered in one window.
ROWS_PER_WINDOW = 5_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_encoders: dict = {}


def word_encoder(path: str, limit: int) -> words.Dictionary:
    """One dictionary per worker process, filled by the tokenizer's own encoding of each distinct word."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, shown = tokenizer.model, shown_bytes()
        encode = lambda batch: [[t.id for t in model.tokenize(w.encode("utf-8", "replace").decode("latin-1").translate(shown))] for w in batch]
        _encoders[path] = words.Dictionary(encode, limit), {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return _encoders[path]


def shown_bytes() -> dict[int, int]:
    """The character by which a byte-level vocabulary shows each byte: printable Latin-1 as itself, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, capacity: int, cache_words: int = 600_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): only documents over ``capacity`` are cut, the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, special = word_encoder(vocabulary, cache_words)
        for batch in few_rows(batches):
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
                    start, size = 0, len(own) % capacity or capacity
                    number = 0
                    while start < len(own):
                        rows.append((keys[first + i], number, start, size, zlib.crc32(own[start : start + size].tobytes())))
                        start, size, number = start + size, capacity, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def with_special(text: str, special: dict[str, int], dictionary: words.Dictionary) -> np.ndarray:
    """A text that spells out a special token: the tokenizer gives it its own id and encodes the parts between."""
    import regex

    out = []
    for part in regex.split("(" + "|".join(map(regex.escape, special)) + ")", text):
        if part in special:
            out.append(np.array([special[part]], np.uint32))
        elif part:
            joined, starts, ends, h, _ = words.split([part])
            out.append(dictionary.gather(dictionary.slots(joined, starts, ends, h))[0])
    return np.concatenate(out)


# ---- planning on the histogram -------------------------------------------------------------------


def best_fillings(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, choice) for every room up to the capacity: its most valuable multiset of lengths and one of them (unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        value[c], k = value[c - 1], fitting[c]
        if k:
            with_piece = value[c - lengths[:k]] + prices[:k]
            best = int(np.argmax(with_piece))
            if with_piece[best] > value[c] + 1e-15:
                value[c], choice[c] = with_piece[best], best
    return value, choice


def fractional(counts: dict[int, int], capacity: int, rate: float, steps: int, near: float) -> tuple[dict[tuple, float], float]:
    """(how often each filling is used, bound): the configuration program by multiplicative weights, until a length is used up.

    A length that lags behind is priced higher. A round takes, for every length whose best filling is worth nearly as much as the best
    of all, that filling, and covers a length by at most one of ``steps``. No filling is used beyond the pieces there are. Prices also bound
    from below how many sequences any packing needs.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[int(x)] for x in lengths], float)
    covered, used, bound = np.zeros(len(lengths)), Counter(), 0.0
    sizes, pieces = lengths.tolist(), need.tolist()
    while covered.max() < 1 - 1e-9:
        prices = lengths / capacity * np.exp(-rate * (covered - covered.min()))
        value, choice = best_fillings(lengths, prices, capacity)
        bound = max(bound, float((prices * need).sum() / value[capacity]))
        worth = prices + value[capacity - lengths]
        most, now, choice = np.minimum(1.0, covered + 1 / steps).tolist(), covered.tolist(), choice.tolist()
        good = np.flatnonzero(worth >= (1 - near) * worth.max())
        for i in good[np.lexsort((-good, np.round(covered[good], 3)))].tolist():
            filling, room = Counter([i]), capacity - sizes[i]
            while room > 0:
                if choice[room] < 0:
                    room -= 1
                else:
                    filling[choice[room]] += 1
                    room -= sizes[choice[room]]
            step = min((most[k] - now[k]) * pieces[k] / n for k, n in filling.items())
            if step > 0:
                for k, n in filling.items():
                    now[k] += step * n / pieces[k]
                used[tuple((sizes[k], filling[k]) for k in sorted(filling, reverse=True))] += step
        covered = np.array(now)
    return used, bound


def rounded(program: dict[tuple, float], left: dict[int, int]) -> Counter:
    """Whole numbers of fillings: what one is rounded down by is owed to the next, and none is used beyond the pieces left."""
    chosen, owed = Counter(), 0.0
    for filling, times in sorted(program.items(), key=lambda e: (-e[1], e[0])):
        owed += times
        whole = min(int(owed + 1e-9), *(left[length] // k for length, k in filling))
        if whole:
            chosen[filling] = whole
            owed -= whole
            for length, k in filling:
                left[length] -= k * whole
    return chosen


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on counts: bins with equal contents are handled together."""
    open_bins: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length and open_bins[r]), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for k, n in ((each, full), (rest, 1)):
                    if k and n:
                        open_bins.setdefault(capacity - k * length, Counter())[((length, k),)] += n
                break
            contents, n = next(iter(open_bins[room].items()))
            n = min(n, left)
            open_bins[room][contents] -= n
            if not open_bins[room][contents]:
                del open_bins[room][contents]
            more = Counter(dict(contents))
            more[length] += 1
            open_bins.setdefault(room - length, Counter())[tuple(sorted(more.items(), reverse=True))] += n
            left -= n
    out: Counter = Counter()
    for bins in open_bins.values():
        out.update(bins)
    return out


def plan(counts: dict[int, int], capacity: int, rate: float = 3.0, steps: int = 30, near: float = 0.05) -> Counter:
    """Fillings and how many sequences use each; together they hold every piece exactly once.

    The program is solved on what is left, rounded, and solved again until it places nothing more. The rest is placed best-fit,
    after no, one or more of these passes, whichever makes fewest sequences; passes end early only where the program's bound shows that none
    can make fewer. The work depends on the number of distinct lengths, not on the number of pieces.
    """
    left, chosen = dict(counts), Counter()
    best, least = best_fit(left, capacity), 0
    while left:
        program, bound = fractional(left, capacity, rate, steps, near)
        least = least or int(np.ceil(bound - 1e-6))  # the first bound is that of all pieces
        if sum(best.values()) <= least:
            break
        placed = rounded(program, left)
        if not placed:
            break
        chosen.update(placed)
        left = {k: v for k, v in left.items() if v}
        tried = chosen + best_fit(left, capacity)
        if sum(tried.values()) < sum(best.values()):
            best = tried
    return best


def slots(chosen: Counter, counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their running number over all lengths in ascending order."""
    begin, total = {}, 0
    for length in sorted(counts):
        begin[length], total = total, total + counts[length]
    rows, sequence = [], 0
    for filling, times in sorted(chosen.items()):
        offset = 0
        for length, k in filling:
            rows.append((begin[length], k, sequence, offset, length))
            begin[length] += k * times
            offset += k * length
        sequence += times
    rows.sort()
    return {n: np.array(c, np.int64) for n, c in zip(("first", "each", "sequence", "offset", "length"), zip(*rows, strict=True), strict=True)} if rows else {}


def number_within_length(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add ``_number``, 0, 1, … over all pieces ordered by length; a length held by many rows is spread over many windows."""
    spark = pieces.sparkSession
    begin, rows = 0, []
    for length in sorted(counts):
        rows.append((length, begin, -(-counts[length] // ROWS_PER_WINDOW)))
        begin += counts[length]
    starts = spark.createDataFrame(rows, "length bigint, _begin bigint, _parts int")  # a row per length at most
    dealt = pieces.join(F.broadcast(starts), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")).cast("int"))
    parts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("length", "_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = dealt.withColumn("_inside", inside).join(parts, ["length", "_part"])
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_begin") + F.col("_before") + F.col("_inside")).alias("_number"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty; an empty text is the end token alone. A row with a null id or repeated rows are packed like any
    other. Very long texts give many full pieces. An empty table gives an empty result. Other columns are not read.
    """
    pieces = written(token_pieces(docs, vocabulary, id_col, text_col, end_id, capacity), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    where = slots(plan(counts, capacity), counts)
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    if not counts:
        return docs.sparkSession.createDataFrame([], out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("_number").to_numpy()
            row = np.searchsorted(where["first"], number, side="right") - 1
            inside = number - where["first"][row]
            each = where["each"][row]
            seq, off = where["sequence"][row] + inside // each, where["offset"][row] + inside % each * where["length"][row]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return number_within_length(pieces, counts).mapInArrow(place, out)


@query("op7_best_fit_packing")
def op7(spark, sf):
    import public_tokenizers

    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
