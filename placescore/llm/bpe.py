"""Byte-level BPE: frequent words are encoded by higher-order functions over a literal rank map, whole texts by their words.

1. Every document is split into words; words are counted over all documents.
2. The most frequent words, at most ``dictionary_words`` of them, are folded by Spark: each starts as an array of single
   bytes and takes one ranked merge per step, the lowest rank first and of equal ones the leftmost.
3. The dictionary, bounded by that parameter, goes to every task, which encodes whole texts by it. Words outside it (rare,
   or too long for a fold of quadratic cost) are merged by the ranks inside the task.
4. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placescore.llm import words
from placescore.llm.common import query, table, written

#: Slots of the literal rank map; a slot holds a handful of pieces, so a look-up does not grow with the vocabulary.
SLOTS = 1 << 16
#: Longest word (bytes) that is folded by Spark.
FOLD_BYTES = 48
_encoders: dict = {}


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: slot by checksum, then a small map from the hexadecimal piece to its rank."""
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids of one word: fold ranked merges over the array of its bytes (shown as hexadecimal pairs)."""

    def rank(piece: Column) -> Column:
        return F.get(ranks, (F.crc32(piece.cast("binary")) % SLOTS).cast("int"))[piece]

    def state(pieces: Column) -> Column:
        n = F.size(pieces)
        return F.struct(pieces.alias("p"), F.zip_with(F.slice(pieces, 1, n - 1), F.slice(pieces, 2, n - 1), lambda a, b: rank(F.concat(a, b))).alias("r"))

    def bound(value: Column, f) -> Column:
        """``f`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def merge(acc: Column, _: Column) -> Column:
        def at(i: Column) -> Column:
            p = acc["p"]
            merged = F.concat(F.slice(p, 1, i - 1), F.array(F.concat(F.get(p, i - 1), F.get(p, i))), F.slice(p, i + 2, F.size(p)))
            return bound(merged, state)

        low = F.array_min(acc["r"])
        return F.when(low.isNull(), acc).otherwise(bound(F.array_position(acc["r"], low).cast("int"), at))

    shown = F.hex(word.cast("binary"))
    n = (F.length(shown) / 2).cast("int")
    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(shown, i * 2 + 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), n), bound(single, state), merge)
    return F.transform(folded["p"], rank)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, summed per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for _, part in words.chunks(texts):
                joined, starts, ends, h, _ = words.split(part)
                _, sample, n = np.unique(h, return_index=True, return_counts=True)
                found = [joined[s:e] for s, e in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words at or above the lowest count at which no more than ``most`` qualify."""
    eighth = F.floor(F.log2("n") * 8).cast("int")  # a histogram of a few hundred rows
    histogram = sorted(((r["e"], r["k"]) for r in counts.groupBy(eighth.alias("e")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, floor = 0, None
    for e, k in histogram:
        total += k
        if total > most:
            break
        floor = e
    return counts.where(eighth >= floor) if floor is not None else counts.limit(0)


def dictionary_of(folded: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words in the order of their hashes, ids per word, all ids) of the folded words: the dictionary's limit bounds them."""
    found = folded.select("word", F.col("ids").cast("array<int>")).toArrow().combine_chunks()
    own = found.column("word").to_pylist()
    keys, order = np.unique(words.hashes(own), return_index=True)  # a word whose hash another one holds is left to the tasks
    ids = found.column("ids").take(pa.array(order)).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) and ids.num_chunks else ids
    if not len(order):
        return [], np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return [own[i] for i in order.tolist()], np.asarray(ids.value_lengths(), np.int64), np.asarray(ids.flatten(), np.uint32)


class TextEncoder:
    """Encodes whole texts by a dictionary of folded words; other words are merged here."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: tuple[list[str], np.ndarray, np.ndarray]):
        import tiktoken

        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = {i: b for b, i in ranks.items()}
        self.shown: list[bytes] = []
        self.bytes: list[bytes] = []

        def note(ids: list[list[int]]) -> list[list[int]]:
            self.shown += [b" ".join(b"%d" % i for i in x) for x in ids]
            self.bytes += [b"".join([self.piece[i] for i in x]) for x in ids]
            return ids

        self.dictionary = words.Dictionary(lambda batch: note([merge._encode_single_piece(w) for w in batch]), limit=600_000)
        found, count, flat = known
        ends = np.cumsum(count).tolist()
        ids = flat.tolist()
        self.dictionary.add(words.hashes(found), np.zeros(len(found), np.int64), found, note([ids[e - n : e] for e, n in zip(ends, count.tolist(), strict=True)]))
        self.dictionary.keep()

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids in decimal, decoded bytes) of each text."""
        for _, part in words.chunks(texts):
            joined, starts, ends, h, bounds = words.split(part)
            before = len(self.dictionary.count)
            slots = self.dictionary.slots(joined, starts, ends, h)
            if len(self.dictionary.count) < before:  # it forgot and began anew
                kept = len(self.dictionary.kept[2])
                self.shown, self.bytes = self.shown[:kept] + self.shown[before:], self.bytes[:kept] + self.bytes[before:]
            lengths = np.concatenate([[0], np.cumsum(self.dictionary.count[slots])])[bounds]
            slots = slots.tolist()
            for i in range(len(part)):
                own = slots[bounds[i] : bounds[i + 1]]
                yield int(lengths[i + 1] - lengths[i]), b" ".join([self.shown[s] for s in own]), b"".join([self.bytes[s] for s in own])


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", dictionary_words: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text is empty; an empty text has no ids. Null ids and repeated rows are encoded like any other row; very long texts
    are encoded whole; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = written(word_counts(docs).where("n > 1"), "bpe-counts")
    short = counts.where(F.octet_length("word") <= FOLD_BYTES)
    chosen = frequent(short, dictionary_words).repartition(spark.sparkContext.defaultParallelism * 4)
    folded = written(chosen.select("word", fold_merges(F.col("word"), rank_map(ranks)).alias("ids")), "bpe-dictionary")
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((ranks, pattern, dictionary_of(folded)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = TextEncoder(*sent.value)
        encoder = _encoders[key]
        for batch in batches:
            n, ids, back = [], [], []
            for count, shown, decoded in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(count)
                ids.append(hashlib.sha256(shown).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def ranks_of(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file of one piece per line; its size is that of a vocabulary."""
    with open(path) as f:
        return read_ranks(f.readlines())


@query("op8_byte_bpe")
def op8(spark, sf):
    import public_tokenizers

    return encode_documents(table(spark, sf, "documents"), ranks_of(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
