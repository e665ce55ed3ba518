"""Exact top-k inner product by MaxScore over shards of vectors.

Every dimension is a query term whose posting list is the dimension's column in a shard. From the shard's extremes each
term has a score bound; the terms whose bounds together stay below what a candidate still needs for the k-th best score are
non-essential. Essential terms are traversed for the whole shard, the others are probed only for candidates that can still
reach that score, which goes on from shard to shard. Shards are row files on shared storage; a task takes a block of
queries past a group of them, and the results of the groups are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm.blocks import block_of, by_length, chunks_of, in_blocks, inner_products, row_files, units, usable
from placescore.llm.common import query, table, written

#: Rows of a shard, shards in a file, queries in a block, terms probed at once.
SHARD_ROWS, SHARDS, QUERY_ROWS, STEP = 4_096, 48, 512, 8
SCALE = 1024


def max_score(shard: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: int | None, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of a shard for one query; ties to the smaller id; rows of ``own`` id take no part.

    ``shard`` has a row per dimension (posting list), ``floor`` is a score below which no row is wanted.
    """
    ends = asked[:, None] * np.stack([shard.min(axis=1), shard.max(axis=1)], axis=1)
    least, bound = ends.min(axis=1), ends.max(axis=1)
    order = np.argsort(least - bound, kind="stable")  # widest spread first
    above = np.concatenate([np.cumsum((bound - least)[order][::-1])[::-1], [0]])  # what terms from here on add at most to their least
    base = np.concatenate([np.cumsum(least[order][::-1])[::-1], [0]])  # what they add at least
    alive = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
    # essential: without them a row has no more than the least of all terms and the spreads of the others
    split = len(order) if floor is None or base[0] >= floor else int(np.argmax(base[0] + above < floor))
    partial = asked[order[:split]] @ shard[order[:split]][:, alive]
    for first in range(split, len(order), STEP):
        low = floor
        if len(alive) > k:  # the k-th best of what the candidates reach at the least
            kth = np.partition(partial, len(partial) - k)[len(partial) - k] + base[first]
            low = kth if low is None else max(low, kth)
        if low is not None:
            keep = partial + base[first] + above[first] >= low
            alive, partial = alive[keep], partial[keep]
        terms = order[first : first + STEP]
        partial = partial + asked[terms] @ shard[terms][:, alive]
    if floor is not None:
        alive, partial = alive[partial >= floor], partial[partial >= floor]
    best = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive][best], partial[best]


def exact(shard: np.ndarray, asked: np.ndarray) -> bool:
    """Whether doubles hold every sum of products."""
    return float(np.abs(shard).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(len(asked), 1) < 2**52


class Found:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores.astype(np.int64)])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]


def search(pairs: DataFrame, folder: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best per query and unit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for files, block in zip(batch.column("files").to_pylist(), batch.column("block").to_pylist(), strict=True):
                asked = block_of(folder, block)
                if asked is None:
                    continue
                query_ids = asked.column("id").to_numpy()
                found = [Found(k) for _ in query_ids]
                groups = {d: (at, m) for d, at, m in by_length(asked.column("v").combine_chunks(), SCALE)}
                for rows in chunks_of(files, ["id", "v"], SHARD_ROWS):
                    row_ids = rows.column(0).to_numpy()
                    for d, at, matrix in by_length(rows.column(1), SCALE):
                        if d not in groups:
                            continue
                        mine, vectors = groups[d]
                        by_id = np.argsort(row_ids[at], kind="stable")
                        ids, matrix = row_ids[at][by_id], matrix[by_id]
                        shard = np.ascontiguousarray(matrix.T)
                        for q, v in zip(mine.tolist(), vectors, strict=True):
                            if exact(shard, v):
                                found[q].add(*max_score(shard, ids, v, int(query_ids[q]), k, found[q].floor))
                            else:
                                other = ids != query_ids[q]
                                found[q].add(ids[other], inner_products(v[None, :], matrix[other])[0])
                counts = [len(f.ids) for f in found]
                columns = [np.repeat(query_ids, counts), np.concatenate([f.ids for f in found]), np.concatenate([f.scores for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(task, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id is divisible by ``every``.

    Components are floor(1024 * x); the score is the integer inner product, ties go to the smaller id. Vectors that are
    null or empty, hold null or non-finite components, have a null id or another length than the query take no part in it. Rows repeated
    with an id are candidates each, but never of their own id; a query repeated with its vector is asked once, and queries of
    one id share its k answers. Scores beyond 64 bits stop at its ends. An empty table gives an empty result; other columns are
    not read.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = row_files(own.where(F.col("id").isNotNull() & usable(F.col("v"))), "topk-rows", SHARD_ROWS * SHARDS)
    asked = written(rows.where(F.col("id") % every == 0).distinct().withColumn("a", F.col("id").cast("string")), "topk-queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    partial = search(units(rows, blocks), in_blocks(asked, blocks, "topk-blocks"), k)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op6_top_k", SQL)
def op6(spark, sf):
    return top_k(table(spark, sf, "embeddings"))
