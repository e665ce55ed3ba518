"""Hard negatives for many anchors by slot-decomposed selection.

An anchor's positives set upper limits on the score of a negative. The distinct limits, highest first, cut the scores into
disjoint slots: slot j holds what lies at or below limit j and above limit j + 1. A window that ends at limit i is the
slots i, i + 1, … in this order, so the k best of every slot answer all windows, however they overlap: suffixes are merged
from the lowest slot up, and a window takes its suffix down to its own lower limit.

Two passes over the rows, first for positives (a single slot), then for negatives. Rows and anchors are written to shared
files once; a task takes a block of anchors past a group of row files, keeping the k best per anchor and slot, so nothing
is copied per block and what is shuffled is k rows per anchor, slot and file group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm.blocks import CHUNK_ROWS, FILE_ROWS, LEAST, MOST, block_of, by_length, chunks_of, in_blocks, inner_products, row_files, units, usable
from placescore.llm.common import query, table, written

BLOCK_ANCHORS = 512
SCALE = 256


class Best:
    """The k best (score, id) of each anchor and slot: higher scores first, then smaller ids."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.shape = k, (anchors, slots)
        self.anchor, self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(4))
        self.floor, self.floor_id = np.full(self.shape, LEAST - 1), np.full(self.shape, MOST)

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        low = self.floor[anchor, slot]
        better = (score > low) | (score == low) & (ids < self.floor_id[anchor, slot])
        if not better.any():
            return
        anchor, slot, score, ids = (np.concatenate([old, new[better]]) for old, new in ((self.anchor, anchor), (self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot, anchor))
        group = anchor[order] * self.shape[1] + slot[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        order, rank, group = order[rank < self.k], rank[rank < self.k], group[rank < self.k]
        self.anchor, self.slot, self.score, self.id = anchor[order], slot[order], score[order], ids[order]
        last = rank == self.k - 1
        self.floor.flat[group[last]], self.floor_id.flat[group[last]] = self.score[last], self.id[last]


def search(units: DataFrame, folder: str, k: int, limited: bool) -> DataFrame:
    """(a, anchor_id, slot, score, id): per unit (files, block) the k best rows of every anchor and slot.

    Without limits rows of the anchor's label compete in slot 0; with ``limited`` those of other labels compete in the slots of the
    anchor's ``limits``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for files, block in zip(batch.column("files").to_pylist(), batch.column("block").to_pylist(), strict=True):
                asked = block_of(folder, block)
                if asked is None:
                    continue
                ids, labels = (asked.column(c).to_numpy() for c in ("id", "label"))
                if limited:
                    limits = np.full((len(asked), k), LEAST - 1)
                    for i, own in enumerate(asked.column("limits").to_pylist()):
                        limits[i, : len(own)] = own
                    lowest = np.array([own[-1] - own[-1] // 5 for own in asked.column("limits").to_pylist()], np.int64)  # 80 % rounded up
                best = Best(len(asked), k if limited else 1, k)
                groups = {d: (at, m) for d, at, m in by_length(asked.column("v").combine_chunks(), SCALE)}
                for rows in chunks_of(files, ["id", "label", "v"], CHUNK_ROWS):
                    row_ids, row_labels = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                    for d, at, matrix in by_length(rows.column(2), SCALE):
                        if d not in groups:
                            continue
                        mine, left = groups[d]
                        score = inner_products(left, matrix)
                        same = labels[mine][:, None] == row_labels[at][None, :]
                        if limited:
                            fits = ~same & (score <= limits[mine, :1]) & (score >= lowest[mine][:, None])
                        else:
                            fits = same & (ids[mine][:, None] != row_ids[at][None, :]) & (score >= best.floor[mine])
                        x, y = np.nonzero(fits)
                        found, anchor = score[x, y], mine[x]
                        slot = (limits[anchor] >= found[:, None]).sum(axis=1) - 1 if limited else np.zeros(len(x), np.int64)
                        best.add(anchor, slot, found, row_ids[at][y])
                keys = asked.column("a").take(pa.array(best.anchor)).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids[best.anchor]), pa.array(best.slot.astype(np.int32)), pa.array(best.score), pa.array(best.id)], names=["a", "anchor_id", "slot", "score", "id"])

    return units.mapInArrow(task, "a string, anchor_id bigint, slot int, score bigint, id bigint")


def best_of(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot over all units, numbered from 1."""
    w = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suffix_merged(slots: Column, k: int) -> Column:
    """Of slots in descending order: the k best of each slot and all below it."""

    def step(acc: Column, x: Column) -> Column:
        below = F.coalesce(F.try_element_at(acc, F.lit(-1))["best"], F.array().cast("array<struct<score:bigint,id:bigint>>"))
        return F.concat(acc, F.array(F.struct(x["slot"].alias("slot"), F.slice(F.concat(x["best"], below), 1, k).alias("best"))))

    return F.aggregate(slots, F.array().cast("array<struct<slot:int,best:array<struct<score:bigint,id:bigint>>>>"), step)


def mine(
    vectors: DataFrame,
    k: int = 5,
    positives: int = 5,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by ``every``.

    Negatives of a positive are the ``k`` best rows of another label with 80 to 100 % of its score. Rows with a null id, label
    or vector, an empty vector or a null or non-finite component take no part; vectors of another length than the anchor's
    neither. Ties go to the smaller id. Rows repeated with an id are candidates each, but never for their own id; an anchor
    repeated with all its values is asked once. Scores beyond 64 bits stop at its ends. A positive with a negative score has
    no negatives. An empty table gives an empty result; other columns are not read.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = row_files(own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))), "mine-rows", FILE_ROWS)
    asked = written(rows.where(F.col("id") % every == 0).withColumn("a", F.sha2(F.to_json(F.struct("id", "label", "v")), 256)).dropDuplicates(["a"]), "mine-anchors")
    blocks = max(1, -(-asked.count() // BLOCK_ANCHORS))
    pairs = units(rows, blocks)
    near = written(best_of(search(pairs, in_blocks(asked, blocks, "mine-blocks"), positives, False), positives), "mine-positives")
    limits = near.where("score >= 0").groupBy("a").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    limited = in_blocks(asked.join(limits, "a"), blocks, "mine-limits")
    negatives = best_of(search(pairs, limited, max(k, positives), True), k)
    return windows(near, negatives, k)


def windows(near: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """Every positive's window from the slots of its anchor."""
    slots = negatives.groupBy("a", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    slots = slots.select("a", "slot", F.transform("best", lambda x: F.struct((-x["s"]).alias("score"), x["id"].alias("id"))).alias("best"))
    merged = slots.groupBy("a").agg(suffix_merged(F.sort_array(F.collect_list(F.struct("slot", "best")), asc=False), k).alias("suffixes"))
    limits = Window.partitionBy("a").orderBy(F.col("score").desc())
    asked = near.where("score >= 0").withColumn("own", F.dense_rank().over(limits) - 1)
    joined = asked.join(merged, "a").withColumn("suffix", F.try_element_at(F.filter("suffixes", lambda x: x["slot"] >= F.col("own")), F.lit(-1))["best"])
    least = F.col("score") - F.expr("score div 5")
    found = joined.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(F.filter("suffix", lambda x: x["score"] >= least)))
    return found.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col")["id"].alias("negative_id"), "positive_score", F.col("col")["score"].alias("negative_score"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", SQL)
def op11(spark, sf):
    rows = table(spark, sf, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy))
