"""Hard negatives: for every positive of an anchor the best rows of other labels within a score window.

A positive with score ``p`` accepts negatives from ``LOWER`` to ``UPPER`` hundredths of ``p``. The
windows of one anchor overlap, so they are not searched one by one: the upper limits
of its positives, in falling order, cut the scores into disjoint slots. Every row of another label falls
into one slot at most, and of a slot only the best ``NEGATIVES`` rows can ever be answers:
each task keeps these per anchor and slot while it reads its rows, and one grouping merges
the tasks. A positive's window without its lower limit is a slot and all below it, so walking
the slots from the lowest up and keeping the best of what was met gives the answer of every window;
the lower limit cuts the end of that list.

Anchors are searched in blocks of ``BLOCK``, the only thing broadcast (its size is bounded by that
number and the width of a vector); each block reads all rows. A task holds ``BLOCK`` short lists and
``CHUNK`` rows. Every list is complete: nothing is sampled or capped but by rank.

Scores are sums of products of whole numbers, in double precision where that is exact, else in
Python's numbers; a score beyond 64 bits fails the job.

Defined cases: rows with a null label or vector, or a component that is null, NaN or infinite take
no part; an empty vector scores 0 with every row and of two vectors of different width the common
components count; a null id is no anchor and comes last among ties; rows with the
same id are rows of their own, anchors included, and only the very row is not its own positive; an anchor
without positives or a positive without negatives gives no rows; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.words import with_ordinal
from glyphmill.session import settle, settle_measured, ship, spread

POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90  # A negative's score in hundredths of the positive's.
SCALE = 256
BLOCK = 8192  # Anchors searched at a time.
CHUNK = 4096  # Rows compared at a time.
STRIP = 512  # Anchors compared with a chunk at a time.
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max  # Stands for a null id, which comes last.


def prepared(table: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part; settled."""
    rows = table.select(
        F.col(key).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")
    return settle(spread(rows), "vectors")


# --- scores of a chunk --------------------------------------------------------


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, the components scaled and rounded down; filled up with zeros."""
    rows = [np.asarray(v, np.float64) for v in vectors]
    out = np.zeros((len(rows), width))
    for number, row in enumerate(rows):
        out[number, : len(row)] = np.floor(row[:width] * SCALE)
    return out


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers."""
    width = max(anchors.shape[1], 1)
    if not anchors.size or not rows.size or np.abs(anchors).max() * np.abs(rows).max() * width < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (anchors, rows)]
    return (whole[0] @ whole[1].T).astype(np.int64)


def _best(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the places of its ``count`` best allowed scores, ties by place, and which of them exist."""
    size = scores.shape[1]
    low, high = int(scores.min(initial=0)), int(scores.max(initial=0))
    if (max(high, -low) + 1) * (size + 1) < 1 << 62:
        key = np.where(allowed, scores * size + (size - 1 - np.arange(size)), _NONE)
        if size > count:
            places = np.argpartition(key, size - count, axis=1)[:, size - count :]
        else:
            places = np.broadcast_to(np.arange(size), (len(key), size))
        places = np.take_along_axis(places, np.argsort(-np.take_along_axis(key, places, 1), axis=1, kind="stable"), 1)
    else:
        order = np.argsort(~scores, axis=1, kind="stable")
        kept = np.argsort(~np.take_along_axis(allowed, order, 1), axis=1, kind="stable")
        places = np.take_along_axis(order, kept, 1)[:, :count]
    return places, np.take_along_axis(allowed, places, 1)


class Lists:
    """The best rows of every anchor and slot so far: ``scores, ids, rows`` of shape anchors, slots, count."""

    def __init__(self, anchors: int, slots: int, count: int):
        shape = (anchors, slots, count)
        self.scores, self.ids, self.rows = np.full(shape, _NONE), np.full(shape, _LAST), np.full(shape, -1)

    def add(self, lines: slice, slot: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        count = self.scores.shape[2]
        scores = np.concatenate([self.scores[lines, slot], scores], axis=1)
        ids = np.concatenate([self.ids[lines, slot], ids], axis=1)
        rows = np.concatenate([self.rows[lines, slot], rows], axis=1)
        order = np.lexsort((rows, ids, rows < 0, ~scores), axis=1)[:, :count]
        self.scores[lines, slot] = np.take_along_axis(scores, order, 1)
        self.ids[lines, slot] = np.take_along_axis(ids, order, 1)
        self.rows[lines, slot] = np.take_along_axis(rows, order, 1)

    def frame(self, anchors: np.ndarray) -> pd.DataFrame:
        line, slot, place = np.nonzero(self.rows >= 0)
        return pd.DataFrame(
            {"anchor": anchors[line], "slot": slot, "score": self.scores[line, slot, place], "id": self.ids[line, slot, place], "row": self.rows[line, slot, place]}
        )


FOUND = "anchor bigint, slot int, score bigint, id bigint, row bigint"


def search(rows: DataFrame, anchors: pd.DataFrame, limits: np.ndarray | None, count: int, same: bool) -> DataFrame:
    """The best ``count`` rows of every anchor and slot, of its label (``same``) or of other labels.

    ``limits`` has the upper limits of the slots of each anchor, falling; a score belongs to the
    last slot whose limit it keeps. None stands for one slot without a limit.
    """
    width = max((len(v) for v in anchors["vector"]), default=0)
    block = (
        anchors["row"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), _matrix(anchors["vector"], width),
        np.full((len(anchors), 1), _LAST) if limits is None else limits,
    )
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, labels, vectors, upper = shared.value
        slots = upper.shape[1]
        lists = Lists(len(own), slots, count)
        below = np.concatenate([upper[:, 1:], np.full((len(own), 1), _NONE)], axis=1)
        for frame in frames:
            for start in range(0, len(frame), CHUNK):
                part = frame.iloc[start : start + CHUNK]
                ids = part["id"].to_numpy(np.int64)
                order = np.lexsort((part["row"].to_numpy(), ids))
                part, ids = part.iloc[order], ids[order]
                number, label = part["row"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
                theirs = _matrix(part["vector"], width)
                for first in range(0, len(own), STRIP):
                    lines = slice(first, first + STRIP)
                    scores = _products(vectors[lines], theirs)
                    fits = labels[lines, None] == label
                    fits = fits & (own[lines, None] != number) if same else ~fits
                    for slot in range(slots):
                        inside = fits & (scores <= upper[lines, slot, None])
                        if slots > 1:
                            inside &= (scores > below[lines, slot, None]) | (slot == slots - 1)
                        if inside.any():
                            places, exists = _best(scores, inside, count)
                            taken = np.where(exists, np.take_along_axis(scores, places, 1), _NONE)
                            lists.add(lines, slot, taken, np.where(exists, ids[places], _LAST), np.where(exists, number[places], -1))
        found = lists.frame(own)
        if len(found):
            yield found

    scanned = rows.select("row", F.coalesce("vec_id", F.lit(_LAST)).alias("id"), "label", "vector")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    found = scanned.mapInPandas(scan, FOUND).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)
    return found.select("anchor", "slot", "score", F.when(F.col("id") < _LAST, F.col("id")).alias("vec_id"), "row", "place")


# --- slots and windows ----------------------------------------------------------


def slot_limits(positives: dict[int, list[int]], anchors: np.ndarray) -> np.ndarray:
    """Per anchor the upper limits of its positives (scores in falling order), missing ones below every score."""
    out = np.full((len(anchors), POSITIVES), _NONE)
    for line, anchor in enumerate(anchors.tolist()):
        scores = positives.get(anchor, ())
        out[line, : len(scores)] = [UPPER * score // 100 for score in scores]
    return out


def windows(lists: DataFrame, positives: DataFrame) -> DataFrame:
    """The answers of all windows from the lists of the slots.

    ``suffixes`` has, from the lowest slot up, the best rows of a slot and all below it: a slot's scores are
    all above those of the slots below, so a list is the slot's own followed by the list before.
    """
    best = F.struct("place", "score", "vec_id")
    per_slot = lists.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(best)).alias("best"))
    entries = F.map_from_entries(F.collect_list(F.struct("slot", "best")))
    per_anchor = per_slot.groupBy("anchor").agg(entries.alias("slots"))
    empty = F.array().cast("array<struct<place:int,score:bigint,vec_id:bigint>>")

    def climb(done: Column, slot: Column) -> Column:
        own = F.coalesce(F.element_at("slots", slot), empty)
        above = F.slice(F.concat(own, F.coalesce(F.try_element_at(done, F.lit(-1)), empty)), 1, NEGATIVES)
        return F.concat(done, F.array(above))

    falling = F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda k: F.lit(POSITIVES) - k)
    suffixes = F.aggregate(falling, F.array().cast("array<array<struct<place:int,score:bigint,vec_id:bigint>>>"), climb)
    per_anchor = per_anchor.select("anchor", suffixes.alias("suffixes"))
    joined = positives.join(per_anchor, "anchor")
    within = F.element_at("suffixes", F.lit(POSITIVES) - F.col("positive"))
    kept = F.filter(within, lambda n: n["score"] * 100 >= F.col("positive_score") * LOWER)
    rows = joined.select("anchor_id", "positive_id", "positive_score", F.posexplode(kept).alias("at", "negative"))
    return rows.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score"),
    )


def mine(table: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says of ``vec_id`` which rows are anchors, ``label`` is the label of a row.
    """
    spark = table.sparkSession
    ship(spark)
    rows = prepared(table, key, vector, label)
    chosen = rows.filter(F.coalesce(anchors, F.lit(False)))
    numbered = with_ordinal(chosen, "row").withColumn("block", F.floor(F.col("ordinal") / BLOCK))
    numbered, counted = settle_measured(numbered, "anchors", blocks=F.max("block"))
    found = None
    for block in range((-1 if counted["blocks"] is None else counted["blocks"]) + 1):
        frame = numbered.filter(F.col("block") == block).select("row", "vec_id", "label", "vector").toPandas()  # BLOCK rows
        names = numbered.filter(F.col("block") == block).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        near = settle(search(rows, frame, None, POSITIVES, same=True), "positives")
        scores: dict[int, list[int]] = {}
        for anchor, score in near.orderBy("anchor", "place").select("anchor", "score").toPandas().itertuples(index=False):
            scores.setdefault(int(anchor), []).append(int(score))  # POSITIVES of each of BLOCK anchors
        limits = slot_limits(scores, frame["row"].to_numpy(np.int64))
        lists = search(rows, frame, limits, NEGATIVES, same=False)
        positives = near.join(names, "anchor").select(
            "anchor", "anchor_id", (F.col("place") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        answers = settle(windows(lists, positives), "hard-negatives")
        found = answers if found is None else found.unionByName(answers)
    if found is None:
        schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], schema)
    return found
