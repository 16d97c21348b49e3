"""A linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased (A-Z) and taken as UTF-8 bytes between two blanks. Its
features are the hashed n-grams of 3, 4 and 5 bytes, present or absent. From the
labelled texts every feature gets ``log((p / |p|) / (q / |q|))`` with ``p`` and
``q`` the texts of either label that have it, plus one; the features that tell
the labels apart best are kept, scaled by that ratio, and a logistic regression
is fitted on them. (``|p|`` and ``|q|`` are numbers of texts, the measure of features that are present or absent.)

The fit is a few dozen quasi-Newton steps; each is one pass over the settled features of the sample, in which every
task adds up the loss and gradient of its rows. The driver holds vectors of ``SELECTED`` numbers only.

Bound: at most ``sample_rows`` labelled rows are used to fit, one text for each of the ids with the smallest
hashes (of several texts of an id that with the smallest hash). Scoring reads every whole text; the model it broadcasts has a
fixed size (``DIMENSIONS`` numbers).

Defined cases: a null text is an empty one; a row without a label is not used to
fit; several labels of one id count as their largest; repeated rows are one; among features that tell the labels apart
equally well the smaller number counts; without rows of both
labels every score is 0. A null id is never held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import settle, ship

SIZES = (3, 4, 5)
DIMENSIONS = 1 << 20
SAMPLE_ROWS = 20_000
SELECTED = 8192
LEAST_TEXTS = 4  # Features in fewer labelled texts are not kept.
FIT_TASKS = 8
STEPS = 60  # Quasi-Newton steps at most; they end sooner when the slope is below ``FLAT``.
MEMORY = 10  # Steps whose curvature is remembered.
FLAT = 1e-5
PENALTY = 1e-4
THRESHOLD = 0.7
CHUNK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 20)


def _lowered(text: str | None) -> np.ndarray:
    data = b" " + (text or "").encode("utf-8", "replace") + b" "
    codes = np.frombuffer(data, np.uint8)
    return codes + ((codes >= 65) & (codes <= 90)).astype(np.uint8) * np.uint8(32)


def features(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed n-grams of a piece of text, an array per size."""
    wide = codes.astype(np.uint64)
    gram = wide[:-1] | (wide[1:] << np.uint64(8)) if len(wide) > 1 else wide[:0]
    for size in range(3, max(SIZES) + 1):
        if len(wide) < size:
            return
        gram = gram[: len(wide) - size + 1] | (wide[size - 1 :] << np.uint64(8 * (size - 1)))
        if size in SIZES:
            yield ((gram + np.uint64(size)) * _MULTIPLIER >> _SHIFT).astype(np.int32)


def pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in pieces that share the n-grams at their borders."""
    for start in range(0, max(len(codes) - 2, 1), CHUNK):
        yield codes[start : start + CHUNK + max(SIZES) - 1]


def present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text, of those ``wanted`` only if given."""
    found = []
    for piece in pieces(_lowered(text)):
        for hashed in features(piece):
            found.append(hashed[wanted[hashed]] if wanted is not None else hashed)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


@dataclass
class Model:
    """``weights`` by hashed feature (ratio and regression weight multiplied) and the intercept."""

    weights: np.ndarray
    intercept: float

    @cached_property
    def wanted(self) -> np.ndarray:
        return self.weights != 0

    def score(self, text: str | None) -> float:
        if np.isneginf(self.intercept):
            return 0.0
        value = self.intercept + float(self.weights[present(text, self.wanted)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(value, -500, 500))))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int
) -> DataFrame:
    """``label, text`` of at most ``sample_rows`` labelled rows that are not held out."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("key").agg(F.max("label").alias("label")).filter(~held_out(F.col("key")))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    # The bound on the rows is the bound on what is broadcast. An id in many rows is thinned before the shuffle.
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    one = rows.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
    return settle(one.repartition(FIT_TASKS, "key").select("label", "first.text"), "labelled")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, texts = np.zeros((2, DIMENSIONS), np.int32), np.zeros(2, np.int64)
    for frame in frames:
        for label, text in zip(frame["label"], frame["text"], strict=True):
            counts[int(label > 0), present(text)] += 1
            texts[int(label > 0)] += 1
    packed = [zlib.compress(row.tobytes(), 1) for row in counts]
    yield pd.DataFrame({"negative": packed[:1], "positive": packed[1:], "negatives": texts[:1], "positives": texts[1:]})


def log_ratios(positive: np.ndarray, negative: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    p, q = positive + 1.0, negative + 1.0
    return np.log(p / (positives + 2.0)) - np.log(q / (negatives + 2.0))


def select(positive: np.ndarray, negative: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """The features whose presence differs most between the labels, by the log-likelihood ratio."""
    total, seen = positives + negatives, positive + negative

    def part(count, row, column):
        return np.where(count > 0, count * np.log(np.maximum(count, 1) * total / np.maximum(row * column, 1)), 0.0)

    strength = part(positive, seen, positives) + part(negative, seen, negatives)
    strength += part(positives - positive, total - seen, positives) + part(negatives - negative, total - seen, negatives)
    strength[seen < LEAST_TEXTS] = 0
    best = np.argsort(-strength, kind="stable")[:SELECTED]
    return np.sort(best[strength[best] > 0])


def losses(rows: DataFrame, scale: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed log loss of rows ``label, found`` at ``weights`` (the last is the intercept), and its gradient."""
    shared = rows.sparkSession.sparkContext.broadcast((scale, weights))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale, weights = shared.value
        loss, gradient = 0.0, np.zeros(len(weights))
        scaled = scale * weights[:-1]
        for frame in frames:
            found = [np.frombuffer(value, np.uint16) for value in frame["found"]]
            column, lengths = np.concatenate(found), np.array([len(value) for value in found])
            row = np.repeat(np.arange(len(found)), lengths)
            margin = np.bincount(row, scaled[column], len(found)) + weights[-1]
            sign = np.where(frame["label"].to_numpy() > 0, -1.0, 1.0)
            loss += np.logaddexp(0.0, sign * margin).sum()
            error = sign / (1 + np.exp(np.clip(-sign * margin, -500, 500)))
            gradient[:-1] += np.bincount(column, error[row], len(scale)) * scale
            gradient[-1] += error.sum()
        yield pd.DataFrame({"loss": [loss], "gradient": [gradient.tobytes()]})

    parts = rows.mapInPandas(sums, "loss double, gradient binary").orderBy("loss", "gradient").collect()  # FIT_TASKS rows
    return sum(r.loss for r in parts), np.sum([np.frombuffer(r.gradient) for r in parts], axis=0)


def fit_weights(rows: DataFrame, count: int, positives: int, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ``count`` rows by quasi-Newton steps (limited memory, halved until the loss falls enough)."""

    def measured(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = losses(rows, scale, weights)
        shrunk = np.append(weights[:-1], 0.0)
        return loss / count + PENALTY / 2 * shrunk @ shrunk, gradient / count + PENALTY * shrunk

    weights = np.zeros(len(scale) + 1)
    weights[-1] = np.log((positives + 1) / (count - positives + 1))
    loss, slope = measured(weights)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() <= FLAT:
            break
        direction, kept = -slope, []
        for move, change in reversed(moves):
            share = move @ direction / (change @ move)
            kept.append(share)
            direction = direction - share * change
        direction = direction * (moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1.0)
        for (move, change), share in zip(moves, reversed(kept), strict=True):
            direction = direction + (share - change @ direction / (change @ move)) * move
        fall, size = slope @ direction, 1.0
        while True:
            after = weights + size * direction
            lower, following = measured(after)
            if lower <= loss + 1e-4 * size * fall or size < 1e-6:
                break
            size /= 2
        move, change = after - weights, following - slope
        if change @ move > 1e-12:
            moves = [*moves[-(MEMORY - 1) :], (move, change)]
        if not lower < loss:
            break
        weights, loss, slope = after, lower, following
    return weights[:-1], float(weights[-1])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from the labelled rows; what reaches the driver is bounded by ``DIMENSIONS`` and ``FIT_TASKS``."""
    ship(documents.sparkSession)
    sample = labelled_sample(documents, labels, key, text, label, sample_rows)
    schema = "negative binary, positive binary, negatives bigint, positives bigint"
    positive, negative = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    positives = negatives = 0
    for part in sample.mapInPandas(_count, schema).toLocalIterator():
        positive += np.frombuffer(zlib.decompress(part.positive), np.int32)
        negative += np.frombuffer(zlib.decompress(part.negative), np.int32)
        positives, negatives = positives + part.positives, negatives + part.negatives
    if not positives or not negatives:
        return Model(np.zeros(DIMENSIONS, np.float32), -np.inf)
    chosen = select(positive, negative, positives, negatives)
    number = np.full(DIMENSIONS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))

    def active(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = number >= 0
        for frame in frames:
            found = [number[present(value, wanted)].astype(np.uint16).tobytes() for value in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "found": found})

    rows = settle(sample.mapInPandas(active, "label int, found binary"), "features").coalesce(FIT_TASKS)
    ratios = log_ratios(positive, negative, positives, negatives)[chosen]
    fitted, intercept = fit_weights(rows, positives + negatives, positives, ratios)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[chosen] = fitted * ratios
    return Model(weights, intercept)


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with the model's score of every whole text."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(value) for value in texts], dtype="float64")

    return documents.withColumn(name, scored(F.col(text)))
