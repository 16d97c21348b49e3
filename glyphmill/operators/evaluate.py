"""Classification scores of embeddings: few-shot experiments and their metrics.

The classifiers are linear: a vector has a score for each label of an experiment and the best
score wins. Their weights are labels times width in size, so they are handled in blocks
of a bounded size, and a table of any size meets a block in its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.vectors import norm
from glyphmill.operators.words import with_ordinal
from glyphmill.session import BROADCAST_BYTES, bounded, settle, settle_measured, ship

# Fixed value: experiments of a benchmark run.
EXPERIMENTS = 10

# The order in which an experiment looks at the rows of a label: two multiplications modulo a
# prime, so that neighbouring keys come far apart and every experiment has an order of its own.
PRIME, SHIFT, FIRST, SECOND, STEP = 2147483647, 7919, 48271, 69621, 1009


def few_shot(
    labelled: DataFrame, key: str, label: str = "label", experiments: int = EXPERIMENTS, per_label: int = 8
) -> DataFrame:
    """``per_label`` rows of each label for each experiment: ``(experiment, key, label)``.

    The order is an integer mix of key and experiment, so every run and every
    engine draws the same rows. Spark keeps the first ``per_label`` rows of a
    label per task before it shuffles, so a frequent label is no hot spot.
    """
    drawn = labelled.select(F.explode(F.sequence(F.lit(0), F.lit(experiments - 1))).alias("experiment"), key, label)
    experiment = F.col("experiment").cast("bigint")
    shifted = F.pmod(F.col(key).cast("bigint"), F.lit(PRIME)) + (experiment + 1) * SHIFT
    mix = (shifted * FIRST) % PRIME * (experiment * STEP + SECOND) % PRIME
    order = Window.partitionBy("experiment", label).orderBy(mix, key)
    ranked = drawn.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= per_label).drop("rank")


def _few(drawn: DataFrame, key: str) -> DataFrame:
    """The drawn rows as a side to join a whole table with: it is not shuffled while they are few."""
    return bounded(drawn.select("experiment", key), "drawn", F.lit(64))


def centroids(labelled: DataFrame, drawn: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of the drawn rows: ``(experiment, label, centroid)``."""
    values = labelled.select(key, "label", vector).join(_few(drawn, key), key).select(
        "experiment", "label", F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "value")
    )
    means = values.groupBy("experiment", "label", "pos").agg(F.avg("value").alias("value"))
    packed = means.groupBy("experiment", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("values"))
    return packed.select("experiment", "label", F.transform("values", lambda v: v["value"]).alias("centroid"))


@dataclass(frozen=True)
class Block:
    """Linear classifiers, or some labels of them: ``weights[k]`` scores the label ``labels[k]`` of ``experiments[k]``."""

    experiments: np.ndarray
    labels: pa.Array
    weights: np.ndarray  # with one more column than a vector is wide if there is a bias

    @staticmethod
    def of(rows: pa.Table, weights: str) -> Block:
        """From rows ``experiment, label, weights``, by experiment and then by label."""
        table = rows.sort_by([("experiment", "ascending"), ("label", "ascending")]).combine_chunks()
        widths = set(np.diff(table[weights].chunk(0).offsets.to_numpy())) if len(table) else {0}
        if len(widths) > 1:
            raise ValueError(f"classifiers of different widths: {sorted(widths)}")
        flat = table[weights].chunk(0).flatten().to_numpy() if len(table) else np.empty(0)
        label = table["label"].chunk(0) if len(table) else pa.array([], table.schema.field("label").type)
        return Block(table["experiment"].to_numpy(), label, flat.reshape(len(table), -1))


def _dense(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows, and which of them have the width and no null; the others are zero."""
    rows = np.zeros((len(vectors), width))
    fits = np.zeros(len(vectors), bool)
    for number, vector in enumerate(vectors):
        values = vector.values
        if values is not None and len(values) == width and not values.null_count:
            rows[number], fits[number] = values.to_numpy(), True
    return rows, fits


def _answers(rows: DataFrame, block: Block, key: str, bias: bool) -> DataFrame:
    """``experiment, key, label, prediction, score``: the best label of the block for each row and experiment.

    Of equal scores the smallest label counts; a vector that is null, holds nulls or has another width gets none.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(block)
    kind = rows.schema["label"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        first = np.flatnonzero(np.append(True, block.experiments[1:] != block.experiments[:-1])) if len(block.experiments) else []
        for batch in batches:
            vectors, fits = _dense(batch.column("vector"), block.weights.shape[1] - bias)
            if bias:
                vectors = np.concatenate([vectors, np.ones((len(vectors), 1))], axis=1)
            # Not by a matrix library: equal weights must give equal scores wherever they stand.
            scores = np.einsum("ij,kj->ik", vectors, block.weights)
            scores[np.isnan(scores)] = -np.inf
            for low, high in zip(first, [*first[1:], len(block.experiments)], strict=True):
                place = scores[:, low:high].argmax(axis=1) + low
                answer = pa.array(place, mask=~fits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(vectors), block.experiments[low], np.int32)), batch.column(key), batch.column("label"),
                        block.labels.take(answer), pa.array(scores[np.arange(len(vectors)), place], mask=~fits),
                    ],
                    names=["experiment", key, "label", "prediction", "score"],
                )

    schema = f"experiment int, `{key}` {rows.schema[key].dataType.simpleString()}, label {kind}, prediction {kind}, score double"
    return rows.mapInArrow(score, schema)


def _predict(labelled: DataFrame, blocks: list[Block], key: str, vector: str, bias: bool) -> DataFrame:
    """The best label over all blocks. One block is complete in itself; several leave a row's best of each, merged by key."""
    rows = labelled.select(key, "label", F.col(vector).cast("array<double>").alias("vector"))
    answers = reduce(DataFrame.unionByName, (_answers(rows, block, key, bias) for block in blocks))
    if len(blocks) == 1:
        return answers.drop("score")
    best = answers.groupBy("experiment", key, "label").agg(F.min(F.struct((-F.col("score")).alias("score"), "prediction")).alias("best"))
    return best.select("experiment", key, "label", F.col("best.prediction").alias("prediction"))


def nearest_centroid(
    labelled: DataFrame, centroid_table: DataFrame, key: str, vector: str = "embedding", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Predict the label whose centroid has the highest cosine: ``(experiment, key, label, prediction)``.

    Centroids are numbered and taken in blocks of ``limit`` bytes, one centroid at least; only a block is ever in
    one place. The table is read once for each block and never shuffled by experiment.
    """
    # A centroid without length has the cosine 0 with everything.
    scaled = centroid_table.withColumn("length", norm(F.col("centroid"))).select(
        F.col("experiment").cast("int").alias("experiment"),
        "label",
        F.transform("centroid", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0)).alias("unit"),
    )
    units, measured = settle_measured(scaled, "centroids", rows=F.count(F.lit(1)), widest=F.max(F.size("unit") * 8 + 48))
    size = max(limit // max(measured["widest"] or 1, 1), 1)
    if measured["rows"] <= size:
        parts = [units]
    else:
        numbered = settle(with_ordinal(units, "experiment", "label"), "centroids")
        parts = [numbered.filter(F.floor(F.col("ordinal") / size) == k).drop("ordinal") for k in range(-(-measured["rows"] // size))]
    return _predict(labelled, [Block.of(part.toArrow(), "unit") for part in parts], key, vector, bias=False)


def held_out(predictions: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """The predictions of rows that their experiment was not trained on."""
    return predictions.join(_few(drawn, key), ["experiment", key], "left_anti")


def _gradients(training: DataFrame, block: Block) -> np.ndarray:
    """The gradients of the losses of all experiments: one pass over the training rows, one aggregation by weight."""
    shared = training.sparkSession.sparkContext.broadcast(block)
    shape = block.weights.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = shared.value, None
        for batch in batches:
            vectors = _dense(batch.column("vector"), shape[1])[0]
            total = np.zeros(shape) if total is None else total
            experiments = batch.column("experiment").to_numpy()
            for experiment in np.unique(experiments):
                mine = np.flatnonzero(block.experiments == experiment)
                if not len(mine):
                    continue
                rows = np.flatnonzero(experiments == experiment)
                scores = vectors[rows] @ block.weights[mine].T
                parts = np.exp(scores - scores.max(axis=1, keepdims=True))
                parts /= parts.sum(axis=1, keepdims=True)
                own = batch.column("place").to_numpy()[rows]
                parts[np.arange(len(rows)), own] -= 1.0
                total[mine] += parts.T @ vectors[rows]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    summed = training.mapInArrow(sums, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out.ravel()[summed["at"].to_numpy()] = summed["value"].to_numpy()
    return out


def linear_probe(
    labelled: DataFrame,
    drawn: DataFrame,
    key: str,
    vector: str = "embedding",
    iterations: int = 30,
    penalty: float = 1.0,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Logistic regression on the drawn rows of each experiment, applied to all rows: ``(experiment, key, label, prediction)``.

    All experiments are fitted together: ``iterations`` accelerated gradient steps from zero on the sum of the log losses
    plus ``penalty / 2`` times the squared weights (not the bias), each step one pass over the drawn rows. The step is the
    inverse of a bound of the curvature, half the sum of the squared lengths of an experiment's rows (with a 1 for
    the bias) plus the penalty, so every step but the accelerations' swing goes downhill. Weights of more than ``limit`` bytes are fitted in
    groups of experiments. Rows whose vector is null or not of the usual width train nothing.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(key, "label", F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))).alias("vector"))
    usual = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    joined = rows.filter(usual & F.col("label").isNotNull()).join(_few(drawn, key), key)
    labels = Window.partitionBy("experiment").orderBy("label")
    training = settle(joined.select(F.col("experiment").cast("int").alias("experiment"), "label", "vector"), "training")
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    facts = settle(
        training.groupBy("experiment", "label").agg(F.sum(squares).alias("squares"), F.max(F.size("vector")).alias("width")), "labels"
    )
    known = facts.withColumn("place", F.dense_rank().over(labels) - 1)
    width = facts.agg(F.max("width")).head()[0] or 1
    # Dealt by label, since a sample of few rows a label is small: as many pieces as its size asks for.
    training = settle(
        training.filter(F.size("vector") == width).join(F.broadcast(known.select("experiment", "label", "place")), ["experiment", "label"])
        .select("experiment", "place", "vector").repartition("experiment", "place"), "training",
    )
    classes = facts.select("experiment", "label", "squares").toArrow().sort_by([("experiment", "ascending"), ("label", "ascending")])
    experiments = classes["experiment"].to_numpy()
    groups: list[list[int]] = []
    for experiment in np.unique(experiments).tolist():
        size = (experiments == experiment).sum() * width * 8
        if not groups or sum((experiments == e).sum() for e in groups[-1]) * width * 8 + size > limit:
            groups.append([])
        groups[-1].append(experiment)
    blocks = []
    for group in groups:
        mine = classes.filter(pa.array(np.isin(experiments, group))).combine_chunks()
        own = mine["experiment"].to_numpy()
        bound = np.array([0.5 * mine["squares"].to_numpy()[own == e].sum() + penalty for e in own])
        part = training.filter(F.col("experiment").isin(group)) if len(groups) > 1 else training
        shrink = np.full(width, penalty)
        shrink[-1] = 0.0
        weights = before = np.zeros((len(own), width))
        label = mine["label"].chunk(0)
        for step in range(iterations):
            ahead = weights + step / (step + 3) * (weights - before)
            gradient = _gradients(part, Block(own, label, ahead)) + shrink * ahead
            weights, before = ahead - gradient / bound[:, None], weights
        blocks.append(Block(own, label, weights))
    if not blocks:
        return labelled.select(F.lit(0).alias("experiment"), key, "label", F.col("label").alias("prediction")).limit(0)
    return _predict(labelled, blocks, key, vector, bias=True)


def label_scores(predictions: DataFrame) -> DataFrame:
    """Per experiment and label: ``support``, ``predicted``, ``hits`` and ``f1``.

    Predictions are first counted per pair of labels; only those counts move.
    """
    counted = predictions.groupBy("experiment", "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("label"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")),
    )
    per_label = (
        counted.select("experiment", F.explode(sides).alias("side"))
        .groupBy("experiment", F.col("side.label").alias("label"))
        .agg(
            F.sum("side.support").alias("support"),
            F.sum("side.predicted").alias("predicted"),
            F.sum("side.hits").alias("hits"),
        )
    )
    # Neither count can be zero for both sides, so the quotient is always defined.
    return per_label.withColumn("f1", 2 * F.col("hits") / (F.col("support") + F.col("predicted")))


def experiment_scores(predictions: DataFrame) -> DataFrame:
    """``(experiment, accuracy, f1, f1_weighted)``; ``f1`` is the plain mean over labels."""
    return (
        label_scores(predictions)
        .groupBy("experiment")
        .agg(
            (F.sum("hits") / F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("f1"),
            (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        )
    )


def summary(scores: DataFrame) -> DataFrame:
    """Means over the experiments; the main score is the mean accuracy."""
    means = [F.avg(name).alias(name) for name in ("accuracy", "f1", "f1_weighted")]
    return scores.agg(*means).withColumn("main_score", F.col("accuracy"))


def score_report(scores: DataFrame, task: str, subset: str = "default", languages: tuple[str, ...] = ()) -> DataFrame:
    """One nested row: the task, the scores of every experiment and their means."""
    each = F.sort_array(F.collect_list(F.struct("experiment", "accuracy", "f1", "f1_weighted")))
    means = [F.avg(name).alias(name) for name in ("accuracy", "f1", "f1_weighted")]
    row = scores.agg(*means, each.alias("each"))
    test = F.struct(
        "accuracy",
        "f1",
        "f1_weighted",
        F.transform("each", lambda s: F.struct(s["accuracy"].alias("accuracy"), s["f1"].alias("f1"), s["f1_weighted"].alias("f1_weighted"))).alias("scores_per_experiment"),
        F.col("accuracy").alias("main_score"),
        F.lit(subset).alias("hf_subset"),
        F.array(*[F.lit(name) for name in languages]).cast("array<string>").alias("languages"),
    )
    return row.select(F.lit(task).alias("task_name"), F.struct(F.array(test).alias("test")).alias("scores"))
