import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import toxicity as T

random.seed(2)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(300)]
BAD = ["zorgling", "quaxxo", "vimpish"]


def text(bad):
    words = [random.choice(VOCABULARY) for _ in range(random.randint(20, 200))]
    for _ in range(random.randint(1, 3) if bad else 0):
        words.insert(random.randrange(len(words)), random.choice(BAD))
    return " ".join(words)


def tables(spark, count=900):
    rows = [(k, text(k % 5 == 0), k % 5 == 0) for k in range(count)]
    documents = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(bad)) for k, _, bad in rows], "doc_id bigint, toxic int")
    return documents, labels, {k: bad for k, _, bad in rows}


def test_held_out_accuracy_and_determinism(spark):
    documents, labels, truth = tables(spark)
    model = T.fit(documents, labels)
    scored = T.score(documents, model).select("doc_id", T.held_out(F.col("doc_id")).alias("out"), "score").collect()
    assert all(0 <= r.score <= 1 for r in scored)
    for r in scored:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [(r.score >= T.THRESHOLD) == truth[r.doc_id] for r in scored if r.out]
    assert len(right) > 200 and np.mean(right) > 0.97
    again = T.fit(documents.repartition(5), labels)
    assert np.allclose(again.weights, model.weights)


def test_held_out_labels_are_never_learnt(spark):
    documents, labels, _ = tables(spark, 300)
    model = T.fit(documents, labels)
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(T.fit(documents, turned).weights, model.weights)


def test_the_sample_is_bounded(spark):
    documents, labels, _ = tables(spark, 300)
    sample = T.labelled_sample(documents, labels, "doc_id", "text", "toxic", 50)
    assert sample.count() == 50


def test_an_id_on_many_rows_is_one_of_the_sample(spark):
    documents = spark.createDataFrame([(1, f"text {k % 7}") for k in range(300)] + [(2, "other")] * 5, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    held = {k for k in (1, 2) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert T.labelled_sample(documents, labels, "doc_id", "text", "toxic", 10).count() == 2 - len(held)


def test_scores_against_a_plain_model(spark):
    """Features, ratios, selection and regression said once more over sets of n-grams, on small tables."""
    documents, labels, truth = tables(spark, 400)
    texts = {r.doc_id: r.text for r in documents.collect()}

    def grams(value):
        data = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in value.encode()) + b" "
        whole = [np.frombuffer(data[i : i + n], np.uint8) for n in T.SIZES for i in range(len(data) - n + 1)]
        return {int(list(T.features(g))[-1][0]) for g in whole}

    train = sorted(k for k in texts if zlib.crc32(str(k).encode()) % 3 != 1)
    sets = {k: grams(v) for k, v in texts.items()}
    sides = [[k for k in train if truth[k] == side] for side in (False, True)]
    counts = [{g: 0 for k in train for g in sets[k]} for _ in sides]
    for count, side in zip(counts, sides, strict=True):
        for k in side:
            for g in sets[k]:
                count[g] += 1
    q, p = counts
    strength = {}
    for g in p:
        table = np.array([[q[g], p[g]], [len(sides[0]) - q[g], len(sides[1]) - p[g]]], float)
        expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
        strength[g] = (table * np.log(np.where(table > 0, table / np.maximum(expected, 1e-9), 1))).sum() if p[g] + q[g] >= T.LEAST_TEXTS else 0
    chosen = sorted(sorted((g for g in strength if strength[g] > 1e-9), key=lambda g: (-strength[g], g))[: T.SELECTED])
    ratio = np.array([np.log((p[g] + 1) / (len(sides[1]) + 2)) - np.log((q[g] + 1) / (len(sides[0]) + 2)) for g in chosen])
    x = np.array([[ratio[j] if g in sets[k] else 0.0 for j, g in enumerate(chosen)] for k in train])
    y = np.array([truth[k] for k in train], float)
    model = T.fit(documents, labels)
    kept = np.flatnonzero(model.weights)
    assert len(set(chosen) - set(kept.tolist())) <= 0.02 * len(chosen) + 5
    # The fit is the minimum of the loss: its slope vanishes there.
    w = np.array([model.weights[g] for g in chosen]) / ratio
    error = 1 / (1 + np.exp(-(x @ w + model.intercept))) - y
    slope = np.append(x.T @ error / len(y) + T.PENALTY * w, error.mean())
    assert np.abs(slope).max() < 1e-3
    for k in list(texts)[:50]:
        value = model.intercept + sum(float(model.weights[g]) for g in sets[k])
        assert abs(model.score(texts[k]) - 1 / (1 + np.exp(-value))) < 1e-5


def test_features_are_those_of_a_plain_count():
    value = "Ab é\tAB " * 50
    data = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in value.encode()) + b" "
    grams = {data[i : i + n] for n in T.SIZES for i in range(len(data) - n + 1)}
    assert len(T.present(value)) == len({int(h) for g in grams for f in [T.features(np.frombuffer(g, np.uint8))] for h in [list(f)[-1][0]]})


def test_long_texts_in_pieces(monkeypatch):
    value = " ".join(random.choice(VOCABULARY) for _ in range(3000))
    whole = T.present(value)
    monkeypatch.setattr(T, "CHUNK", 500)
    assert np.array_equal(T.present(value), whole)


def test_ratios_weigh_presence():
    ratios = T.log_ratios(np.array([9, 1]), np.array([1, 9]), 10, 10)
    assert ratios[0] > 1 and ratios[1] == -ratios[0]


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, score int, label string"
    documents = spark.createDataFrame([(None, None, 1, "x"), (1, "", 1, "x"), (2, "zorgling", 1, "x")], schema)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id bigint, toxic int")
    scored = T.score(documents, T.fit(documents, labels))
    assert [r.score for r in scored.collect()] == [0, 0, 0] and scored.columns == documents.columns
    assert T.score(documents.limit(0), T.fit(documents.limit(0), labels.limit(0))).count() == 0
    full, known, _ = tables(spark, 200)
    model = T.fit(full, known)
    assert all(0 <= r.score < T.THRESHOLD for r in T.score(documents.filter("text is null or text = ''"), model).collect())
