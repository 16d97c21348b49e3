import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """Rows in input order are rows of their own, whatever their ids."""
    taken = [
        (vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label)
        for vec_id, vector, label in rows
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)
    ]
    out = []

    def order(row):
        return -row[0], row[1] is None, row[1] or 0

    for number, (anchor, vector, label) in enumerate(taken):
        if anchor is None or anchor % 10:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), i, lab) for k, (i, v, lab) in enumerate(taken) if k != number]
        for p, positive, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            inside = [r for r in scored if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p]
            for rank, (n, negative, _) in enumerate(sorted(inside, key=order)[:10], 1):
                out.append((anchor, positive, rank, negative, p, n))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, parts=5):
    table = spark.createDataFrame(rows, schema).repartition(parts)
    out = H.mine(table, F.col("vec_id") % 10 == 0, F.col("label"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.select(*columns).collect()), key=str)


def vectors(count, width=6, labels=4, seed=1):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(k, [c + rng.gauss(0, 1) for c in centre[rng.randrange(labels)]], rng.randrange(labels)) for k in range(count)]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = vectors(300, seed=seed)
    assert brute(rows) and found(spark, rows) == brute(rows)


def test_blocks_chunks_and_strips(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("CHUNK", 16), ("STRIP", 3)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(200, labels=3, seed=5)
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (20, None, 1), (30, [1.0, nan], 1), (40, [1.0, inf], 1), (50, [None, 1.0], 1), (60, [1.0, 1.0], None),
        (70, [], 1), (80, [1.0, 0.5, 0.25, 3.0, 1.0, 1.0, 9.0], 1), (None, [0.7, 0.2, 0.4, 0.1, 0.3, 0.2], 2), (90, [1.0], 3),
    ]
    ties = [(k, [0.5, 0.5, 0.25, 0.0, 0.0, 0.25], k % 3) for k in range(100, 160)]
    rows = vectors(60, seed=9) + odd + ties
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(10, [1.0], 1)]) == []


def test_rows_with_one_id_and_clashing_columns(spark):
    rows = [(r[0] % 40, *r[1:]) for r in vectors(90, labels=2, seed=3)]
    # Of two equal rows either may stand for the id, so only ids and scores are compared.
    assert found(spark, rows) == brute(rows)
    wide = [(*r, 1, 2, "x") for r in rows]
    assert found(spark, wide, SCHEMA + ", row int, anchor int, slot string") == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**20 + k % 7), float(2**18 - k)], k % 3) for k in range(60)]
    assert found(spark, rows) == brute(rows)
    big = np.array([[2.0**30, 3.0], [1.0, 2.0**29]])
    far = [(k, [1e25 if k < 3 else 1.0, 1.0], k % 2) for k in range(0, 60, 5)]
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        found(spark, far)
    assert H._products(big, big).tolist() == [[2**60 + 9, 2**30 + 3 * 2**29], [2**30 + 3 * 2**29, 2**58 + 1]]


def test_best_falls_back_for_wide_scores():
    scores = np.array([[5, 2**61, 2**61, -(2**61), 7]])
    places, exists = H._best(scores, np.array([[True, True, True, True, False]]), 3)
    assert places.tolist() == [[1, 2, 0]] and exists.all()


def test_limits_fall_and_negative_scores_round_down():
    limits = H.slot_limits({3: [10, 9, -5]}, np.array([3, 4]))
    assert limits[0].tolist() == [9, 8, -5, H._NONE, H._NONE] and (limits[1] == H._NONE).all()
