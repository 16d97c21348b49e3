import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import mixing as M

random.seed(3)
LETTERS = {"de": "abcdefghiäöüß", "fr": "abcdefghiéèçà", "en": "abcdefghiwkwk"}


def text(lang, poor):
    words = ["".join(random.choice(LETTERS[lang]) for _ in range(random.randint(2, 7))) for _ in range(random.randint(30, 120))]
    return " ".join(w + random.choice(["%%%", "###"]) if poor and random.random() < 0.7 else w for w in words)


def tables(spark, count=600):
    rows = [(k, text(lang := "de fr en en".split()[k % 4], k % 5 == 0), f"{lang}-{'poor' if k % 5 == 0 else 'good'}") for k in range(count)]
    documents = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labelled = spark.createDataFrame([(k, d) for k, _, d in rows if k % 3], "doc_id bigint, domain string")
    return rows, documents, labelled


TARGETS = {"de-good": 0.3, "fr-good": 0.3, "en-good": 0.3, "en-poor": 0.05, "de-poor": 0.03, "fr-poor": 0.02, "nowhere": 4.0}


def test_posteriors_and_rates_against_plain_arithmetic(spark):
    rows, documents, labelled = tables(spark)
    mixed, names = M.mix(documents, labelled, TARGETS)
    out = {r.doc_id: r for r in mixed.select("row.doc_id", "tokens", "p", "rate").collect()}
    assert names == sorted(names) and len(out) == 600
    rates = {k: [len(re.findall(p.replace(r"\p{Lu}", "[A-Z]"), t)) / max(len(t), 1) for p in M.RATES.values()] for k, t, _ in rows}
    logs = {}
    for d in names:
        own = np.array([rates[k] for k, _, domain in rows if k % 3 and domain == d])
        mean, variance = own.mean(axis=0), np.maximum(own.var(axis=0), M.LEAST_SPREAD**2)
        logs[d] = (math.log(len(own)), mean, variance)
    for k, t, domain in rows:
        x = np.array(rates[k])
        score = np.array([p - ((x - m) ** 2 / (2 * v) + 0.5 * np.log(v)).sum() for p, m, v in logs.values()])
        wanted = np.exp(score - score.max())
        assert np.allclose(out[k].p, wanted / wanted.sum(), atol=1e-9)
        assert out[k].tokens == len(t.split()) and out[k].rate >= 0
    right = np.mean([names[int(np.argmax(out[k].p))] == domain for k, _, domain in rows if not k % 3])
    assert right > 0.95
    # The expected tokens of every domain meet the targets.
    tokens, p, rate = (np.array([getattr(out[k], c) for k, *_ in rows]) for c in ("tokens", "p", "rate"))
    share = (rate * tokens) @ p / tokens.sum()
    asked = np.array([TARGETS[d] for d in names])
    assert np.allclose(share, asked / asked.sum(), atol=1e-4)
    # One projected step less is the plain recurrence.
    have, w = tokens @ p, np.ones(len(rows))
    for _ in range(M.STEPS):
        error = (w * tokens) @ p - tokens.sum() * asked / asked.sum()
        if np.abs(error).max() <= M.TOLERANCE * tokens.sum():
            break
        w = np.maximum(0, w - p @ (error / have))
    assert np.allclose(w, rate, atol=1e-6)


def test_unreachable_targets_stay_nonnegative(spark):
    _, documents, labelled = tables(spark, 200)
    mixed, names = M.mix(documents, labelled, {"en-good": 1.0})
    rows = mixed.select("p", "rate").collect()
    assert min(r.rate for r in rows) == 0 and all(r.rate > 1 for r in rows if r.p[names.index("en-good")] > 0.999)


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, tokens string, p int, rate int, row string"
    documents = spark.createDataFrame([(1, None, "x", 1, 1, "r"), (2, "", "x", 1, 1, "r"), (None, "é è", "x", 1, 1, "r")], schema)
    none = spark.createDataFrame([(1, None), (None, "a")], "doc_id bigint, domain string")
    mixed, names = M.mix(documents, none, {"a": 1.0})
    assert names == [] and [r.rate for r in mixed.collect()] == [1.0] * 3
    some = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id bigint, domain string")
    mixed, names = M.mix(documents, some, {"a": 1.0, "b": 1.0})
    rows = mixed.select("row.text", "tokens", "p", "rate", "row.row").collect()
    assert names == ["a", "b"] and all(abs(sum(r.p) - 1) < 1e-12 and r.row == "r" for r in rows)
    assert [r.p for r in rows if not r.tokens] == [[0.5, 0.5]] * 2
    assert M.mix(documents.limit(0), some, {"a": 1.0})[0].count() == 0


def test_no_python_on_the_main_path(spark):
    _, documents, labelled = tables(spark, 50)
    plan = M.mix(documents, labelled, TARGETS)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert F is not None
