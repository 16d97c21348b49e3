import random
import re

import numpy as np
import pytest

from glyphmill.llm import overlap_join as J
from glyphmill.llm.components import components

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghijk") for _ in range(random.randint(1, 6))) for _ in range(3000)]


def sentence(count):
    return [random.choice(VOCABULARY) for _ in range(count)]


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 80 * (len(a) + len(sets[j]) - shared):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in range(len(texts))}


def classes(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(rows).collect()}


def changed(words, places):
    return [random.choice(VOCABULARY) if k in places else w for k, w in enumerate(words)]


def corpus():
    passage, texts = sentence(40), []
    for _ in range(12):
        base = sentence(random.randint(6, 90))
        for _ in range(random.randint(1, 6)):
            texts.append(" ".join(changed(base, {random.randrange(len(base)) for _ in range(random.randint(0, 3))})))
        texts.append(" ".join(sentence(20) + passage + sentence(random.randint(0, 20))))
    return [*texts, None, "", " \t\n", "a", "A", "a b", "a  b", "é è", "É è", "a b c d e", "a b c d e"]


def test_against_brute_force(spark):
    texts = corpus()
    assert classes(spark, texts) == brute(texts)


def test_long_lists_and_hot_shingles(spark, monkeypatch):
    """Near copies whose common shingles are in long lists: some link only by way of others."""
    monkeypatch.setattr(J, "SHORT", 3)
    monkeypatch.setattr(J, "HOT", 6)
    base, texts = sentence(70), []
    for k in range(60):
        texts.append(" ".join(changed(base, {random.randrange(70) for _ in range(1 + k % 4)})))
    texts += [" ".join(sentence(10) + base[:40]) for _ in range(20)]
    assert classes(spark, texts) == brute(texts)
    assert classes(spark, texts + [" ".join(base)]) == brute(texts + [" ".join(base)])


def test_probe_stops_at_the_right_answer():
    for _ in range(200):
        a = np.unique(np.random.randint(0, 700, 600))
        b = np.unique(np.concatenate([a[np.random.rand(len(a)) < 0.95], np.random.randint(0, 700, 40)]))
        shared = len(np.intersect1d(a, b))
        assert J.linked(a, b) == (100 * shared >= 80 * (len(a) + len(b) - shared))


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, n int, node string, found double"
    assert J.classes(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(sentence(30))
    rows = [(4, text, 1, "x", 0.0), (4, text, 1, "x", 0.0), (2, text, 1, "x", 0.0), (None, text, 1, "x", 0.0), (None, None, 1, "x", 0.0)]
    found = J.classes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in found) == [
        (-1, 0, -1), (-1, 26, 2), (2, 26, 2), (4, 26, 2), (4, 26, 2),
    ]


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(60_000)]
    found = classes(spark, [" ".join(words), " ".join(words[:55_000]), " ".join(words[30_000:])])
    assert found == {0: (59_996, 0), 1: (54_996, 0), 2: (29_996, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint"))
    assert {r.node: r.label for r in found.collect()} == {x: root(x) for x in list(parent)}
