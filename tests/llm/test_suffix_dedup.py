import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import suffix_dedup as S

random.seed(8)
VOCABULARY = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 8))) for _ in range(400)]


def sentence(count):
    return " ".join(random.choice(VOCABULARY) for _ in range(count))


def brute(texts):
    counts, datas = Counter(), [(t or "").encode() for t in texts]
    for data in datas:
        counts.update(data[i : i + 200] for i in range(len(data) - 199))
    out = []
    for data in datas:
        covered = bytearray(len(data))
        for i in range(len(data) - 199):
            if counts[data[i : i + 200]] > 1:
                covered[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        out.append((len(data), sum(covered), len(re.findall(b"\1+", covered)), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(count=60):
    passages, texts = [sentence(random.randint(40, 120)) for _ in range(5)], [None, "", "short", "ab" * 300, "x" * 1000, "x" * 199]
    for _ in range(count):
        parts = []
        for _ in range(random.randint(0, 4)):
            kind, passage = random.random(), random.choice(passages)
            start = random.randint(0, 100)
            parts.append(sentence(random.randint(1, 80)) if kind < 0.5 else passage[start : start + random.randint(150, 500)])
        texts.append(random.choice(["", " ", "\n"]).join(parts))
    return [*texts, texts[10], texts[11]]


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in S.deduplicate(rows).collect()}
    return [out[k] for k in range(len(texts))]


def test_against_brute_force(spark):
    texts = corpus()
    assert found(spark, texts) == brute(texts)


def test_crowded_seeds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 3)
    passage = sentence(60)
    texts = [sentence(30) + passage + sentence(30) for _ in range(25)] + corpus(20)
    assert found(spark, texts) == brute(texts)


def test_small_chunks_and_gathering(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 300)
    monkeypatch.setattr(S, "GATHERED", 7)
    texts = corpus(25)
    windows = sum(int(f["windows"].sum()) for _, _, f in S.runs([(t or "").encode() for t in texts]))
    assert windows == sum(max(0, len((t or "").encode()) - 199) for t in texts)
    frames = list(S.runs([t.encode() for t in texts if t]))
    assert frames


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, key int, spans string, seed int"
    assert S.deduplicate(spark.createDataFrame([], schema)).count() == 0
    text = sentence(80)
    rows = [(1, text, 1, "s", 2), (1, text, 1, "s", 2), (None, None, 1, "s", 2), (None, text + "!", 1, "s", 2)]
    out = S.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_removed for r in out) == [0, *[len(text.encode())] * 3]


@pytest.mark.parametrize("seed", range(20))
def test_blind_trie_orders_strings(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    order = S.blind_trie_order(strings)
    assert sorted(order) == list(range(40)) and [strings[i] for i in order] == sorted(strings)


@pytest.mark.parametrize("seed", range(10))
def test_deep_shallow_order(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(100))
    strings = [base[: rng.randint(0, 100)] + bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 70, 90]))) for _ in range(50)]
    groups = np.array([rng.randint(0, 3) for _ in strings])
    order, shared = S.deep_shallow_order(groups, strings)
    assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings, strict=True))
    for a, b, length in zip(order[:-1], order[1:], shared[1:], strict=True):
        assert length == (-1 if groups[a] != groups[b] else len(os.path.commonprefix([strings[a], strings[b]])))
