import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import hot_keys
from glyphmill.llm import phrases as P

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 8))) for _ in range(400)]
SCHEMA = "doc_id bigint, text string"


def prose(count, words=VOCABULARY):
    return [random.choice(words) for _ in range(count)]


def brute(texts):
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - 34):
            if counts[tuple(words[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def corpus(count=80):
    passages = [prose(random.randint(30, 150)) for _ in range(6)]
    texts = [None, "", " \n", "one", "ab " * 300, "x\ty\n" * 200, "w " * 34]
    for _ in range(count):
        words = []
        for _ in range(random.randint(0, 4)):
            passage = random.choice(passages)
            start = random.randint(0, 60)
            words += prose(random.randint(1, 60)) if random.random() < 0.5 else passage[start : start + random.randint(20, 100)]
        texts.append("".join(word + random.choice([" ", "\n", "\t ", " \x0b"]) for word in words))
    return [*texts, texts[10], texts[11]]


def found(spark, texts, schema=SCHEMA, rest=()):
    rows = spark.createDataFrame([(k, t, *rest) for k, t in enumerate(texts)], schema).repartition(5)
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in P.deduplicate(rows).collect()}
    assert len(out) == len(texts)
    return [out[k] for k in range(len(texts))]


def test_against_brute_force(spark):
    texts = corpus()
    expected = brute(texts)
    assert sum(row[1] > 0 for row in expected) > 20 and found(spark, texts) == expected


def test_small_blocks_shards_and_hot_anchors(spark, monkeypatch):
    """Many blocks and automata; every anchor met twice counts as hot."""
    monkeypatch.setattr(P, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(P, "SHARD", 100)
    monkeypatch.setattr(P, "HOT", 2)
    monkeypatch.setattr(hot_keys, "HOT", 2)
    passage = prose(60)
    texts = [" ".join(prose(20) + passage + prose(20)) for _ in range(40)] + corpus(30)
    assert found(spark, texts) == brute(texts)


def test_common_anchors_with_different_surroundings(spark):
    """The same twelve words everywhere, windows around them equal in part only."""
    middle, left, right = prose(12), prose(40), prose(40)
    texts = [" ".join(prose(30) + left[40 - a :] + middle + right[:b] + prose(30)) for a in range(0, 30, 3) for b in range(0, 30, 3)]
    assert found(spark, texts) == brute(texts)


def test_pieces_of_long_texts_give_the_same_windows(spark, monkeypatch):
    monkeypatch.setattr(P, "PACK", 50)
    texts = corpus(20) + [" ".join(prose(5000, VOCABULARY[:3]))]
    split = [P.words_of(t) for t in texts]
    assert sum(int(np.sum(f["windows"])) for f in P.runs(split)) == sum(max(0, len(w) - 34) for w in split)


def test_a_long_text(spark):
    words = prose(300_000)
    texts = [" ".join(words), " ".join(words[150_000:150_050]), "z" * 2_000_000, " ".join(prose(100))]
    assert found(spark, texts) == brute(texts)


def test_defined_cases(spark):
    assert P.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(prose(80))
    rows = [(1, text), (1, text), (None, None), (None, text + " more"), (None, "a")]
    out = P.deduplicate(spark.createDataFrame([(*r, 1, "k", b"x") for r in rows], SCHEMA + ", block int, key string, words binary")).collect()
    assert sorted((r.n_words, r.n_removed) for r in out) == [(0, 0), (1, 0), (80, 80), (80, 80), (81, 80)]


def test_many_words_in_an_automaton():
    """Numbers of words pass over the range that no character may have."""
    found = P.Passages()
    words = [b"w%d" % k for k in range(70_000)]
    for start in range(0, 70_000, 100):
        found.add(words[start : start + 100])
    found.compile()
    edges = np.zeros(301, np.int32)
    found.mark([b"new"] * 50 + words[55_250:55_500], edges)
    assert np.flatnonzero(np.cumsum(edges[:-1])).tolist() == list(range(100, 300))


@pytest.mark.parametrize("count", [35, 36, 100])
def test_equal_windows_have_equal_anchors(count):
    words = [b"a%d" % k for k in range(count)]
    a = next(P.runs([words]))
    b = next(P.runs([[b"other"] * 50 + words]))
    assert set(a["anchor"].tolist()) <= set(b["anchor"].tolist())


@pytest.mark.parametrize(("seed", "size", "pack"), [(1, 2, 1 << 16), (2, 3, 64), (3, 30, 100), (4, 8, 1 << 16)])
def test_dense_repeats_edits_and_pieces(spark, monkeypatch, seed, size, pack):
    """Few words, texts that repeat themselves, copies with edits of copies; pieces of any size."""
    rng = random.Random(seed)
    monkeypatch.setattr(P, "PASSAGE", 20)
    # Pieces are cut in the workers, where only the number of words is set here: by long texts.
    words = [f"w{k}" for k in range(size)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 160))] for _ in range(12)]
    for _ in range(40):
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            if copy:
                copy[rng.randrange(len(copy))] = rng.choice([*words, "new"])
        start = rng.randint(0, len(copy))
        texts.append(copy[start:] + rng.choice(texts)[: rng.randint(0, 90)])
    joined = [" ".join(t) for t in texts]
    assert found(spark, joined) == brute(joined)
    monkeypatch.setattr(P, "PACK", pack)
    split = [P.words_of(t) for t in joined]
    assert sum(int(np.sum(f["windows"])) for f in P.runs(split)) == sum(max(0, len(w) - 34) for w in split)
