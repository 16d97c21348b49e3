import random

import numpy as np

from glyphmill.llm import decontaminate as D

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(400)]


def sentence(count):
    return [random.choice(VOCABULARY) for _ in range(count)]


def plain_score(item, text):
    """Smith-Waterman cell by cell."""
    best, table = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_plain_recurrence():
    for _ in range(60):
        item, text = np.random.randint(0, 6, 12), np.random.randint(-1, 6, 40)
        best, end = D.local_scores(item, text)
        assert best == plain_score(item, text)
        score, first, last = D.align(item, text)
        if best:
            assert last == end - 1 and plain_score(item, text[first : last + 1]) == best and score == best / 24


def find(spark, texts, items, **options):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.with_leaks(documents, benchmark, **options).collect()
    return {r.doc_id: [(x.item_id, round(x.score, 3), x.first_word, x.last_word) for x in r.leaks] for r in rows}


def edited(words, every):
    return [random.choice(VOCABULARY) if k % every == every - 1 else w for k, w in enumerate(words)]


def test_copies_edits_and_clean_texts(spark):
    items = [sentence(30) for _ in range(20)]
    texts = []
    for item in items:
        texts.append(" ".join(sentence(50) + item + sentence(20)))
        texts.append(" ".join(sentence(5) + edited(item, 6) + sentence(200)).upper())
        texts.append(" ".join(sentence(60) + item[:4] + sentence(60)))
        texts.append(", ".join(sentence(90)))
    out = find(spark, texts, [(k, " ".join(item)) for k, item in enumerate(items)])
    for k in range(20):
        assert (k, 1.0, 50, 79) in out[4 * k]
        assert [x[0] for x in out[4 * k + 1]] == [k] and 0.6 <= out[4 * k + 1][0][1] < 1
        assert out[4 * k + 2] == out[4 * k + 3] == []


def test_an_item_copied_everywhere_is_found_everywhere(spark):
    item = sentence(25)
    out = find(spark, [" ".join(sentence(10) + item) for _ in range(60)], [(7, " ".join(item))])
    assert all(leaks == [(7, 1.0, 10, 34)] for leaks in out.values())


def test_defined_cases(spark):
    item = " ".join(sentence(12))
    items = [(1, item), (2, item), (3, None), (4, ""), (None, item), (5, "one two")]
    out = find(spark, [None, "", item, item + " " + item, "one two"], items)
    assert out[0] == out[1] == out[4] == []
    assert [x[0] for x in out[2]] == [1, 2] and out[3][0][2:] == (0, 11)
    assert find(spark, [item], []) == {0: []}
    assert find(spark, [], items) == {}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(sentence(15))) for k in range(30)]
    texts = [" ".join(sentence(20)) + " " + text for _, text in items]
    whole = find(spark, texts, items)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert {k: sorted(v) for k, v in find(spark, texts, items).items()} == whole


def test_an_edited_item_in_many_documents_is_found_in_all(spark):
    """Also next to one verbatim copy, whose n-grams are then the rare ones."""
    item = sentence(30)
    copy = edited(item, 6)
    texts = [" ".join(sentence(10) + copy + sentence(5)) for _ in range(60)]
    for more in ([], [" ".join(item)]):
        out = find(spark, texts + more, [(7, " ".join(item))])
        assert all([x[0] for x in leaks] == [7] for leaks in out.values()) and len(out) == 60 + len(more)


def test_the_bound_is_never_below_the_score():
    for _ in range(200):
        item, text = np.random.randint(0, 9, 12), np.random.randint(-1, 14, np.random.randint(1, 60))
        assert D.most(np.isin(text, item)) >= D.local_scores(item, text)[0]
    assert D.most(np.zeros(0, bool)) == 0 and D.most(np.array([True, False, True])) == 3
