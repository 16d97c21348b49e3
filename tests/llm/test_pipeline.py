"""The pipeline against a brute-force version of each stage, on the small tables."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from glyphmill.llm import decontaminate, toxicity
from glyphmill.llm.queries import TARGETS, table
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in P.STAGES:
        before = docs
        docs = P.settle(stage(spark, docs, SMALL), "stage")
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return out


def test_stages_and_columns(steps):
    assert [name for name, *_ in steps] == ["toxicity", "jaccard_join", "decontamination", "pii", "mixing"]
    for _, _, _, columns in steps[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, steps):
    _, before, after, _ = steps[0]
    model = toxicity.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(r.text) < toxicity.THRESHOLD}


def test_one_of_each_group_stays(steps):
    _, before, after, _ = steps[1]

    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, parent = {r.doc_id: shingles(r.text) for r in before}, {r.doc_id: r.doc_id for r in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after} == {d for d in sets if root(d) == d}


def test_contaminated_documents_go(spark, steps):
    _, before, after, _ = steps[2]
    items = [decontaminate.words(r.text) for r in table(spark, SMALL, "benchmark").collect()]

    def holds(text):
        joined = " " + " ".join(decontaminate.words(text)) + " "
        return any(" " + " ".join(item) + " " in joined for item in items if len(item) >= decontaminate.LEAST_WORDS)

    assert {r.doc_id for r in after} == {r.doc_id for r in before if not holds(r.text)}


def test_personal_data_is_replaced(steps):
    _, before, after, _ = steps[3]
    given = {r.doc_id: r.text for r in before}
    personal = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\(\d{3}\) \d{3}-\d{4}|\bAKIA\w{16}|\b[0-9a-f]{18,40}\b")
    assert len(after) == len(before)
    for r in after:
        found = set(personal.findall(given[r.doc_id]))
        assert (r.text == given[r.doc_id]) == (not found) and not any(x in r.text for x in found)
        assert r.n_chars == len(r.text)


def test_the_mixture_meets_its_targets(steps):
    _, before, after, columns = steps[4]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "rate", "copies"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and all(r.rate > 0 for r in after)
    assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) for r in after)
    english = sum(r.rate * r.tokens for r in after if r.lang == "en") / sum(r.rate * r.tokens for r in after)
    assert abs(english - TARGETS["en-good"] - TARGETS["en-poor"]) < 0.12


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "some words that are clean enough to stay in the corpus as they are"
    rows = [(1, text, "en", "s", 66), (1, text, "en", "s", 66), (None, None, None, None, None), (2, "", None, None, 0), (3, text, "en", "s", 66)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES[:-1]:
            docs = P.settle(stage(spark, docs, SMALL), "stage")
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        kept = P.mixed(spark, docs, SMALL).select("doc_id").collect()
        assert sorted(r.doc_id or -1 for r in kept) == ([-1, 1, 2] if data else [])


def test_only_rows_that_are_copies_go(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"

    def text(k):
        return " ".join(f"w{k}x{j}" for j in range(40))

    near = text(4) + " end"
    texts = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (None, ""), (None, None)]
    texts += [(7, text(1)), (7, text(5)), (None, text(4)), (None, near), (9, text(6)), (9, text(6)), (None, text(8)), (3, text(8))]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in texts], schema)
    kept = [(r.doc_id, r.text) for r in P.near_copies(spark, docs, SMALL).collect()]
    one_of = [r for r in kept if r in ((None, text(4)), (None, near))]
    rest = sorted((r for r in kept if r not in one_of), key=str)
    assert len(one_of) == 1
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (None, ""), (None, None), (7, text(5)), (9, text(6)), (3, text(8))]
    assert rest == sorted(want, key=str)
