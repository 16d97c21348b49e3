"""Repeated texts go through the model once, whatever share of the rows they are."""

import pytest

from glyphmill import embed, embed_distinct
from glyphmill.operators.distinct import distinct_texts
from glyphmill.plans.fixture import MixingEncoder, PickyEncoder
from tests.test_round2 import Counting

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c", "d"]


def texts_of(table_of):
    return table_of(["a b"] * 300 + [None, "", " ", "A  b", "a b "] + [f"a {'b ' * (k % 40)}c" for k in range(120)])


@pytest.mark.parametrize("limit", [1 << 20, 2000, 0])
def test_each_different_text_is_embedded_once(tmp_path, vocabulary_of, table_of, limit):
    encoder, own, texts = Counting(str(tmp_path / "calls")), vocabulary_of(TOKENS), texts_of(table_of)
    found = embed_distinct(texts, own, encoder, limit=limit)
    rows = {r.text_id: r.embedding for r in found.collect()}
    assert len(rows) == 425 and encoder.rows() == distinct_texts(texts).count() == 42
    found.collect()
    assert encoder.rows() == 42  # asking again does not run the model again
    direct = {r.text_id: r.embedding for r in embed(texts, own, Counting(str(tmp_path / "direct"))).collect()}
    assert rows == direct


def test_only_the_words_that_count_are_compared(vocabulary_of, table_of):
    texts = table_of(["a " * 600, "a " * 599 + "b", "a b", "a c"])
    assert distinct_texts(texts).count() == 3 and distinct_texts(texts, length=2).count() == 1
    own = vocabulary_of(TOKENS)
    found = {r.text_id: r.embedding for r in embed_distinct(texts, own, MixingEncoder()).collect()}
    assert found == {r.text_id: r.embedding for r in embed(texts, own, MixingEncoder()).collect()}


def test_hot_texts_are_not_gathered(spark, vocabulary_of):
    rows = spark.range(4000).selectExpr("id as text_id", "if(id % 3 = 0, 'a b', concat('a ', id)) as text")
    found = embed_distinct(rows, vocabulary_of(TOKENS), MixingEncoder(), limit=3000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and found.count() == 4000


def test_errors_are_told_for_every_copy(spark, vocabulary_of, table_of):
    own = vocabulary_of([*TOKENS, "x", "y", "z"])  # z has the id 10
    texts = table_of(["z", "a", "z", "b a"])
    rows = {r.text_id: r for r in embed_distinct(texts, own, PickyEncoder(), report_errors=True).collect()}
    assert [rows[k].embedding is None for k in range(4)] == [True, False, True, False]
    assert rows[0].error == rows[2].error == "a text the model refuses" and rows[1].error is None
    assert embed_distinct(table_of([]), own, MixingEncoder()).collect() == []
