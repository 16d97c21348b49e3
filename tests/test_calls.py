"""Calls on a few strings, and tables of texts from SQL."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill import TextModel, embed, model as models
from glyphmill.functions.pieces import Segmenter, sent_ids
from glyphmill.functions.text import words, words_of
from glyphmill.operators.lexicon import count_words, segment
from glyphmill.operators.table_function import register_texts
from glyphmill.operators.word_cache import WordCache
from glyphmill.operators.words import word_table
from glyphmill.plans import fixture
from glyphmill.plans.fixture import MixingEncoder, PickyEncoder

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", "."]
TEXTS = ["ab d.", "", "abc", None, "ÉTÉ  ab\x0bd x", "d " * 700, "q", "ab,ab(d)\n[UNK]"]


def test_words_of_strings_are_those_of_columns(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    found = spark.createDataFrame(rows, "k int, t string").select("k", words(F.col("t")).alias("w")).collect()
    assert {r.k: r.w for r in found} == {k: words_of(t) for k, t in rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.,[ \t\x0b É\x1c'-", max_size=30))
def test_words_have_no_blank_and_lose_nothing(text):
    found = words_of(text)
    assert all(word and not set(word) & set(" \t\n\x0b\f\r") for word in found)
    kept = "".join(c for c in text if c not in " \t\n\x0b\f\r")
    assert "".join(found) == kept.translate(str.maketrans("AB", "ab"))


def test_strings_equal_the_way_of_tables(spark, vocabulary_of, table_of):
    own = vocabulary_of(TOKENS)
    model = TextModel(own, MixingEncoder())
    by_table = {r.text_id: r.embedding for r in embed(table_of(TEXTS), own, MixingEncoder()).collect()}
    assert model.encode(TEXTS) == [by_table[k] for k in range(len(TEXTS))]
    assert model.encode(TEXTS, batch_size=3) == model.encode(TEXTS)
    assert model.encode("ab d.") == [by_table[0]] and model.encode([]) == []


def test_many_strings_go_the_way_of_tables(spark, vocabulary_of, monkeypatch):
    own = vocabulary_of(TOKENS)
    few = TextModel(own, MixingEncoder()).encode(TEXTS)
    monkeypatch.setattr(models, "FEW", 3)
    model = TextModel(own, MixingEncoder())
    assert model.encode(TEXTS) == few and len(model.words) == 0


def test_the_cache_is_bounded_and_asks_once(spark, vocabulary_of, monkeypatch):
    own, asked = vocabulary_of(TOKENS), []
    from glyphmill.operators import word_cache

    real = word_cache.segment
    monkeypatch.setattr(word_cache, "segment", lambda distinct, *a, **k: asked.append(distinct.count()) or real(distinct, *a, **k))
    cache = WordCache(own, words=3)
    assert cache.ids_of(["ab", "abc", "zz"]) == {"ab": (4,), "abc": (4, 5), "zz": (1,)}
    assert cache.ids_of(["ab", "zz"]) == {"ab": (4,), "zz": (1,)} and asked == [3]
    assert cache.ids_of(["d", "dc"]) == {"d": (6,), "dc": (6, 5)} and len(cache) == 3 and asked == [3, 2]
    assert cache.ids_of(["abc"]) == {"abc": (4, 5)} and asked == [3, 2, 1]  # went as the least recently used
    assert len(cache.ids_of([f"w{k}" for k in range(10)])) == 10 and len(cache) == 3


def test_warm_calls_are_fast(spark, small):
    model = TextModel(fixture.vocabulary(spark, small), MixingEncoder())
    strings = [r.text for r in fixture.table(spark, small, "benchmark").orderBy("item_id").limit(8).collect()]
    model.encode(strings)
    taken = []
    for _ in range(5):
        start = time.perf_counter()
        model.encode(strings)
        taken.append(time.perf_counter() - start)
    assert min(taken) < 1.0  # about 0.1 s on an idle machine


def test_segmenter_equals_the_join(spark, small):
    own = fixture.vocabulary(spark, small)
    pieces = Segmenter(sent_ids(own).value, own.unk_piece)
    joined = segment(count_words(word_table(fixture.texts(spark, small))), own, limit=0, named=True).select("word", "pieces").collect()
    assert len(joined) > 5000 and all(pieces(r.word) == tuple(r.pieces) for r in joined)


@pytest.mark.parametrize(
    ("tokens", "word", "expected"),
    [
        (["ab"], "abz", [0, -1]), (["ab", "##ab", "##a"], "abab", [0, 1]), (["x" * 25], "x" * 25, [0]), (["##ab"], "##ab", [0]),
        (["x" * 25, "x", "##x"], "x" * 26, [1] + [2] * 25), (["é" * 10, "##é"], "é" * 11, [0, 1]), ([], "a", [-1]),
    ],
)
def test_segmenter_edges(tokens, word, expected):
    assert list(Segmenter({t: i for i, t in enumerate(tokens)}, -1)(word)) == expected


def test_table_function(spark, vocabulary_of, table_of):
    own = vocabulary_of(TOKENS)
    register_texts(spark, "embed_few", own, MixingEncoder(), batch_size=3)
    rows = [(k, t, [k], {"a": k}) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "id bigint, body string, tags array<int>, facts map<string,int>").createOrReplaceTempView("few_texts")
    found = spark.sql("select * from embed_few(table(few_texts), text => 'body')")
    assert found.dtypes == [("id", "bigint"), ("tags", "array<int>"), ("facts", "map<string,int>"), ("embedding", "array<float>")]
    direct = {r.text_id: r.embedding for r in embed(table_of(TEXTS), own, MixingEncoder()).collect()}
    assert {r.id: (r.tags, r.facts, r.embedding) for r in found.collect()} == {k: ([k], {"a": k}, direct[k]) for k in direct}
    assert spark.sql("select * from embed_few(table(select id, body as text from few_texts where id < 0))").count() == 0


@pytest.mark.parametrize(
    ("call", "message"),
    [
        ("embed_few(table(select 1 as id))", "no column 'text'"), ("embed_few(table(select 1 as text))", "holds no texts"),
        ("embed_few('a')", "first argument is a table"), ("embed_few(table(select 'a' as text, 1 as embedding))", "already"),
    ],
)
def test_table_function_complaints(spark, vocabulary_of, call, message):
    register_texts(spark, "embed_few", vocabulary_of(TOKENS), MixingEncoder())
    with pytest.raises(Exception, match=message):
        spark.sql(f"select * from {call}").collect()


def test_table_function_reports_errors(spark, vocabulary_of):
    own = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c", "d", "e", "f", "g"])  # g has the id 10
    register_texts(spark, "embed_or_tell", own, PickyEncoder(), report_errors=True)
    spark.createDataFrame([(k, t) for k, t in enumerate("abcdefg")], "id int, text string").createOrReplaceTempView("letters")
    rows = {r.id: r for r in spark.sql("select * from embed_or_tell(table(letters))").collect()}
    assert [k for k, r in rows.items() if r.embedding is None] == [6] and rows[6].error == "a text the model refuses"
    with pytest.raises(ValueError, match="too large"):
        register_texts(spark, "never", own, PickyEncoder(), limit=10)
