"""Plans and skew: what must hold when the tables are large."""

from glyphmill import build_lexicon, tokenize
from glyphmill.plans import fixture
from glyphmill.sinks.files import write_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_shuffled_once(spark, small):
    texts, own = fixture.table(spark, small, "documents").selectExpr("doc_id as text_id", "text", "lang"), fixture.vocabulary(spark, small)
    lexicon = build_lexicon(texts, own)
    text = plan(tokenize(texts, own, lexicon))
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text  # columns that are not asked for are not read


def test_bucketed_texts_are_not_shuffled(spark, small):
    texts, own = fixture.texts(spark, small), fixture.vocabulary(spark, small)
    write_bucketed(texts, "bucketed_texts", 4, "text_id")
    lexicon = build_lexicon(texts, own)
    found = tokenize(spark.table("bucketed_texts"), own, lexicon, distributed=True)
    assert "Exchange hashpartitioning" not in plan(found)
    assert sorted(found.collect()) == sorted(tokenize(texts, own, lexicon).collect())


def test_rare_words_only_are_shuffled(spark, small):
    """Beyond the limit the texts are still moved once; the second way moves words."""
    texts, own = fixture.table(spark, small, "documents").selectExpr("doc_id as text_id", "text"), fixture.vocabulary(spark, small)
    lexicon = build_lexicon(texts, own)
    near, far = lexicon.split(300_000)
    assert 0 < near.count() < lexicon.words and near.count() + far.count() == lexicon.words
    beyond = tokenize(texts, own, lexicon, limit=300_000)
    assert plan(beyond).count("REPARTITION_BY_COL") == 1
    assert "SortMergeJoin [word_key" in plan(beyond)
    assert sorted(beyond.collect()) == sorted(tokenize(texts, own, lexicon).collect())


def test_hot_word(spark, vocabulary_of):
    """A word outside the vocabulary that is most of the corpus is broadcast, whatever the limit leaves out."""
    rows = [(i, "xyxz " * 50 + f"w{i}") for i in range(400)]
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    own = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "x", "##y", "##x", "##z", "w", *(f"##{i}" for i in range(10))])
    lexicon = build_lexicon(texts, own)
    near, far = lexicon.split(1000)
    assert [r.word_key for r in near.collect()] == ["xyxz"] and far.count() == 400
    found = {r.text_id: r.token_ids for r in tokenize(texts, own, lexicon, limit=1000).collect()}
    assert found[7] == [2] + [4, 5, 6, 7] * 50 + [8, 16, 3] and len(found) == 400


def test_copies_of_one_text(spark, vocabulary_of):
    rows = spark.range(3000).selectExpr("id as text_id", "if(id % 3 = 0, repeat('ab d ', 40), concat('d', id)) as text")
    own = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "d"])
    found = tokenize(rows, own).selectExpr("size(token_ids) as n").groupBy("n").count().collect()
    assert {r.n: r["count"] for r in found} == {82: 1000, 4: 2000}
