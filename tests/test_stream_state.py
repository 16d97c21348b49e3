"""A stream whose lexicon grows in its state."""

import pytest
from pyspark.sql import functions as F

from glyphmill import embed, tokenize
from glyphmill.plans import fixture
from glyphmill.plans.fixture import MixingEncoder
from glyphmill.streaming import lexicon_state as L

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", "."]
SCHEMA = "text_id bigint, text string"


@pytest.fixture
def stream(spark, tmp_path):
    """Append rows and run the stream up to its end; returns the rows of each micro-batch so far."""
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run(rows, own, start=L.tokenize_stream, **options):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        texts = spark.readStream.schema(SCHEMA).parquet(source)
        start(texts, own, *options.pop("encoder", ()), sink, state, **options).awaitTermination(180)
        return spark.read.parquet(sink).collect()

    return run


def test_later_batches_segment_new_words_only(stream, spark, vocabulary_of):
    own, before = vocabulary_of(TOKENS), spark.conf.get(L._PROVIDER)
    first = stream([(0, "ab abc d."), (1, "abc abc zz"), (2, ""), (3, None)], own, buckets=3)
    assert sum(r.segmented for r in first) == 5  # ab abc d . zz
    rows = [(4, "d ab zz abc"), (5, "dd d"), (6, "abc. ab")]
    both = stream(rows, own, buckets=3)  # started again: the state is that of the checkpoint
    assert sum(r.segmented for r in both if r.batch == 1) == 1  # dd
    texts = spark.createDataFrame([(0, "ab abc d."), (1, "abc abc zz"), (2, ""), (3, None), *rows], SCHEMA)
    expected = {r.text_id: r.token_ids for r in tokenize(texts, own).collect()}
    assert {r.text_id: r.token_ids for r in both} == expected and len(both) == 7
    assert spark.conf.get(L._PROVIDER) == before


def test_vectors_equal_the_batch_way(stream, spark, vocabulary_of):
    own = vocabulary_of(TOKENS)
    rows = [(0, "ab d"), (1, "abc " * 700), (2, None), (3, "x")]
    found = {r.text_id: r.embedding for r in stream(rows, own, L.embed_stream, encoder=(MixingEncoder(),))}
    direct = embed(spark.createDataFrame(rows, SCHEMA), own, MixingEncoder()).collect()
    assert found == {r.text_id: r.embedding for r in direct}


def test_a_word_of_every_text_loads_no_bucket(spark, small):
    """Rows per bucket follow the texts, not how often a word occurs."""
    texts = fixture.texts(spark, small)
    rows = texts.select("text_id", F.concat(F.lit("the "), F.repeat(F.lit("the "), 300), "text").alias("text"))
    listed = F.transform(L.words(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(L.BUCKETS)))
    counts = rows.select(F.explode(F.array_distinct(listed)).alias("b")).groupBy("b").count().agg(F.max("count"), F.avg("count")).head()
    assert counts[0] <= texts.count() and counts[0] < 2.5 * counts[1]
