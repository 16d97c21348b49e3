"""What a stream's state is asked: by the different words of a chunk of texts, in pages."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphmill import embed, tokenize
from glyphmill.plans.fixture import MixingEncoder
from glyphmill.streaming import lexicon_state as L

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", ".", "é", "İ"]
SCHEMA = "text_id bigint, text string"
ODD = [(0, "AB abc d."), (1, ""), (2, None), (3, "é É İ ab c d x"), (4, "zz " * 50 + "ab"), (None, "ab d"), (6, "[ab](d)\x0b\x0cab")]


@pytest.fixture
def stream(spark, tmp_path):
    """Append rows and run the stream up to its end; returns the rows so far and the query's progress."""
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run(texts, own, start=L.tokenize_stream, **options):
        texts.coalesce(1).write.mode("append").parquet(source)
        query = start(spark.readStream.schema(texts.schema).parquet(source), own, *options.pop("encoder", ()), sink, state, **options)
        query.awaitTermination(180)
        return spark.read.parquet(sink).collect(), query.lastProgress

    return run


def test_state_is_asked_by_the_page(spark, vocabulary_of, stream):
    """Neither the texts nor the words of a bucket are rows or updates of the state."""
    texts = spark.range(400).selectExpr("id as text_id", "concat_ws(' ', transform(sequence(1, 50), k -> concat('w', (id * 7 + k * k) % 900))) as text")
    own = vocabulary_of(TOKENS)
    different = texts.select(F.explode(F.split("text", " "))).distinct().count()
    found, progress = stream(texts, own, buckets=4)
    assert {r.text_id: r.token_ids for r in found} == {r.text_id: r.token_ids for r in tokenize(texts, own).collect()}
    assert sum(r.segmented for r in found) == different > 400
    assert sum(o["numRowsUpdated"] for o in progress["stateOperators"]) <= 3 * 4
    lowered = texts.coalesce(1).select("text_id", F.col("text").alias("_text"))
    assert lowered.mapInArrow(L._chunks(4, [1, 2, 3, 4], None, 1 << 20), L._ROWS).count() == 4


def test_empty_texts_fill_a_chunk_too(spark):
    texts = spark.range(100).coalesce(1).selectExpr("id", "'' as _text")
    rows = texts.mapInArrow(L._chunks(1, [0], None, 10 * L.KEY_CHARS), L._ROWS).collect()
    assert [len(r.owners) // L._OWNER.size for r in rows] == [10] * 10 and len({r.chunk for r in rows}) == 10


@pytest.mark.parametrize("chars, page_words", [(1, 1), (20, 2), (1 << 20, 512)])
def test_chunks_and_pages_of_any_size(spark, vocabulary_of, stream, monkeypatch, chars, page_words):
    monkeypatch.setattr(L, "CHUNK_CHARS", chars)
    monkeypatch.setattr(L, "PAGE_WORDS", page_words)
    own = vocabulary_of(TOKENS)
    first = spark.createDataFrame(ODD, SCHEMA)
    broken = spark.createDataFrame([(7, "ab aq é d")], SCHEMA).select("text_id", F.expr("cast(replace(cast(text as binary), x'71', x'fe') as string)").alias("text"))
    more = spark.range(10, 40).selectExpr("id as text_id", "concat('ab v', id % 13, ' d u', id, ' v', id % 5) as text").union(broken)
    one, _ = stream(first, own, buckets=3)
    assert sum(r.segmented for r in one) == first.select(F.explode(L.words(F.col("text")))).distinct().count()
    both, _ = stream(more, own, buckets=3)
    every = first.union(more)
    assert sum(r.segmented for r in both) == every.select(F.explode(L.words(F.col("text")))).distinct().count()
    assert len(both) == every.count()
    assert {r.text_id: r.token_ids for r in both} == {r.text_id: r.token_ids for r in tokenize(every, own).collect()}


def test_a_key_has_one_text(spark, vocabulary_of, stream, monkeypatch):
    """Texts without words give way, wherever the key's text lies; two texts with words are an error."""
    monkeypatch.setattr(L, "CHUNK_CHARS", 1)
    own = vocabulary_of(TOKENS)
    rows = [(1, ""), (1, "ab"), (1, None), (None, None), (None, " "), (2, "d"), (2, ""), (3, "d")]
    found, _ = stream(spark.createDataFrame(rows, SCHEMA), own, buckets=2)
    assert sorted((r.text_id or 0, r.token_ids) for r in found) == [(0, [2, 3]), (1, [2, 4, 3]), (2, [2, 6, 3]), (3, [2, 6, 3])]
    with pytest.raises(Exception, match="two texts have one key"):
        stream(spark.createDataFrame([(5, "ab"), (6, "d"), (5, "d")], SCHEMA), own, buckets=2)


def test_several_keys_and_vectors(spark, vocabulary_of, stream):
    texts = spark.range(20).selectExpr(
        "cast(id % 3 as string) as name", "timestamp_micros(id) as at", "if(id = 4, null, array(id)) as list", "repeat('ab abc d ', int(id * 20)) as text"
    )
    keys, own = ("name", "at", "list"), vocabulary_of(TOKENS)
    found, _ = stream(texts, own, L.embed_stream, encoder=(MixingEncoder(),), keys=keys)
    direct = embed(texts, own, MixingEncoder(), keys=keys).collect()
    assert sorted((r["name"], r["at"], str(r["list"]), r.embedding) for r in found) == sorted((r["name"], r["at"], str(r["list"]), r.embedding) for r in direct)


class _Store(dict):
    """State in memory that counts what it is asked."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class _Size:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_pages_of_a_bucket():
    """Pages double with the words, no word is lost or segmented twice, and a page is read and written at once."""

    class Ids:
        value = {"a": 1}

    store, size = _Store(), _Size()
    seen = 0
    for upto in (3, 10, 11, 200, 1000):
        bucket = L._Lexicon(Ids, 7, 64, 8)
        bucket.known, bucket.size, bucket.pieces = store, size, None
        store.asked = 0
        share = "\n".join(f"w{i}" for i in range(upto))
        frame = pd.DataFrame([("c1", share, b"", None), ("c2", share, b"", b"x")], columns=["chunk", "words", "owners", "texts"])
        found = pd.concat(bucket.handleInputRows((5,), iter([frame]), None))
        passed, parts = found[found["texts"].notna()], found[found["ids"].notna()]
        assert list(passed["chunk"]) == ["c2"] and list(parts["chunk"]) == ["c1", "c2"]
        assert [ids.split("\n") for ids in parts["ids"]] == [["7"] * upto] * 2
        assert [len(fresh) // 4 for fresh in parts["fresh"]] == [upto - seen, 0]
        seen, (words, pages) = upto, size.value
        assert words == upto == sum(len(lines.split("\n")) for (lines,) in store.values())
        assert pages * 8 >= upto and pages < max(upto, 2) and store.asked <= 6 * pages
