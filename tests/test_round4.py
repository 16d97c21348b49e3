"""What a Python worker keeps of a large vocabulary."""

import random
import tracemalloc

from glyphmill import embed
from glyphmill.functions import pieces
from glyphmill.operators.table_function import register_texts
from glyphmill.plans.fixture import MixingEncoder

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", ".", "é", "##é"]


def opened(tmp_path, ids):
    (tmp_path / "file").write_bytes(pieces.packed_ids(ids))
    return pieces.MappedIds(str(tmp_path / "file"))


def test_mapped_ids(tmp_path):
    odd = {"": 5, "a": -3, "é": 2**31 - 1, "\x00": 7, "##😀": 9, "1": 1, "11": 11, "a\xff\xfe1": 12}
    pick = random.Random(3)
    text = lambda: "".join(pick.choice("abc12é#") for _ in range(pick.randint(1, 6)))
    for ids in ({}, {"a": 0}, odd, {text(): i for i in range(5000)}):
        mapped = opened(tmp_path, ids)
        asked = [*ids, *odd, *(text() for _ in range(2000))]
        assert [mapped.get(t, -9) for t in asked] == [ids.get(t, -9) for t in asked]
        assert [t in mapped for t in asked] == [t in ids for t in asked]


def test_a_large_vocabulary_is_not_held(spark, vocabulary_of, monkeypatch):
    own = vocabulary_of([*TOKENS, *(f"large{i}" for i in range(20_000))])
    monkeypatch.setattr(pieces, "WORKER_BYTES", 1000)
    sent = pieces.sent_ids(own, 1 << 30)
    tracemalloc.start()
    try:
        ids = sent.value
        assert ids.get("large19999") == len(TOKENS) + 19_999 and "large20000" not in ids
        assert tracemalloc.get_traced_memory()[1] < 200_000
    finally:
        tracemalloc.stop()


def test_vectors_from_a_mapped_vocabulary(spark, vocabulary_of, monkeypatch):
    rows = [(0, "AB abc d. zz"), (1, ""), (2, None), (3, "ééé abé d" * 200)]
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    own = vocabulary_of([*TOKENS, *(f"mapped{i}" for i in range(50))])
    expected = sorted((r.text_id, r.embedding) for r in embed(texts, own, MixingEncoder()).collect())
    monkeypatch.setattr(pieces, "WORKER_BYTES", 1000)
    register_texts(spark, "embed_mapped", own, MixingEncoder())
    texts.createOrReplaceTempView("mapped_texts")
    found = spark.sql("select * from embed_mapped(table(select * from mapped_texts))").collect()
    assert sorted((r.text_id, r.embedding) for r in found) == expected
