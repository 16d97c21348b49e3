import pytest
from pyspark.sql import functions as F

from glyphmill import build_lexicon, detokenize, encode_ids, token_table, tokenize
from glyphmill.functions import ids as I
from glyphmill.operators.batches import batch_sizes, flat_batch, with_batch
from glyphmill.operators.embed import encode
from glyphmill.operators.tokens import lookup_ids, model_ids
from glyphmill.operators.words import with_ordinal
from glyphmill.plans import fixture
from glyphmill.session import settle

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", "."]


def ids(df, column="token_ids"):
    return {r.text_id: r[column] for r in df.collect()}


def test_tokenize(vocabulary_of, table_of):
    texts = table_of(["AB d.", "", "   ", None, "abc", "abz d", "zz"])
    own = vocabulary_of(TOKENS)
    expected = {
        0: [2, 4, 6, 7, 3],
        1: [2, 3],
        2: [2, 3],
        3: [2, 3],
        4: [2, 4, 5, 3],
        5: [2, 4, 1, 6, 3],
        6: [2, 1, 3],
    }
    assert ids(tokenize(texts, own)) == expected
    assert ids(tokenize(texts, own, limit=0)) == expected  # every word through the shuffle
    rows = token_table(texts, own).orderBy("text_id", "pos").collect()
    assert [(r.text_id, r.pos, r.token_id) for r in rows] == [
        (t, p, i) for t, listed in expected.items() for p, i in enumerate(listed)
    ]


def test_no_texts(vocabulary_of, table_of):
    own = vocabulary_of(TOKENS)
    assert tokenize(table_of([]), own).collect() == []


def test_special_ids_without_entries(vocabulary_of, table_of):
    assert ids(tokenize(table_of(["a zz"]), vocabulary_of(["a"]))) == {0: [101, 0, 100, 102]}


def test_lexicon_of_other_texts_is_refused(vocabulary_of, table_of):
    own = vocabulary_of(TOKENS)
    lexicon = build_lexicon(table_of(["ab"]), own)
    for limit in (1 << 20, 0):
        with pytest.raises(Exception, match="missing from the lexicon"):
            tokenize(table_of(["d"]), own, lexicon, limit=limit).collect()


def test_several_keys(spark, vocabulary_of):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "d")], "conv_id bigint, turn bigint, text string")
    found = tokenize(rows, vocabulary_of(TOKENS), keys=("conv_id", "turn"))
    assert sorted(found.collect()) == [(1, 0, [2, 4, 3]), (1, 1, [2, 6, 3])]


@pytest.mark.parametrize("words, used", [(509, 511), (510, 512), (511, 512), (600, 512)])
def test_encoded_length(vocabulary_of, table_of, words, used):
    row = ids(encode_ids(table_of(["ab " * words]), vocabulary_of(TOKENS)), "input_ids")[0]
    assert len(row) == 512
    assert row == [2] + [4] * (used - 2) + [3] + [0] * (512 - used)


def test_word_limit_changes_nothing(spark, small):
    """Encoding reads the words that can matter; the same comes out of cutting all tokens."""
    texts, own = fixture.texts(spark, small), fixture.vocabulary(spark, small)
    lexicon = build_lexicon(texts, own)
    tokens = settle(tokenize(texts, own, lexicon), "tokens")
    for length in (1, 2, 17, 512):
        whole = tokens.select("text_id", I.truncate(F.col("token_ids"), own.special.sep, length))
        assert sorted(whole.collect()) == sorted(model_ids(texts, own, lexicon, length=length).collect())
    # The limit also holds for the lexicon that is built on the way.
    limited = model_ids(texts, own, length=17)
    whole = tokens.select("text_id", I.truncate(F.col("token_ids"), own.special.sep, 17))
    assert sorted(whole.collect()) == sorted(limited.collect())


def test_mask_is_by_value(vocabulary_of, table_of):
    own = vocabulary_of(TOKENS).with_special(6, 1, 2, 3)  # the id of "d" pads
    row = encode(table_of(["ab d ab"]), own).head()
    assert row.attention_mask[:6] == [1, 1, 0, 1, 1, 0] and sum(row.attention_mask) == 4
    assert row.token_type_ids == [0] * 512
    assert row.input_ids[:6] == [2, 4, 6, 4, 3, 6]


def test_mask_counts_tokens(spark, small):
    texts, own = fixture.texts(spark, small), fixture.vocabulary(spark, small)
    sizes = tokenize(texts, own).select("text_id", F.least(F.size("token_ids"), F.lit(512)).alias("n"))
    masked = encode(texts, own).select(
        "text_id", F.size("input_ids").alias("length"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones")
    )
    assert masked.join(sizes, "text_id").filter((F.col("ones") != F.col("n")) | (F.col("length") != 512)).count() == 0


def test_detokenize(spark, vocabulary_of):
    own = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", "##", "", " "])
    rows = {
        0: [2, 4, 5, 1, 0, 99999, 6, 3],
        1: [],
        2: [2, 3],
        3: [5, 6],
        4: [7, 4, 7, 6],
        5: [8, 4, 8, 6],
        6: [9, 4],
        7: [99999],
    }
    table = spark.createDataFrame(list(rows.items()), "text_id bigint, token_ids array<int>")
    expected = {0: "abc [UNK] d", 1: "", 2: "", 3: "c d", 4: "ab d", 5: "ab  d", 6: "  ab", 7: ""}
    assert ids(detokenize(table, own), "text") == expected
    assert ids(detokenize(table, own, limit=0), "text") == expected


def test_detokenize_long_text(vocabulary_of, table_of):
    own = vocabulary_of(TOKENS)
    text = "ab d abc . " * 20_000
    assert ids(detokenize(tokenize(table_of([text]), own), own), "text")[0] == text.strip()


def test_lookup_default(spark, vocabulary_of):
    rows = spark.createDataFrame([("ab",), ("nope",)], "token string")
    assert {r.token: r.token_id for r in lookup_ids(rows, vocabulary_of(TOKENS)).collect()} == {"ab": 4, "nope": 1}


def test_batches(table_of):
    texts = table_of([str(i) for i in range(130)])
    for size in (None, 64, 0):
        sizes = batch_sizes(with_batch(texts, "text_id", batch_size=size))
        assert sorted(sizes.collect()) == [(0, 64), (1, 64), (2, 2)]
    placed = with_batch(texts, "text_id", batch_size=50).orderBy("text_id").collect()
    assert [(r.batch_id, r.batch_row) for r in placed] == [(i // 50, i % 50) for i in range(130)]


def test_ordinal_over_many_ranges(spark):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 37 % 5003).alias("x"))
    numbered = with_ordinal(rows, F.desc("x")).orderBy("ordinal").collect()
    assert [r.ordinal for r in numbered] == list(range(5000))
    assert [r.x for r in numbered] == sorted((r.x for r in numbered), reverse=True)


def test_flat_batch(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4]), (1, 0, [5, 6])], "batch_id int, batch_row int, input_ids array<int>")
    flat = flat_batch(rows, []).orderBy("batch_id", "place").collect()
    assert [tuple(r) for r in flat] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 0, 5), (1, 1, 6)]


def test_head(spark):
    row = spark.createDataFrame([(list(range(20)),)], "ids array<int>").select(I.token_head(F.col("ids"))).head()
    assert row[0] == list(range(10))
