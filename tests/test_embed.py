import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill import OnnxEncoder, TextModel, build_lexicon, embed, token_table, tokenize
from glyphmill.operators.embed import padded, register, unit_rows
from glyphmill.plans import fixture
from glyphmill.plans.fixture import MixingEncoder
from glyphmill.session import settle
from glyphmill.sources.model import send_model
from glyphmill.sources.texts import from_strings
from glyphmill.streaming.micro_batches import embed_stream
from tests.onnx_file import model

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", "."]


def test_padding_of_arrow_lists():
    lists = pa.array([[1, 2], [], [3, 4, 5]], pa.list_(pa.int32()))
    assert padded(lists, 4, 9).tolist() == [[1, 2, 9, 9], [9] * 4, [3, 4, 5, 9]]
    assert padded(lists.slice(1, 2), 3, 0).tolist() == [[0, 0, 0], [3, 4, 5]]
    assert padded(lists.slice(0, 0), 3, 0).shape == (0, 3)


def test_unit_rows():
    rows = unit_rows(np.array([[3, 4], [0, 0], [np.nan, 1]], dtype=np.float32))
    assert rows[:2].tolist() == [[0.6, 0.8], [0, 0]]
    assert math.isnan(rows[2, 0]) and rows[2, 1] == 1


def test_embedding_equals_its_relational_form(spark, small):
    """The encoder in Arrow batches against the same sums as joins and groups."""
    texts, own = fixture.texts(spark, small), fixture.vocabulary(spark, small)
    lexicon = build_lexicon(texts, own)
    cut = tokenize(texts, own, lexicon).filter(F.size("token_ids") > 512)
    short = settle(texts.join(cut, "text_id", "left_anti"), "short")
    counted = token_table(short, own, lexicon).filter(F.col("token_id") != 0).groupBy("text_id", "token_id").count()
    d, t = F.col("d"), F.col("token_id").cast("bigint")
    sums = (
        counted.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(15))))
        .groupBy("text_id", "d")
        .agg(F.sum(F.col("count") * ((31 * t + 17 * d + 7 * t * d) % 101 - 50)).alias("s"))
        .collect()
    )
    expected = {}
    for row in sums:
        expected.setdefault(row.text_id, [0] * 16)[row.d] = row.s
    found = {r.text_id: r.embedding for r in embed(short, own, MixingEncoder(), lexicon).collect()}
    assert found.keys() == expected.keys() and len(found) > 50
    for key, sums in expected.items():
        length = math.sqrt(sum(s * s for s in sums))
        assert np.allclose(found[key], [s / length for s in sums], atol=1e-6)
        assert abs(sum(x * x for x in found[key]) - 1) < 1e-5


def test_batch_size_does_not_matter(vocabulary_of, table_of):
    texts = table_of(["ab d", "", "abc.", "d d d", "zz"] * 30).coalesce(1)
    own = vocabulary_of(TOKENS)
    results = [sorted(embed(texts, own, MixingEncoder(), batch_size=size).collect()) for size in (None, 0, 1, 7, 1000)]
    assert len(results[0]) == 150 and all(r == results[0] for r in results)


def test_no_texts_give_no_rows(spark, vocabulary_of):
    assert embed(from_strings(spark, []), vocabulary_of(TOKENS), MixingEncoder()).collect() == []


def test_from_sql(spark, vocabulary_of):
    register(spark, "embedding_of", MixingEncoder(), 0)
    row = spark.sql("select embedding_of(array(2, 4, 3)) as v").head()
    direct = embed(from_strings(spark, "ab"), vocabulary_of(TOKENS), MixingEncoder()).head()
    assert row.v == direct.embedding and len(row.v) == 16


class Picky(MixingEncoder):
    """Fails on any chunk that has the id of "d"."""

    def __call__(self, input_ids, token_type_ids, attention_mask):
        if (input_ids == 6).any():
            raise ValueError("no d, please")
        return super().__call__(input_ids, token_type_ids, attention_mask)


@pytest.fixture(scope="module")
def by_value():
    """Test modules are not on the path of the workers: their classes travel with the task."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_errors(spark, vocabulary_of, table_of, by_value):
    texts, own = table_of(["ab", "d", "abc"]), vocabulary_of(TOKENS)
    with pytest.raises(Exception, match="no d, please"):
        embed(texts, own, Picky()).collect()
    told = {r.text_id: r for r in embed(texts, own, Picky(), batch_size=1, report_errors=True).collect()}
    assert told[1].embedding is None and told[1].error == "no d, please"
    assert told[0].error is None and len(told[2].embedding) == 16


class Refusing(MixingEncoder):
    """Counts its calls and fails on any chunk with one of the ids."""

    def __init__(self, ids):
        self.ids, self.calls = ids, 0

    def __call__(self, input_ids, token_type_ids, attention_mask):
        self.calls += 1
        if np.isin(input_ids, self.ids).any():
            raise ValueError("refused")
        return super().__call__(input_ids, token_type_ids, attention_mask)


@pytest.mark.parametrize("bad", [[], [17], [0, 63], [20, 21, 22], list(range(64))])
def test_a_bad_text_costs_its_own_vector_only(bad):
    from glyphmill.operators.embed import _attempt

    encoder = Refusing([1000 + k for k in bad])
    encoder.load()
    ids = pa.array([[2, 1000 + k, 3] for k in range(64)], pa.list_(pa.int32()))
    rows = pa.concat_arrays(list(_attempt(encoder, ids, 0, 8))).to_pylist()
    assert [k for k, r in enumerate(rows) if r["embedding"] is None] == bad
    assert all((r["error"] == "refused") == (k in bad) for k, r in enumerate(rows))
    assert encoder.calls <= 1 + 12 * len(bad)


def test_a_model_that_loses_rows_is_an_error(spark, vocabulary_of, table_of, by_value):
    class Losing(MixingEncoder):
        def __call__(self, *given):
            return super().__call__(*given)[:1]

    texts, own = table_of(["ab", "d", "abc"]).coalesce(1), vocabulary_of(TOKENS)
    with pytest.raises(Exception, match="1 states for"):
        embed(texts, own, Losing()).collect()
    # Alone every text has its state.
    assert embed(texts, own, Losing(), report_errors=True).filter("error is null").count() == 3


def test_onnx(spark, vocabulary_of, tmp_path):
    (tmp_path / "model.onnx").write_bytes(model())
    texts, own = from_strings(spark, ["ab d", "", "abc"]), vocabulary_of(TOKENS)
    # The first position holds the class token, id 2: the state is (2, -2) for every text.
    unit = [pytest.approx(math.sqrt(0.5)), pytest.approx(-math.sqrt(0.5))]
    for path in (str(tmp_path / "model.onnx"), send_model(spark, str(tmp_path))):
        rows = embed(texts, own, OnnxEncoder(path), batch_size=2).collect()
        assert sorted(r.text_id for r in rows) == [0, 1, 2] and all(r.embedding == unit for r in rows)


def test_models_behind_uris_do_not_pass_through_the_driver(spark, vocabulary_of, tmp_path, monkeypatch):
    from glyphmill.sources import model as models

    (tmp_path / "far").mkdir()
    # Another content than in the other tests, so nothing sent before is used.
    (tmp_path / "far" / "model.onnx").write_bytes(model() + b"\x72\x00")
    uri = (tmp_path / "far").as_uri()
    assert str(models.model_file(uri, spark)).endswith("far/model.onnx")
    read = []
    monkeypatch.setattr(models.Path, "open", lambda self, *a: read.append(self))
    name = send_model(spark, uri)
    assert name.endswith("-model.onnx") and send_model(spark, uri) == name and read == []
    rows = embed(from_strings(spark, ["ab d", ""]), vocabulary_of(TOKENS), OnnxEncoder(name)).collect()
    assert len(rows) == 2 and all(len(r.embedding) == 2 for r in rows)
    monkeypatch.setattr(models, "LARGEST_VALUE", 3)
    other = send_model(spark, uri)  # too large for a value: named by path, length and time
    assert other != name and len(embed(from_strings(spark, "ab"), vocabulary_of(TOKENS), OnnxEncoder(other)).collect()) == 1
    with pytest.raises(FileNotFoundError):
        models.model_file((tmp_path / "none").as_uri(), spark)


def test_text_model(spark, tmp_path):
    (tmp_path / "onnx").mkdir()
    (tmp_path / "onnx" / "model.onnx").write_bytes(model())
    (tmp_path / "vocab.txt").write_text("\n".join(TOKENS))
    loaded = TextModel.from_directory(spark, str(tmp_path))
    unit = [pytest.approx(math.sqrt(0.5)), pytest.approx(-math.sqrt(0.5))]
    assert loaded.encode("Hello world!") == [unit]
    assert loaded.encode(["Hello world!", "", "This is a test."], batch_size=2, show_progress_bar=True) == [unit] * 3
    assert loaded.encode([]) == []
    mixed = TextModel(loaded.vocabulary, MixingEncoder())
    both = mixed.encode(["ab", "d"])
    assert both[0] != both[1] and both == [mixed.encode("ab")[0], mixed.encode("d")[0]]


def test_stream(spark, vocabulary_of, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(0, "ab d"), (1, "abc")], "text_id bigint, text string")
    rows.write.parquet(source)
    own = vocabulary_of(TOKENS)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        embed_stream(stream, own, MixingEncoder(), sink, str(tmp_path / "state")).awaitTermination(120)

    run()
    rows.withColumn("text_id", F.col("text_id") + 2).write.mode("append").parquet(source)
    run()
    found = {r.text_id: r.embedding for r in spark.read.parquet(sink).collect()}
    direct = {r.text_id: r.embedding for r in embed(rows, own, MixingEncoder()).collect()}
    assert len(found) == 4 and all(found[k] == direct[k % 2] for k in found)
