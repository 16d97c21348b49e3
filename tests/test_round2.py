"""The model runs once per text; files keep their order; models and settled tables keep apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import vectors as V
from glyphmill.operators import evaluate, lexicon, profile, quality, tokens
from glyphmill.operators.embed import embed, embedding, padded
from glyphmill.operators.words import word_table
from glyphmill.session import settle, settled_scope, shared_folder
from glyphmill.sinks import files
from glyphmill.sources import model as models
from glyphmill.sources import texts as S


class Counting:
    """Tells in a file how many rows each call had."""

    def __init__(self, path):
        self.path = path

    def load(self):
        pass

    def __call__(self, input_ids, token_type_ids, attention_mask):
        with open(self.path, "a") as out:
            out.write(f"{len(input_ids)}\n")
        return np.ones((len(input_ids), 1, 4), np.float32) * (1 + input_ids[:, 1:2, None])

    def rows(self):
        return sum(map(int, open(self.path).read().split()))


@pytest.fixture
def embedded(spark, tmp_path, vocabulary_of, table_of):
    encoder = Counting(str(tmp_path / "calls"))
    vocabulary = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b"])
    texts = table_of(["a b"] * 40 + ["b"] * 23)
    return encoder, texts, vocabulary, embed(texts, vocabulary, encoder)


@pytest.mark.parametrize("use", ["quarantine", "require_good", "write_text", "run_counts"])
def test_the_model_runs_once_per_text(embedded, tmp_path, use):
    encoder, texts, vocabulary, vectors = embedded
    if use == "quarantine":
        assert quality.quarantine(vectors)[0].count() == 63
        quality.quarantine(vectors)[0].collect()
        assert encoder.rows() in (63, 126)
        return
    if use == "require_good":
        assert len(quality.require_good(vectors).collect()) == 63
    if use == "write_text":
        files.write_text(vectors, str(tmp_path / "out"))
    if use == "run_counts":
        assert profile.run_counts(texts, vectors, vocabulary).head().embeddings == 63
    assert encoder.rows() == 63


def test_long_and_null_id_lists(spark, tmp_path):
    rows = [(0, [2, 4, 3]), (1, [2, *[4] * 600, 3]), (2, None), (3, [])]
    ids = spark.createDataFrame(rows, "text_id bigint, ids array<int>").coalesce(1)
    out = {r.text_id: r.v for r in ids.select("text_id", embedding(F.col("ids"), Counting(str(tmp_path / "c")), 0).alias("v")).collect()}
    assert out[2] is None and all(len(out[k]) == 4 for k in (0, 1, 3))
    import pyarrow as pa

    block = padded(pa.array([[1, 2, 3, 4, 9], [5]]), 3, 0)
    assert block.tolist() == [[1, 2, 9], [5, 0, 0]]


def test_pruned_before_the_shuffle(embedded):
    _, texts, vocabulary, _ = embedded
    plan = tokens.encode_ids(texts, vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "slice" in below


def test_duplicate_keys_fail(spark, vocabulary_of):
    vocabulary = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b"])
    twice = spark.createDataFrame([(1, "a b"), (1, "b")], "text_id bigint, text string")
    with pytest.raises(Exception, match="two texts have one key"):
        tokens.tokenize(twice, vocabulary).collect()
    with pytest.raises(TypeError):
        tokens.tokenize(twice, vocabulary, max_words=1)


def test_long_words_come_back_as_words(table_of, vocabulary_of):
    vocabulary = vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##ab"])
    texts = table_of(["ab" * 50 + " ab", "x" * 70])
    found = lexicon.segment(lexicon.count_words(word_table(texts)), vocabulary, value="token", named=True)
    pieces = {r.word: r.pieces for r in found.collect()}
    assert pieces == {"ab": ["ab"], "ab" * 50: ["ab", *["##ab"] * 49], "x" * 70: ["[UNK]"]}


@pytest.mark.parametrize("content", ["Text1|||Text2|||Text3\n", "a|||b|||\n", "a|||b|||", "|||a||||||b\n\n", "\n", "x", "a|||\n|||", "a\n|||||||||", "a\n||||||b|||\n", "\n\n"])
def test_delimited_files_are_those_read_whole(spark, tmp_path, content):
    for name in "ab":
        (tmp_path / name).write_text(content)
    read = S.read_delimited(spark, str(tmp_path), "|||").orderBy("file", "position").collect()
    whole = S.read_whole(spark, str(tmp_path), "|||").orderBy("file", "position").collect()
    assert [(r.file, r.position, r.text) for r in read] == [(r.file, r.position, r.text) for r in whole]


def test_delimited_files_in_many_blocks(spark, tmp_path):
    texts = [f"text {k} " + "x" * (k % 50) for k in range(3000)]
    (tmp_path / "f").write_text("\0".join(texts) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = S.read_delimited(spark, str(tmp_path / "f")).orderBy("position").collect()
        assert [r.text for r in read] == texts and [r.position for r in read] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reading_sorts_no_texts(spark, tmp_path):
    """Only rows per block are sorted or moved; texts stay where they are read."""
    (tmp_path / "f").write_text("\0".join(f"text {k}\n" for k in range(100)))
    for read in (S.read_delimited(spark, str(tmp_path / "f")), S.numbered_lines(spark, str(tmp_path / "f"))):
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        texts = next(line for line in plan.splitlines() if "text#" in line and "Relation" in line)
        above = plan[: plan.index(texts)]
        assert "Sort" not in above.split("Window")[0] and "Repartition" not in plan
        executed = read._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in executed and "SortMergeJoin" not in executed


def test_lines_of_many_files(spark, tmp_path):
    for name, count in (("a", 3), ("b", 0), ("c", 2)):
        (tmp_path / name).write_text("".join(f"{name}{k}\n\n" for k in range(count)))
    lines = S.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.line for r in lines] == list(range(10))
    assert [r.value for r in lines] == ["a0", "", "a1", "", "a2", "", "c0", "", "c1", ""]
    texts = S.read_delimited(spark, str(tmp_path), "\\n")
    assert [(r.line, r.text) for r in S.with_line(texts).orderBy("line").collect()] == list(enumerate(["a0", "a1", "a2", "c0", "c1"]))


def test_vectors_pair_with_texts_by_line(spark, tmp_path):
    rows = [(k, [float(k), -0.0]) for k in range(50)]
    files.write_text(spark.createDataFrame(rows, "text_id bigint, embedding array<float>").repartition(7), str(tmp_path / "out"))
    read = files.read_text(spark, str(tmp_path / "out")).orderBy("line").collect()
    assert [(r.line, r.embedding[0]) for r in read] == [(k, float(k)) for k in range(50)]
    assert all(r.value.endswith(" -0") for r in read)


def test_two_models_in_one_application(spark, tmp_path):
    names = []
    for number in (1, 2):
        (tmp_path / f"m{number}").mkdir()
        (tmp_path / f"m{number}" / "model.onnx").write_bytes(b"model %d" % number)
        (tmp_path / f"m{number}" / "vocab.txt").write_text("[PAD]\na\n")
        names.append(models.send_model(spark, str(tmp_path / f"m{number}")))
    assert len(set(names)) == 2 and models.send_model(spark, str(tmp_path / "m1")) == names[0]
    assert models.send_model(spark, (tmp_path / "m2").as_uri()) == names[1]
    for directory in (str(tmp_path / "m1"), (tmp_path / "m1").as_uri()):
        path = models.shared_vocabulary(spark, directory)
        assert [r.value.strip() for r in spark.read.text(path).collect()] == ["[PAD]", "a"]


def test_settled_tables_go_with_their_scope(spark):
    from pathlib import Path

    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir())
    with settled_scope(spark):
        assert settle(spark.range(10), "scoped").count() == 10
        assert set(folder.iterdir()) - before
    assert set(folder.iterdir()) == before


def test_evaluation_edges(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [-1.0, 0.0], "x"), (3, [0.0, 1.0], "y"), (4, [0.0, 2.0], "z")]
    labelled = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    drawn = spark.createDataFrame([(0, k) for k in (1, 2, 3)], "experiment int, vec_id bigint")
    means = evaluate.centroids(labelled, drawn, "vec_id")
    predicted = evaluate.nearest_centroid(labelled, means, "vec_id")
    assert {r.vec_id: r.prediction for r in predicted.collect()} == {1: "x", 2: "x", 3: "y", 4: "y"}
    assert [r.vec_id for r in evaluate.held_out(predicted, drawn, "vec_id").collect()] == [4]
    empty = spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<float>")
    assert profile.table_profile(empty).head()["mean"] is None


def test_ties_zeros_and_nulls(spark):
    ties = [k / 10**p for p in (2, 7, 9, 15, 20) for k in range(1234505, 1236000, 10)]
    values = [-0.0, *ties, *[-x for x in ties], 1234565.0, 12345.25, 123456.5, 1e300, -1e-300]
    line = spark.createDataFrame([(values,)], "v array<double>").select(V.format_vector(F.col("v")).alias("line")).head().line
    assert line.split() == ["%g" % x for x in values]
    state = spark.sql("select array(1.0D, null) as v").select(V.status(F.col("v")).alias("s")).head().s
    assert state == "not_finite"
