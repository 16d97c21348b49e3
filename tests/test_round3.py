"""Tasks of a bounded size: what a task gathers follows the input no more."""

import glob
import re

from pyspark.sql import functions as F

from glyphmill import build_lexicon, tokenize
from glyphmill.operators import quality, tokens
from glyphmill.plans import fixture, queries
from glyphmill.sources import texts as text_sources
from glyphmill.streaming import lexicon_state as L

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "ab", "##c", "d", "."]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_tokens(spark, vocabulary_of, monkeypatch):
    monkeypatch.setattr(tokens, "TASK_TOKENS", 100, raising=False)
    texts = spark.range(300).selectExpr("id as text_id", "repeat('abc d ', 5) as text")
    own = vocabulary_of(TOKENS)
    expected = {i: [2] + [4, 5, 6] * 5 + [3] for i in range(300)}
    lexicon = build_lexicon(texts, own)
    assert lexicon.tokens == 4500
    for limit in (1 << 20, 0):
        found = tokenize(texts, own, limit=limit)
        assert "hashpartitioning(text_id" in plan(found) and re.search(r"hashpartitioning\(text_id#\w+, 45\)", plan(found))
        assert {r.text_id: r.token_ids for r in found.collect()} == expected
    # The lexicon of many texts asks for no more tasks than few texts fill: 1 text has 30 bytes.
    few = tokenize(texts.filter("text_id = 7"), own, lexicon)
    assert ", 45)" not in plan(few) and [r.token_ids for r in few.collect()] == [expected[7]]


def test_tokens_are_printed_where_they_lie(spark, small):
    """Texts are moved once, by the tokenising; their tokens are not moved again."""
    assert plan(queries.detokenize(spark, small)).count("REPARTITION_BY_COL") == 1


def test_pairs_are_counted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIRING_ROWS", 10, raising=False)
    texts = spark.range(200).select("id", (F.col("id") % 7).alias("k"))
    vectors = texts.filter("id % 20 <> 0").union(texts.filter("id = 3"))
    paired = quality.pairing(texts, vectors, "id", "k")
    assert re.search(r"hashpartitioning\(id#\w+, k#\w+, 40\)", plan(paired))
    lacking = {(i, i % 7, 1, 0) for i in range(0, 200, 20)} | {(3, 3, 1, 2)}
    assert {tuple(r) for r in quality.unpaired(texts, vectors, "id", "k").collect()} == lacking
    counts = quality.cardinality(texts, vectors, "id", "k").head()
    assert (counts.texts, counts.vectors, counts.missing, counts.extra, counts.complete) == (200, 191, 10, 1, False)


def test_a_file_in_parts(spark, tmp_path):
    """The parts of a folder are one file; a newline at the very end of the last part goes."""
    for name, content in {
        "a/part-00000": "one\0two\n\0\0", "a/part-00001": "three\0", "a/part-00002": "four\0five\n", "b/part-00003": "six\n\0",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content.encode())
    found = text_sources.read_delimited(spark, f"{tmp_path}/*", parts=True).collect()
    assert sorted((r.file[-1], r.position, r.text) for r in found) == [
        ("a", 0, "one"), ("a", 1, "two\n"), ("a", 2, "three"), ("a", 3, "four"), ("a", 4, "five"), ("b", 0, "six\n"),
    ]


def test_a_language_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 900, numPartitions=3).selectExpr("id as doc_id", "'en' as lang", "concat('text ', id) as text")
    rows.select("doc_id", "lang", F.concat("text", F.repeat(F.sha2(F.col("text"), 512), 200)).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries.delimited_file(spark, str(tmp_path)).selectExpr("file", "position", "split(text, ' ')[1] as at").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r.file, r.position) for r in found) == [("en", i) for i in range(900)]
    assert all(r["at"].startswith(str(r.position)) for r in found)
    written = [len(glob.glob(f"{p}/lang=en/part-*")) for p in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/texts-*")]
    assert max(written) > 1


def test_runs_of_a_text_by_bucket(spark, vocabulary_of, tmp_path):
    """The words of a bucket come in one run each, whatever their order in the text, empty texts included."""
    rows = [(0, "ab abc d. ab abc zz ab"), (1, ""), (2, None), (3, "d " * 300 + "ab"), (4, "zz")]
    spark.createDataFrame(rows, "text_id bigint, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text_id bigint, text string").parquet(f"{tmp_path}/in")
    own, partitions = vocabulary_of(TOKENS), spark.conf.get("spark.sql.shuffle.partitions")
    L.tokenize_stream(stream, own, f"{tmp_path}/out", f"{tmp_path}/state", buckets=2).awaitTermination(180)
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    expected = {r.text_id: r.token_ids for r in tokenize(texts, own).collect()}
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.text_id: r.token_ids for r in found} == expected and len(found) == 5
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    assert '"spark.sql.shuffle.partitions":"2"' in next((tmp_path / "state/offsets").glob("0")).read_text()
