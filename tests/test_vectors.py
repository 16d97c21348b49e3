import math

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import vectors as V
from glyphmill.operators import quality
from glyphmill.operators.profile import run_counts, table_profile, vector_profile
from glyphmill.sinks import files

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(spark):
    return lambda *rows: spark.createDataFrame(list(enumerate(rows)), "text_id bigint, embedding array<double>")


def column(df, expression):
    return [r[0] for r in df.orderBy("text_id").select(expression).collect()]


def test_normalise(vectors):
    found = column(vectors([3.0, 4.0], [0.0, 0.0], [], [NAN, 1.0]), V.l2_normalize(F.col("embedding")))
    assert found[0] == pytest.approx([0.6, 0.8]) and found[1:3] == [[0.0, 0.0], []]
    assert math.isnan(found[3][0]) and found[3][1] == 1.0


def test_cosine(spark):
    pairs = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 1.0]), (1, [1.0], [0.0])], "text_id int, a array<float>, b array<float>")
    found = column(pairs, V.cosine(F.col("a"), F.col("b")))
    assert found[0] == pytest.approx(math.sqrt(0.5)) and found[1] is None


def test_status(vectors):
    table = vectors([], [1.0, NAN], [INF], [-INF, 0.0], [1.0], None)
    assert column(table, V.status(F.col("embedding"))) == ["empty", "not_finite", "not_finite", "not_finite", "ok", "empty"]
    good, bad = quality.quarantine(table)
    assert [r.text_id for r in good.collect()] == [4] and bad.count() == 5
    assert quality.require_good(good).count() == 1
    with pytest.raises(Exception, match="vector of 1 is not_finite"):
        quality.require_good(table.filter("text_id = 1")).collect()


def test_lines(spark):
    lines = ["1.5 x 2", "  ", "", "1 2.5 -3e2", "nan 1", "inf", "1d 2", "0x1 2", "\t1   2 ", ".5 1."]
    rows = spark.createDataFrame(list(enumerate(lines)), "text_id int, value string")
    found = {r.text_id: r for r in quality.read_lines(rows).collect()}
    assert sorted(found) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert {k: r.status for k, r in found.items()} == {
        0: "unreadable", 3: "ok", 4: "not_finite", 5: "not_finite", 6: "unreadable", 7: "unreadable", 8: "ok", 9: "ok"
    }
    assert found[3].embedding == [1.0, 2.5, -300.0] and found[0].value == "1.5 x 2"
    assert found[8].embedding == [1.0, 2.0] and found[9].embedding == [0.5, 1.0]


def test_format(vectors):
    values = [0.1234, 1.5e-5, 0.0, 1234567.0, -0.5, 100000.0, 1e6, 999999.5, 0.1015625, 1.015625, 3.0, 1e300, -1e-300, 123456.5]
    pick = [x / 7919 for x in range(1, 2000, 3)]
    for listed in (values, pick):
        line = column(vectors(listed), V.format_vector(F.col("embedding")))[0]
        assert line == " ".join("%g" % x for x in listed)
    assert column(vectors([NAN, INF, -INF]), V.format_vector(F.col("embedding"))) == ["nan inf -inf"]


def test_cardinality(spark, table_of):
    texts = table_of(["a", "", "b"])
    embedded = texts.filter("text <> ''")
    assert quality.cardinality(texts, embedded, "text_id").head() == (3, 2, 1, 0, False)
    assert quality.unpaired(texts, embedded, "text_id").collect() == [(1, 1, 0)]
    assert quality.cardinality(texts, texts, "text_id").head().complete
    assert quality.cardinality(embedded, texts, "text_id").head().extra == 1


def test_text_sink_round_trip(spark, vectors, tmp_path):
    table = vectors([0.123456789, -2.0], [1e-7, 3.0], [0.0, 12345678.0])
    files.write_text(table, str(tmp_path / "lines"))
    read = files.read_text(spark, str(tmp_path / "lines"))
    assert {r.value for r in read.collect()} == {"0.123457 -2", "1e-07 3", "0 1.23457e+07"}
    assert {r.status for r in read.collect()} == {"ok"}
    files.write_parquet(table.withColumn("part", F.col("text_id") % 2), str(tmp_path / "typed"), "part")
    assert spark.read.parquet(str(tmp_path / "typed")).select(*table.columns).exceptAll(table).count() == 0


def test_profiles(spark, vectors, vocabulary_of):
    table = vectors([1.0, -2.0, 4.0], [0.5] * 7)
    rows = vector_profile(table).orderBy("text_id").collect()
    assert tuple(rows[0])[1:] == (3, -2.0, 4.0, 1.0, [1.0, -2.0, 4.0]) and rows[1].head == [0.5] * 5
    assert table_profile(table).head() == (2, 3, 7, -2.0, 4.0, pytest.approx(0.65))
    counts = run_counts(table, table, vocabulary_of(["[PAD]", "x"])).head()
    assert tuple(counts) == (2, 2, 7, 2, 0, 100, 101, 102)
