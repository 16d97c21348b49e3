import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X


def one(spark, value, *functions):
    row = spark.createDataFrame([(value,)], "text string")
    return list(row.select(*[f(F.col("text")) for f in functions]).head())


@pytest.mark.parametrize(
    "text, processed",
    [
        ("Hello, World! ÉTÉ a-b", "hello , world ! ÉtÉ a-b"),
        ("", ""),
        ("   ", ""),
        (None, ""),
        ("a b", "a b"),
        ("a\t\n\x0b\f\rb", "a b"),
        ("(x)[y]{z}\"'", "( x ) [ y ] { z } \" '"),
        ("a/b @c d_e", "a/b @c d_e"),
        ("İIß", "İiß"),
    ],
)
def test_preprocess_and_words(spark, text, processed):
    assert one(spark, text, X.preprocess, X.words) == [processed, processed.split(" ") if processed else []]


def test_words_are_those_of_the_processed_text(spark, small):
    from glyphmill.plans.fixture import texts

    split = F.filter(F.split(X.preprocess(F.col("text")), " "), lambda w: w != "")
    assert texts(spark, small).filter(~X.words(F.col("text")).eqNullSafe(split)).count() == 0


def test_single_steps(spark):
    assert one(spark, "ÀBÇ Z", X.ascii_lower) == ["ÀbÇ z"]
    assert one(spark, "a.b", X.isolate_punctuation) == ["a . b"]
    assert one(spark, " \t\r\n a\x0b b \n", X.trim_ends) == ["a\x0b b"]
    assert one(spark, " a \t b ", X.collapse_whitespace) == [" a b "]


def test_preview(spark):
    assert one(spark, "x" * 50, X.preview) == ["x" * 50]
    assert one(spark, "x" * 51, X.preview) == ["x" * 50 + "..."]
    assert one(spark, "é" * 25, X.preview) == ["é" * 25]
    # 49 bytes and a letter of two: the cut falls before the letter.
    assert one(spark, "x" * 49 + "éé", X.preview) == ["x" * 49 + "..."]


def test_expressions_stay_in_generated_code(spark, small):
    from glyphmill.plans.fixture import table

    plan = table(spark, small, "documents").select("doc_id", X.preprocess(F.col("text")).alias("t"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Python" not in text
