"""Sinks: vectors as text lines or Parquet, scores as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.vectors import format_vector
from glyphmill.operators.quality import read_lines
from glyphmill.session import settle
from glyphmill.sources.texts import numbered_lines


def write_text(vectors: DataFrame, path: str, *keys: str, column: str = "embedding") -> None:
    """A vector per line, in key order over the files: values in six digits, one space between.

    Sorting looks at its input twice, so the lines are settled first: the model behind them runs once.
    """
    keys = keys or ("text_id",)
    lines = settle(vectors.select(*keys, format_vector(F.col(column)).alias("value")), "lines")
    lines.orderBy(*keys).select("value").write.text(path)


def write_parquet(vectors: DataFrame, path: str, *partitions: str) -> None:
    """Vectors as typed columns, without loss."""
    vectors.write.partitionBy(*partitions).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(texts: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A table bucketed by its keys: tokenising it needs no shuffle of the texts."""
    texts.write.bucketBy(buckets, *keys).saveAsTable(table)


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of numbers back as vectors: ``(line, value, embedding, status)``.

    ``line`` counts the lines from 0 in the order they were written, blank ones included:
    by file, place of the block in the file, and row in the block.
    """
    return read_lines(numbered_lines(spark, path))
