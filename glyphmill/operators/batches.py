"""Numbered batches of texts, and batches laid out as one flat tensor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.embed import BATCH_SIZE
from glyphmill.operators.words import with_ordinal


def with_batch(texts: DataFrame, *order: str | Column, batch_size: int | None = None) -> DataFrame:
    """Add ``batch_id`` and ``batch_row``: consecutive chunks in the given order, the last one short."""
    size = F.lit(batch_size or BATCH_SIZE)
    numbered = with_ordinal(texts, *order, name="_ordinal")
    return numbered.select(
        *texts.columns,
        F.floor(F.col("_ordinal") / size).cast("bigint").alias("batch_id"),
        (F.col("_ordinal") % size).cast("bigint").alias("batch_row"),
    )


def batch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_id").agg(F.count("*").alias("texts"))


def flat_batch(encoded: DataFrame, keys: Sequence[str], ids: str = "input_ids") -> DataFrame:
    """Row-major places of all values in the tensor of their batch.

    ``(batch_id, place, value)`` with ``place = row * length + position``, from rows
    that carry ``batch_id`` and ``batch_row``.
    """
    rows = encoded.select("batch_id", "batch_row", F.size(ids).alias("length"), F.posexplode(ids).alias("pos", "value"))
    place = F.col("batch_row") * F.col("length") + F.col("pos")
    return rows.select("batch_id", place.cast("bigint").alias("place"), F.col("value").cast("bigint").alias("value"))
