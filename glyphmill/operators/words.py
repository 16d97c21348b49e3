"""The word table of a corpus, and row numbers that need no single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import words
from glyphmill.session import settle

# Words are matched by a key of bounded width. No word contains a space, so the
# digest of a long word cannot be mistaken for another word.
KEY_BYTES = 64


def word_key(word: Column) -> Column:
    digest = F.concat(F.lit(" "), F.sha2(word.cast("binary"), 256))
    return F.when(F.octet_length(word) <= KEY_BYTES, word).otherwise(digest)


def first_words(text: Column, count: int) -> Column:
    """The first words of a text, one space between; ``split_words`` takes them apart."""
    return F.array_join(F.slice(words(text), 1, count), " ")


def split_words(joined: Column) -> Column:
    return F.filter(F.split(joined, " "), lambda word: word != "")


def word_table(
    texts: DataFrame,
    keys: Sequence[str] = ("text_id",),
    text: str = "text",
    max_words: int | None = None,
    listed: Column | None = None,
) -> DataFrame:
    """One row per word: ``(keys, wpos, word)``. A text without words keeps one row of NULLs.

    ``listed`` gives the words of texts that are split otherwise.
    """
    listed = words(F.col(text)) if listed is None else listed
    if max_words is not None:
        listed = F.slice(listed, 1, max_words)
    return texts.select(*keys, F.posexplode_outer(listed).alias("wpos", "word"))


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order.

    A window without a partition would sort everything in one task. Here the
    rows are range-sorted and numbered inside each range; the ranges' sizes, one
    row per range, then give every range its first number.
    """
    inside = (1 << 33) - 1  # monotonically_increasing_id keeps the row of a partition in 33 bits
    ranged = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("rows"))
        .select("_range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    )
    numbered = ranged.join(F.broadcast(starts), "_range")
    ordinal = F.col("_start") + F.col("_at").bitwiseAND(F.lit(inside))
    return numbered.select(*df.columns, ordinal.alias(name))
