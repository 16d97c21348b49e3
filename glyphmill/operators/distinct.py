"""Embedding a table in which texts repeat: each different text goes through the model once.

The model sees the first words of a text, so these decide what is equal. Groups are keyed by their digest and
compared in full: the words themselves are part of the grouping, and two groups under one digest fail the job. Copies are
counted before the shuffle, so a text in any share of the rows moves once per task. The vectors come
back by digest; those of texts with many rows are broadcast, so no task gathers the rows of one text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.ids import MAX_LENGTH
from glyphmill.operators.embed import Encoder, embed
from glyphmill.operators.lexicon import Lexicon
from glyphmill.operators.tokens import KEYS
from glyphmill.operators.words import first_words
from glyphmill.session import BROADCAST_BYTES, settle_measured
from glyphmill.sources.vocabulary import Vocabulary


def distinct_texts(texts: DataFrame, length: int = MAX_LENGTH) -> DataFrame:
    """``(digest, text, copies)``: the different model inputs of a table, with the number of rows that have them."""
    seen = first_words(F.col("text"), max(length - 1, 1)).alias("text")
    keyed = texts.select(seen).withColumn("digest", _digest("text"))
    return keyed.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("copies"))


def _digest(column: str):
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def embed_distinct(
    texts: DataFrame,
    vocabulary: Vocabulary,
    encoder: Encoder,
    lexicon: Lexicon | None = None,
    keys: Sequence[str] = KEYS,
    batch_size: int | None = None,
    length: int = MAX_LENGTH,
    report_errors: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``embed``, with every different text embedded once. Vectors of at most ``limit`` bytes are broadcast.

    If all vectors fit they all are; else those of the most frequent texts, so that any other
    text has no more rows than all rows divided by the number of vectors that fit.
    """
    different, counted = settle_measured(distinct_texts(texts, length), "distinct", rows=F.sum("copies"))
    vectors = embed(
        different.select("digest", "text"), vocabulary, encoder, lexicon, ("digest",), batch_size, length, report_errors
    )
    size = F.coalesce(F.size("embedding"), F.lit(0)) * 4 + 96
    vectors, measured = settle_measured(vectors, "vectors", bytes=F.sum(size), widest=F.max(size))
    seen = first_words(F.col("text"), max(length - 1, 1))
    rows = texts.select(*keys, seen.alias("_seen")).withColumn("digest", _digest("_seen")).drop("_seen")
    if (measured["bytes"] or 0) <= limit:
        return rows.join(F.broadcast(vectors), "digest").drop("digest")
    most = max(limit // measured["widest"], 1)
    often = F.col("copies") > -(-counted["rows"] // most)  # fewer than ``most`` texts have so many rows
    frequent = different.filter(often).select("digest")
    near = vectors.join(F.broadcast(frequent), "digest", "left_semi")
    hot = rows.join(F.broadcast(near), "digest")
    rare = rows.join(F.broadcast(frequent), "digest", "left_anti").join(vectors.hint("merge"), "digest")
    return hot.unionByName(rare).drop("digest")
