"""Profiles of embedding tables and counts of a run."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.vectors import profile
from glyphmill.operators.embed import Encoder, embed
from glyphmill.operators.lexicon import Lexicon
from glyphmill.session import settle_measured
from glyphmill.sources.vocabulary import Vocabulary


def vector_profile(vectors: DataFrame, key: str = "text_id", column: str = "embedding") -> DataFrame:
    """Dimension, range, mean and first values of every vector."""
    return vectors.select(key, *profile(F.col(column)))


def table_profile(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The same over a whole table, in one row; a vector is reduced before anything moves."""
    own = vectors.select(
        F.size(column).alias("dimension"),
        F.array_min(F.col(column).cast("array<double>")).alias("lowest"),
        F.array_max(F.col(column).cast("array<double>")).alias("highest"),
        F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x).alias("total"),
    )
    return own.agg(
        F.count("*").alias("vectors"),
        F.min("dimension").cast("bigint").alias("least_dimension"),
        F.max("dimension").cast("bigint").alias("most_dimension"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.when(F.sum("dimension") > 0, F.sum("total") / F.sum("dimension")).alias("mean"),
    )


def counted_run(
    texts: DataFrame, embedded: DataFrame, vocabulary: Vocabulary, column: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """The embeddings, settled, and one row: texts read, embeddings made, their width, vocabulary size, special ids.

    The counts are taken while the embeddings are written, so the model runs once.
    """
    table, counted = settle_measured(embedded, "embedded", embeddings=F.count(F.lit(1)), dimension=F.max(F.size(column)))
    facts = {
        "embeddings": counted["embeddings"],
        "dimension": counted["dimension"],
        "vocabulary_size": vocabulary.tokens,
        **{f"{name}_id": value for name, value in vars(vocabulary.special).items()},
    }
    counts = texts.agg(F.count(F.lit(1)).alias("texts"))
    return table, counts.select("*", *[F.lit(value).cast("bigint").alias(name) for name, value in facts.items()])


def run_counts(texts: DataFrame, embedded: DataFrame, vocabulary: Vocabulary, column: str = "embedding") -> DataFrame:
    """The counts of ``counted_run`` alone."""
    return counted_run(texts, embedded, vocabulary, column)[1]


# Texts per model call whose throughput is compared.
CALL_SIZES = (1, 2, 8)


def throughput(
    texts: DataFrame, vocabulary: Vocabulary, encoder: Encoder, lexicon: Lexicon, sizes: Sequence[int] = CALL_SIZES, **options
) -> DataFrame:
    """``(batch_size, texts, vectors, seconds, texts_per_second)``: a whole table embedded once with each batch size.

    The vectors are counted as they leave the model and not kept.
    """
    rows = []
    for size in sizes:
        start = time.perf_counter()
        vectors = embed(texts, vocabulary, encoder, lexicon, batch_size=size, **options)
        texts_, found = vectors.agg(F.count(F.lit(1)), F.count("embedding")).head()
        seconds = time.perf_counter() - start
        rows.append((size, texts_, found, seconds, texts_ / seconds))
    schema = "batch_size int, texts bigint, vectors bigint, seconds double, texts_per_second double"
    return texts.sparkSession.createDataFrame(rows, schema)
