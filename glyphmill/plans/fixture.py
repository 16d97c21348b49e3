"""Test vocabulary and test encoder: no model or vocabulary file comes with the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.lexicon import count_words
from glyphmill.operators.words import with_ordinal, word_table
from glyphmill.session import settle, spread
from glyphmill.sources.vocabulary import CLS, PAD, SEP, UNK, Vocabulary

WIDTH = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text"), "text_id")


def vocabulary_entries(documents: DataFrame) -> DataFrame:
    """``(token_id, token)`` learnt from the words of a corpus.

    Frequent plain words, the first three letters of any plain word, its last two
    as an inner piece, every single sign, and every inner letter.
    """
    counted = count_words(word_table(documents, ()))
    plain = F.col("word").rlike(r"\A[a-z0-9]+\z")
    tokens = F.array_compact(
        F.array(
            F.when(plain & (F.col("n") >= 5), F.col("word")),
            F.when(plain, F.substring("word", 1, 3)),
            F.when(plain & (F.length("word") > 3), F.concat(F.lit("##"), F.right(F.col("word"), F.lit(2)))),
            F.when(F.col("word").rlike(r"\A[^a-z0-9]\z"), F.col("word")),
        )
    )
    spark = documents.sparkSession
    letters = spark.range(26).select(F.concat(F.lit("##"), F.char(F.col("id") + 97)).alias("token"))
    learnt = counted.select(F.explode(tokens).alias("token")).union(letters).distinct()
    numbered = with_ordinal(learnt, "token").select((F.col("ordinal") + 4).cast("int").alias("token_id"), "token")
    special = [(i, token) for i, token in enumerate([PAD, UNK, CLS, SEP])]
    return numbered.union(spark.createDataFrame(special, numbered.schema))


_learnt: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(spark: SparkSession, folder: str) -> Vocabulary:
    """The vocabulary of ``documents``, learnt once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _learnt:
        entries = settle(vocabulary_entries(texts(spark, folder)), "vocabulary")
        _learnt[key] = Vocabulary.from_entries(entries)
    return _learnt[key]


class MixingEncoder:
    """A stand-in for a model whose results are exact, so that SQL can give the same.

    Its state at the first position is the sum, over the unmasked positions, of
    integer weights made from id and dimension by a formula.
    """

    def load(self) -> None:
        self.dimensions = np.arange(WIDTH, dtype=np.int64)

    def __call__(self, input_ids, token_type_ids, attention_mask):
        d = self.dimensions
        ids = input_ids[:, :, None]
        weights = (31 * ids + 17 * d + 7 * ids * d) % 101 - 50
        summed = (weights * attention_mask[:, :, None]).sum(axis=1)
        return summed[:, None, :].astype(np.float32)


class PickyEncoder(MixingEncoder):
    """Fails on every chunk that holds a text whose second id leaves 3 when divided by 7."""

    def __call__(self, input_ids, token_type_ids, attention_mask):
        if (input_ids[:, 1] % 7 == 3).any():
            raise ValueError("a text the model refuses")
        return super().__call__(input_ids, token_type_ids, attention_mask)
