"""A text model as one object: vocabulary and encoder of a model directory."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.ids import MAX_LENGTH
from glyphmill.functions.pieces import closed
from glyphmill.functions.text import words_of
from glyphmill.operators.embed import BATCH_SIZE, Encoder, OnnxEncoder, embed, embedding
from glyphmill.operators.lexicon import Lexicon
from glyphmill.operators.table_function import register_texts
from glyphmill.operators.tokens import KEYS
from glyphmill.operators.word_cache import WordCache
from glyphmill.session import ship
from glyphmill.sources.model import send_model, shared_vocabulary
from glyphmill.sources.texts import from_strings
from glyphmill.sources.vocabulary import Vocabulary

FEW = 4096  # Strings of a call that count as a handful.


@dataclass(frozen=True)
class TextModel:
    vocabulary: Vocabulary
    encoder: Encoder
    batch_size: int = BATCH_SIZE
    words: WordCache = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", WordCache(self.vocabulary))

    @classmethod
    def from_directory(cls, spark: SparkSession, directory: str | None = None) -> TextModel:
        """Load ``vocab.txt`` and send the ONNX file of a directory to the executors."""
        return cls(Vocabulary.from_file(spark, shared_vocabulary(spark, directory)), OnnxEncoder(send_model(spark, directory)))

    def embed(
        self, texts: DataFrame, keys: Sequence[str] = KEYS, lexicon: Lexicon | None = None, **options
    ) -> DataFrame:
        """One unit vector for every text of a table."""
        options.setdefault("batch_size", self.batch_size)
        return embed(texts, self.vocabulary, self.encoder, lexicon, keys, **options)

    def register(self, spark: SparkSession, name: str = "embed_texts", **options) -> None:
        """Make the model a table function of SQL: ``select * from embed_texts(table(select id, text from corpus))``."""
        options.setdefault("batch_size", self.batch_size)
        register_texts(spark, name, self.vocabulary, self.encoder, **options)

    def encode(self, sentences: str | list[str], batch_size: int | None = None, **ignored) -> list[list[float]]:
        """The vectors of strings in memory, in their order; a bare string is a list of one.

        For a handful of strings: they start and end on the driver, and words met before
        are not segmented again, so such a call is one job of one stage. With more than ``FEW``
        strings, or more new words than are remembered, they go the way of tables, through ``embed``.
        """
        spark = self.vocabulary.entries.sparkSession
        listed = [sentences] if isinstance(sentences, str) else list(sentences)
        size = batch_size or self.batch_size
        if not listed:
            return []
        split = [words_of(text)[: MAX_LENGTH - 1] for text in listed[: FEW + 1]]
        distinct = set(chain.from_iterable(split))
        if len(listed) > FEW or len(distinct) > self.words.words:
            rows = self.embed(from_strings(spark, listed), batch_size=size)
            return [row.embedding for row in rows.orderBy("text_id").collect()]
        ids, special = self.words.ids_of(distinct), self.vocabulary.special
        cut = [closed(chain.from_iterable(ids[word] for word in words), special) for words in split]
        ship(spark)
        columns = {"text_id": pa.array(range(len(cut)), pa.int64()), "token_ids": pa.array(cut, pa.list_(pa.int32()))}
        table = spark.createDataFrame(pa.table(columns)).coalesce(min(-(-len(cut) // size), spark.sparkContext.defaultParallelism))
        vectors = embedding(F.col("token_ids"), self.encoder, special.pad, size).alias("embedding")
        return [row.embedding for row in sorted(table.select("text_id", vectors).collect())]
