"""Embedding from SQL, on tables of texts: ``select * from embed_texts(table(select id, text from corpus))``.

A Python table function: ``analyze`` gives the result the columns of the table it is called on, so
one registration serves every table. Rows stay in the partitions they come in; a worker
gathers them into batches for the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from glyphmill.functions.ids import MAX_LENGTH
from glyphmill.functions.pieces import Segmenter, model_sequence, sent_ids
from glyphmill.operators.embed import BATCH_SIZE, VECTOR, Encoder, _attempt, _vectors
from glyphmill.session import BROADCAST_BYTES, ship
from glyphmill.sources.vocabulary import Vocabulary


def _result_schema(table: AnalyzeArgument, text: AnalyzeArgument | None, report_errors: bool) -> StructType:
    """The columns of the table without its texts, then ``embedding`` and, if asked for, ``error``."""
    if not table.isTable:
        raise ValueError("the first argument is a table: embed_texts(table(select id, text from corpus))")
    name = "text" if text is None else text.value
    if name not in table.dataType.names:
        raise ValueError(f"the table has no column {name!r} of texts, only {', '.join(table.dataType.names)}")
    if not isinstance(table.dataType[name].dataType, StringType):
        raise ValueError(f"the column {name!r} holds no texts")
    added = ["embedding", *(["error"] if report_errors else [])]
    if clash := [c for c in added if c in table.dataType.names]:
        raise ValueError(f"the table has a column {clash[0]!r} already")
    schema = StructType([field for field in table.dataType if field.name != name])
    schema = schema.add("embedding", ArrayType(FloatType()))
    return schema.add("error", StringType()) if report_errors else schema


def register_texts(
    spark: SparkSession,
    name: str,
    vocabulary: Vocabulary,
    encoder: Encoder,
    batch_size: int | None = None,
    length: int = MAX_LENGTH,
    report_errors: bool = False,
    limit: int = BROADCAST_BYTES,
) -> None:
    """Make ``name(table(...), text => 'column')`` a table function: the table's columns, its texts replaced by vectors.

    The vectors are those of ``embed``. Workers cut words by a vocabulary they hold, so one beyond ``limit`` bytes is refused.
    """
    ship(spark)
    ids, special, unknown = sent_ids(vocabulary, limit), vocabulary.special, vocabulary.unk_piece
    size = batch_size or BATCH_SIZE

    class EmbedTexts:
        def __init__(self):
            self.rows: list[tuple] = []
            self.sequences: list[list[int]] = []
            self.pieces = None

        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None) -> AnalyzeResult:
            return AnalyzeResult(_result_schema(table, text, report_errors))

        def eval(self, table: Row, text: str = "text") -> Iterator[tuple]:
            if self.pieces is None:
                self.pieces = Segmenter(ids.value, unknown)
                encoder.load()
            self.sequences.append(model_sequence(table[text], self.pieces, special, length))
            self.rows.append(tuple(table[field] for field in table.__fields__ if field != text))
            if len(self.rows) >= size:
                yield from self._run()

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                yield from self._run()

        def _run(self) -> Iterator[tuple]:
            rows, sequences = self.rows, pa.array(self.sequences, pa.list_(pa.int32()))
            self.rows, self.sequences = [], []
            if report_errors:
                found = pa.concat_arrays(list(_attempt(encoder, sequences, special.pad, length)))
                ends = zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True)
            else:
                vectors = _vectors(encoder, sequences, special.pad, length).cast(VECTOR)
                ends = ((vector,) for vector in vectors.to_pylist())
            for row, end in zip(rows, ends, strict=True):
                yield (*row, *end)

    spark.udtf.register(name, udtf(EmbedTexts, useArrow=True))
