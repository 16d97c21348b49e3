"""Embedding: encoded texts through a model, in Arrow batches on the executors.

The model is a plug-in. Spark hands every Python worker Arrow batches of token
ids; the worker opens the model once and runs it on consecutive chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.ids import MAX_LENGTH, attention_mask, token_types, widen
from glyphmill.operators.lexicon import Lexicon
from glyphmill.operators.tokens import KEYS, encode_ids, model_ids
from glyphmill.session import ship
from glyphmill.sources.vocabulary import Vocabulary

# Fixed value: texts per model call unless a size is given.
BATCH_SIZE = 64


class Encoder(Protocol):
    """A model: loaded once per worker, then called with ``[batch, length]`` int64 arrays."""

    def load(self) -> None: ...

    def __call__(self, input_ids: np.ndarray, token_type_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray:
        """Hidden states, ``[batch, positions, width]`` float32."""
        ...


@lru_cache(maxsize=2)
def _open_session(path: str, threads: int):
    """The session of a model file, opened once per Python worker and kept between tasks."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


class OnnxEncoder:
    """An ONNX text model. Inputs are bound by name, the first output is used.

    ``path`` is the model file: a path every executor can read, or the bare name
    of a file sent with ``SparkContext.addFile``.
    """

    def __init__(self, path: str, threads: int = 1):
        self.path, self.threads = path, threads  # a Spark task has one core unless told otherwise

    def load(self) -> None:
        path = self.path if "/" in self.path else SparkFiles.get(self.path)
        self.session = _open_session(path, self.threads)

    def __call__(self, input_ids, token_type_ids, attention_mask):
        given = {"input_ids": input_ids, "token_type_ids": token_type_ids, "attention_mask": attention_mask}
        wanted = [node.name for node in self.session.get_inputs()]
        return self.session.run(None, {name: given[name] for name in wanted})[0]


def padded(ids: pa.ListArray, length: int, pad_id: int) -> np.ndarray:
    """Lists of ids as one ``[rows, length]`` int64 array, filled up with the pad id.

    A longer list is cut and keeps its last id, the separator, at the end.
    """
    bounds = ids.offsets.to_numpy()
    sizes = np.diff(bounds)
    block = np.full((len(ids), length), pad_id, dtype=np.int64)
    rows = np.repeat(np.arange(len(ids)), sizes)
    places = np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], sizes)
    values = ids.values.to_numpy()[bounds[0] : bounds[-1]]
    inside = places < length
    block[rows[inside], places[inside]] = values[inside]
    long = np.flatnonzero(sizes > length)
    block[long, length - 1] = values[bounds[long + 1] - bounds[0] - 1]
    return block


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Every row divided by its length; rows whose length is 0 or NaN stay."""
    vectors = vectors.astype(np.float64)
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, lengths, out=vectors, where=lengths > 0)


def _as_lists(vectors: np.ndarray) -> pa.ListArray:
    rows, width = vectors.shape
    offsets = pa.array(np.arange(rows + 1) * width, type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.astype(np.float32).ravel()))


def _vectors(encoder: Encoder, ids: pa.ListArray, pad_id: int, length: int) -> pa.ListArray:
    """The vectors of a chunk; a NULL list gets none."""
    given = ids.drop_null()
    if not len(given):
        return pa.nulls(len(ids), VECTOR)
    block = padded(given, length, pad_id)
    mask = (block != pad_id).astype(np.int64)
    states = encoder(block, np.zeros_like(block), mask)
    if len(states) != len(given):
        raise ValueError(f"the model gave {len(states)} states for {len(given)} texts")
    found = _as_lists(unit_rows(states[:, 0, :]))
    if not ids.null_count:
        return found
    place = np.cumsum(ids.is_valid().to_numpy(zero_copy_only=False)) - 1
    return found.take(pa.array(place, mask=ids.is_null().to_numpy(zero_copy_only=False)))


def _chunks(batch: pa.Array, size: int) -> Iterator[pa.Array]:
    return (batch.slice(start, size) for start in range(0, len(batch), size))


VECTOR = pa.list_(pa.float32())


def _failing_udf(encoder: Encoder, pad_id: int, size: int, length: int):
    """Vectors; a model error fails the task.

    Not deterministic to Spark: a filter on the vectors must not run the model again.
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder.load()
        for batch in batches:
            yield pa.concat_arrays(
                [pa.array([], VECTOR), *(_vectors(encoder, ids, pad_id, length) for ids in _chunks(batch, size))]
            )

    return run.asNondeterministic()


def _attempt(encoder: Encoder, ids: pa.Array, pad_id: int, length: int) -> Iterator[pa.StructArray]:
    """The vectors of a chunk with their errors; a chunk that fails is halved until the failing texts are alone.

    So one bad text among ``n`` costs about ``2 * log2(n)`` more calls and no vector but its own.
    """
    try:
        vectors, errors = _vectors(encoder, ids, pad_id, length), pa.nulls(len(ids), pa.string())
    except Exception as error:  # noqa: BLE001
        if len(ids) > 1:
            middle = len(ids) // 2
            yield from _attempt(encoder, ids[:middle], pad_id, length)
            yield from _attempt(encoder, ids[middle:], pad_id, length)
            return
        vectors, errors = pa.nulls(1, VECTOR), pa.array([str(error) or type(error).__name__], pa.string())
    yield pa.StructArray.from_arrays([vectors, errors], ["embedding", "error"])


def _reporting_udf(encoder: Encoder, pad_id: int, size: int, length: int):
    """Vectors and errors; a text the model fails on has no vector, and its row tells why."""

    @F.arrow_udf("embedding array<float>, error string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder.load()
        for batch in batches:
            none = pa.array([], pa.struct([("embedding", VECTOR), ("error", pa.string())]))
            yield pa.concat_arrays([none, *(part for ids in _chunks(batch, size) for part in _attempt(encoder, ids, pad_id, length))])

    return run.asNondeterministic()


def embedding(
    ids: Column, encoder: Encoder, pad_id: int, batch_size: int | None = None, length: int = MAX_LENGTH
) -> Column:
    """The unit vector of each id array: the model's state at the first position, normalised.

    Arrays beyond ``length`` are cut and keep their last id; a NULL array has no vector.
    """
    return _failing_udf(encoder, pad_id, batch_size or BATCH_SIZE, length)(ids)


def encode(
    texts: DataFrame,
    vocabulary: Vocabulary,
    lexicon: Lexicon | None = None,
    keys: Sequence[str] = KEYS,
    length: int = MAX_LENGTH,
    **options,
) -> DataFrame:
    """The model inputs as columns: ``input_ids``, ``token_type_ids``, ``attention_mask`` (int64)."""
    ids = encode_ids(texts, vocabulary, lexicon, keys, length, **options)
    return ids.select(
        *keys,
        widen(F.col("input_ids")).alias("input_ids"),
        widen(token_types(F.col("input_ids"))).alias("token_type_ids"),
        widen(attention_mask(F.col("input_ids"), vocabulary.special.pad)).alias("attention_mask"),
    )


def embed(
    texts: DataFrame,
    vocabulary: Vocabulary,
    encoder: Encoder,
    lexicon: Lexicon | None = None,
    keys: Sequence[str] = KEYS,
    batch_size: int | None = None,
    length: int = MAX_LENGTH,
    report_errors: bool = False,
    **options,
) -> DataFrame:
    """``(keys, embedding)``: one unit vector per text; no texts give no rows.

    An error of the model fails the job. With ``report_errors`` the texts it fails on get
    NULL vectors instead, and a column ``error`` says why; texts beside them in a chunk keep theirs.

    Only ids that are not padding travel to the Python workers; padding, mask and
    type ids are made there, next to the model.
    """
    ship(texts.sparkSession)
    ids = model_ids(texts, vocabulary, lexicon, keys, length, **options)
    pad_id = vocabulary.special.pad
    if report_errors:
        run = _reporting_udf(encoder, pad_id, batch_size or BATCH_SIZE, length)
        return ids.select(*keys, run("token_ids").alias("result")).select(*keys, "result.embedding", "result.error")
    return ids.select(*keys, embedding(F.col("token_ids"), encoder, pad_id, batch_size, length).alias("embedding"))


def register(
    spark: SparkSession,
    name: str,
    encoder: Encoder,
    pad_id: int,
    batch_size: int | None = None,
    length: int = MAX_LENGTH,
) -> None:
    """Make ``embedding`` callable from SQL, on a column of id arrays."""
    ship(spark)
    spark.udf.register(name, _failing_udf(encoder, pad_id, batch_size or BATCH_SIZE, length))
