"""Functions over arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the encoded length of the model inputs.
MAX_LENGTH = 512


def token_head(ids: Column, count: int = 10) -> Column:
    return F.slice(ids, 1, count)


def truncate(ids: Column, sep: int, length: int = MAX_LENGTH) -> Column:
    """Cut to ``length`` ids and close with ``sep``; arrays that fit are untouched."""
    closed = F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(sep)))
    return F.when(F.size(ids) > length, closed).otherwise(ids)


def pad(ids: Column, pad_id: int, length: int = MAX_LENGTH) -> Column:
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def attention_mask(ids: Column, pad_id: int) -> Column:
    """1 where the id differs from the pad id, whatever its position."""
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def token_types(ids: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(ids))


def widen(ids: Column) -> Column:
    return ids.cast("array<bigint>")
