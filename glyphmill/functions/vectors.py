"""Functions over embedding vectors (arrays of float or double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(_doubles(left), _doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column) -> Column:
    """Divide by the norm. Zero vectors and vectors whose norm is NaN stay as they are."""
    length = norm(vector)
    # NaN sorts above every number in Spark, so "> 0" alone would let it through.
    usable = (length > 0) & ~F.isnan(length)
    return F.when(usable, F.transform(_doubles(vector), lambda x: x / length)).otherwise(_doubles(vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; NULL if either vector has no length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths)


def is_empty(vector: Column) -> Column:
    return F.coalesce(F.size(vector) <= 0, F.lit(True))


def is_not_finite(vector: Column) -> Column:
    return F.exists(_doubles(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def status(vector: Column) -> Column:
    """``empty``, ``not_finite`` or ``ok``."""
    return (
        F.when(is_empty(vector), "empty").when(is_not_finite(vector), "not_finite").otherwise("ok")
    )


def profile(vector: Column) -> list[Column]:
    """Dimension, range, mean and the first five values of a vector."""
    values = _doubles(vector)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return [
        F.size(values).cast("bigint").alias("dimension"),
        F.array_min(values).alias("lowest"),
        F.array_max(values).alias("highest"),
        F.when(F.size(values) > 0, total / F.size(values)).alias("mean"),
        F.slice(values, 1, 5).alias("head"),
    ]


def _above_tie(x: Column, seven: Column) -> Column:
    """Sign of ``x`` less the decimal number ``seven`` (seven digits), both positive.

    The product of ``x`` with a power of ten is split into its rounded value and the rounding
    error, so the comparison is exact for powers up to 22; beyond, the two count as equal.
    """
    exponent = F.element_at(F.split(seven, "e"), 2).cast("int")
    digits = F.regexp_replace(F.element_at(F.split(seven, "e"), 1), r"\.", "").cast("double")
    power = F.concat(F.lit("1e"), F.least(F.greatest(F.lit(6) - exponent, F.lit(0)), F.lit(22)).cast("string")).cast("double")

    def parts(value: Column) -> tuple[Column, Column]:
        upper = value * 134217729.0 - (value * 134217729.0 - value)
        return upper, value - upper

    (xh, xl), (ph, pl), product = parts(x), parts(power), x * power
    error = ((xh * ph - product) + xh * pl + xl * ph) + xl * pl
    return F.when(exponent.between(-16, 6), F.signum((product - digits) + error)).otherwise(0.0)


def _six_digits(x: Column) -> Column:
    """The C format ``%g`` of a double: six significant digits, no trailing zeros."""
    # The JVM rounds the shortest decimal of a double, ties away from zero; C rounds its exact
    # value, ties to even. They differ where seven digits ending in 5 give the double back:
    # there a nudge towards zero is due if the double is below the tie, or on it after an even digit.
    seven = F.format_string("%.6e", F.abs(x))
    near = seven.rlike("5e") & (seven.cast("double") == F.abs(x))
    side = _above_tie(F.abs(x), seven)
    tie = F.when(near, (side < 0) | ((side == 0) & seven.rlike(r"[02468]5e"))).otherwise(False)
    rounded = F.format_string("%.6g", F.when(tie, x * F.lit(1 - 1e-9)).otherwise(x))
    short = F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when(x == 0, F.when(x.cast("string").startswith("-"), "-0").otherwise("0"))
        .otherwise(short)
    )


def format_vector(vector: Column) -> Column:
    """A vector as one line: values in ``%g`` form, separated by one space."""
    return F.array_join(F.transform(_doubles(vector), _six_digits), " ")


def parse_vector(line: Column) -> Column:
    """The numbers of a line, ``NULL`` for each field that is not one."""
    # Java takes a trailing "d" or "f" as part of a number; the text format does not.
    number = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"
    fields = F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda x: x != "")
    return F.transform(fields, lambda x: F.when(x.rlike(number), x.try_cast("double")))
