"""Checks of embedding tables: bad vectors, unreadable lines, texts without a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import vectors as V

# Fixed value: rows of texts and vectors whose keys a task counts in memory.
PAIRING_ROWS = 1 << 20


def with_status(table: DataFrame, column: str = "embedding") -> DataFrame:
    """Add ``status``: ``ok``, ``empty`` or ``not_finite``."""
    return table.withColumn("status", V.status(F.col(column)))


def quarantine(table: DataFrame, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad ones with their status."""
    checked = with_status(table, column)
    return checked.filter(F.col("status") == "ok").drop("status"), checked.filter(F.col("status") != "ok")


def require_good(table: DataFrame, key: str = "text_id", column: str = "embedding") -> DataFrame:
    """The same table; the job fails at the first bad vector and names its row."""
    state = V.status(F.col(column))
    complaint = F.concat(F.lit("vector of "), F.col(key).cast("string"), F.lit(" is "), state)
    return table.filter(F.when(state == "ok", True).otherwise(F.raise_error(complaint).cast("boolean")))


def read_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse lines of numbers, leaving out blank ones: adds ``embedding`` and ``status``.

    A line with a field that is no number is ``unreadable``; it keeps its raw text.
    """
    parsed = lines.filter(F.trim(F.regexp_replace(value, r"\s", " ")) != "").withColumn(
        "embedding", V.parse_vector(F.col(value))
    )
    unreadable = F.exists("embedding", lambda x: x.isNull())
    return parsed.withColumn("status", F.when(unreadable, "unreadable").otherwise(V.status(F.col("embedding"))))


def pairing(texts: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """Texts and vectors per key, in one shuffle: ``(keys, texts, vectors)``.

    Many rows are counted first: keys that hardly repeat fill the memory of a task that counts them, so tasks follow the rows.
    """
    marked = texts.select(*keys, F.lit(1).alias("texts"), F.lit(0).alias("vectors")).union(
        vectors.select(*keys, F.lit(0), F.lit(1))
    )
    tasks = -(-marked.count() // PAIRING_ROWS)
    if tasks > marked.sparkSession.sparkContext.defaultParallelism:
        marked = marked.repartition(tasks, *keys)
    return marked.groupBy(*keys).agg(F.sum("texts").alias("texts"), F.sum("vectors").alias("vectors"))


def unpaired(texts: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """The keys that do not have as many vectors as texts."""
    return pairing(texts, vectors, *keys).filter(F.col("texts") != F.col("vectors"))


def cardinality(texts: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """One row: how many texts and vectors there are, what is missing, and whether all fits."""

    def surplus(more: str, less: str) -> Column:
        return F.coalesce(F.sum(F.greatest(F.col(more) - F.col(less), F.lit(0))), F.lit(0))

    counts = pairing(texts, vectors, *keys).agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"),
        F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"),
        surplus("texts", "vectors").alias("missing"),
        surplus("vectors", "texts").alias("extra"),
    )
    return counts.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))
