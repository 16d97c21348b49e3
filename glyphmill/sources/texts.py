"""Text sources: delimited files and delimited columns.

A text carries its identity in a key column, since a DataFrame has no order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.session import bounded, settle

NUL = "\0"

# The only escapes a delimiter option understands.
ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\0": NUL}


def delimiter_of(option: str = "") -> str:
    """A delimiter option as its characters. Nothing given means the NUL character."""
    return ESCAPES.get(option, option) or NUL


def drop_final_newline(blob: Column) -> Column:
    """Remove exactly one newline from the very end."""
    return F.regexp_replace(blob, "\\n\\z", "")


def split_texts(blob: Column, delimiter: str = "", drop_empty: bool = True) -> Column:
    """The texts of a delimited value, in order, as an array."""
    quoted = re.escape(delimiter_of(delimiter))
    parts = F.split(drop_final_newline(blob), quoted)
    return F.filter(parts, lambda text: text != "") if drop_empty else parts


def split_blobs(blobs: DataFrame, key: str, blob: str, delimiter: str = "", drop_empty: bool = True) -> DataFrame:
    """One row per text of each blob: ``(key, position, text)``."""
    texts = split_texts(F.col(blob), delimiter, drop_empty)
    return blobs.select(key, F.posexplode(texts).alias("position", "text"))


def read_whole(spark: SparkSession, path: str, delimiter: str = "") -> DataFrame:
    """Delimited files, each read as one value: exact about the final newline.

    A file is one row here, so this is for files that fit a task. Use
    ``read_delimited`` for large ones.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("blob")
    )
    return split_blobs(files, "file", "blob", delimiter)


def _read(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(file, block, size, text)``: the pieces of files between separators."""
    return spark.read.text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("text"),
    )


def _numbered(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces settled with a ``row`` that counts on inside each block, and the blocks: ``file, block, first, rows``.

    A task reads a block from its start to its end, so the rows are in order as they come. Nothing is
    sorted: the place of a piece is the number of pieces in earlier blocks, one row each, and its place in its own.
    """
    settled = settle(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    blocks = settled.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    return settled, settle(blocks, "blocks")


def _earlier(*partition: str) -> Column:
    """The pieces in the blocks before a block."""
    window = Window.partitionBy(*partition).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("rows").over(window), F.lit(0))


def _placed(pieces: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """Pieces with their place; ``blocks`` has ``before``, what comes before a block."""
    near = bounded(blocks, "blocks", F.octet_length("file") + 64)
    return pieces.join(near, ["file", "block"]).withColumn(name, F.col("before") + F.col("row") - F.col("first"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)``: the lines of text files in order of files and lines, counted from 0."""
    pieces, blocks = _numbered(_read(spark, path, "\n").drop("size"))
    placed = _placed(pieces, blocks.withColumn("before", _earlier()), "line")
    return placed.select("line", F.col("text").alias("value"))


def _open_ends(spark: SparkSession, path: str, separator: str, ends: DataFrame) -> DataFrame:
    """The files among ``ends`` that do not close with a separator: their pieces and separators add up to more than their size."""
    width = len(separator.encode())
    sizes = _read(spark, path, separator).join(ends.select("file"), "file").groupBy("file").agg(
        F.sum(F.octet_length("text").cast("bigint") + width).alias("bytes"), F.max("size").alias("size")
    )
    return sizes.filter(F.col("bytes") > F.col("size")).select("file")


def read_delimited(spark: SparkSession, path: str, delimiter: str = "", parts: bool = False) -> DataFrame:
    """Delimited files of any size as ``(file, position, text)``, split between tasks at the delimiter.

    The texts are those of ``read_whole``: one newline at the very end of a file goes, empty
    texts are left out, and positions count the texts of each file from 0. Files are not compressed ones. Nothing
    is sorted or shuffled but a row per block.

    With ``parts`` a folder is a file: its files, in order of their names, are the parts of one, each of whole
    texts, and ``file`` names the folder.
    """
    separator, whole = delimiter_of(delimiter), "folder" if parts else "file"
    pieces, blocks = _numbered(_read(spark, path, separator).drop("size").filter(F.col("text") != ""))
    if parts:
        blocks = blocks.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    blocks = blocks.withColumn("before", _earlier(whole))
    # A newline that ends a file is part of its last piece, unless a separator follows.
    lasts = blocks.groupBy(whole).agg(F.max(F.struct("file", "block", (F.col("first") + F.col("rows") - 1).alias("row"))).alias("last"))
    lasts = bounded(lasts.select("last.file", "last.block", "last.row"), "lasts", F.octet_length("file") + 48)
    ends = pieces.join(lasts, ["file", "block", "row"]).filter(F.col("text").endswith("\n")).select("file", "block", "row")
    ends = bounded(ends, "ends", F.octet_length("file") + 48)
    closed = pieces.sparkSession.createDataFrame([], "file string") if ends.isEmpty() else _open_ends(spark, path, separator, ends)
    cut = ends.join(closed, "file").select("file", "block", F.col("row").alias("cut"))
    placed = _placed(pieces, blocks.join(cut, ["file", "block"], "left"), "position")
    text = F.when(F.col("row") == F.col("cut"), drop_final_newline(F.col("text"))).otherwise(F.col("text"))
    return placed.select(F.col(whole).alias("file"), "position", text.alias("text")).filter(F.col("text") != "")


def with_line(texts: DataFrame) -> DataFrame:
    """Add ``line``: the place of a ``(file, position)`` among all texts in order of files, as sinks write their vectors."""
    counts = texts.groupBy("file").agg((F.max("position") + 1).alias("rows"))
    window = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("file", F.coalesce(F.sum("rows").over(window), F.lit(0)).alias("before"))
    near = bounded(firsts, "firsts", F.octet_length("file") + 24)
    return texts.join(near, "file").withColumn("line", F.col("before") + F.col("position")).drop("before")


def from_strings(spark: SparkSession, texts: str | list[str]) -> DataFrame:
    """Texts in memory as ``(text_id, text)``; a bare string is a list of one.

    Empty texts are kept here: they are embedded like any other.
    """
    listed = [texts] if isinstance(texts, str) else list(texts)
    return spark.createDataFrame(list(enumerate(listed)), "text_id bigint, text string")
