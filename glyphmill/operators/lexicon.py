"""Word pieces: the distinct words of a corpus, each segmented once.

A word that is in the vocabulary is its own only piece. Any other word is cut
from the left into the longest vocabulary entries of at most 20 bytes, entries
after the first being those that carry the ``##`` mark; where nothing fits, the
piece ``[UNK]`` ends the word and the pieces found before it stay.

A vocabulary of a usual size is held by the workers, and each distinct word is cut there, in Arrow batches. With
a larger one every substring that could be a piece becomes a row, one join finds those in the
vocabulary, and a fold over the matches of a word, sorted by start and longest first, keeps the ones that
continue each other. Either way the cost follows the number of distinct words, not the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.pieces import PIECE_BYTES, WORKER_BYTES, Segmenter, sent_ids
from glyphmill.operators.words import word_key, word_table
from glyphmill.session import BROADCAST_BYTES, settle_measured, ship
from glyphmill.sources.vocabulary import INNER, UNK, Vocabulary

# A long word is cut into blocks of starts, so that taking a substring never
# walks the whole word, and its matches are folded in runs, so that a step never
# copies all pieces found so far.
BLOCK = 256
RUN = 512


def _follow(matches: Column, value_type: str) -> Column:
    """Fold sorted matches ``(start, -length, value)`` into ``(next start, runs of values)``.

    A fold copies its state at every step. So the matches are folded in runs with
    a short state each, and the runs into the whole.
    """
    none = F.array().cast(f"array<{value_type}>")

    def state(following: Column, run: Column) -> Column:
        return F.struct(following.alias("next"), run.alias("values"))

    def step(acc: Column, match: Column) -> Column:
        taken = state(acc["next"] - match["shorter"], F.concat(acc["values"], F.array(match["value"])))
        return F.when(match["start"] == acc["next"], taken).otherwise(acc)

    def add_run(acc: Column, run: Column) -> Column:
        folded = F.aggregate(run, state(acc["next"], none), step)
        return F.transform(
            F.array(folded), lambda f: state(f["next"], F.concat(acc["values"], F.array(f["values"])))
        )[0]

    firsts = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(RUN))
    runs = F.transform(firsts, lambda first: F.slice(matches, first, F.lit(RUN)))
    return F.aggregate(runs, state(F.lit(1), F.array().cast(f"array<array<{value_type}>>")), add_run)


def _segment_in_workers(distinct: DataFrame, vocabulary: Vocabulary, value: str, named: bool) -> DataFrame:
    """``segment`` with the vocabulary in the workers."""
    ship(distinct.sparkSession)
    sent, unknown = sent_ids(vocabulary), vocabulary.unk_piece
    kind, of = {"token_id": (pa.int32(), Segmenter.ids), "token": (pa.string(), Segmenter.tokens)}[value]

    @F.arrow_udf(f"array<{'int' if value == 'token_id' else 'string'}>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segmenter = Segmenter(sent.value, unknown)
        for batch in batches:
            yield pa.array([of(segmenter, word) for word in batch.to_pylist()], pa.list_(kind))

    key = word_key(F.col("word")).alias("word_key")
    return distinct.select(key, *(["word"] if named else []), "n", pieces("word").alias("pieces"))


def segment(
    distinct: DataFrame,
    vocabulary: Vocabulary,
    value: str = "token_id",
    limit: int = BROADCAST_BYTES,
    named: bool = False,
) -> DataFrame:
    """Pieces of distinct words: ``(word, n)`` to ``(word_key, n, pieces)``.

    ``value`` picks what a piece is given as: its ``token_id`` or its ``token``. ``named``
    adds the word itself, which for long words is not its key. A vocabulary beyond ``limit``, or too large for
    every worker to hold, is joined.
    """
    if vocabulary.bytes <= min(limit, WORKER_BYTES):
        return _segment_in_workers(distinct, vocabulary, value, named)
    value_type, unknown = {
        "token_id": ("int", F.lit(vocabulary.unk_piece)),
        "token": ("string", F.lit(UNK)),
    }[value]

    def valued(table: DataFrame) -> DataFrame:
        return table.select("token", F.col(value).cast(value_type).alias("value"))

    entries = valued(vocabulary.by_token(limit))
    whole = (
        distinct.join(entries, distinct["word"] == entries["token"], "left_outer")
        .select("word", "n", F.col("value").alias("whole"), F.char_length("word").alias("length"))
        .withColumn("word_key", word_key(F.col("word")))
        .withColumn("ascii", F.octet_length("word") == F.col("length"))
    )
    # A whole-word hit needs no search: it passes as one row with one candidate.
    found = F.col("whole").isNotNull()
    first = (F.col("start") == 1) & (F.col("size") == 1)
    longest = min(PIECE_BYTES, max(vocabulary.longest, 1))
    last_block = F.when(found, 0).otherwise(F.floor((F.col("length") - 1) / BLOCK).cast("int"))
    starts = F.when(found, 1).otherwise(F.least(F.lit(BLOCK), F.col("length") - F.col("block") * BLOCK))
    lengths = F.when(found, 1).otherwise(F.least(F.lit(longest), F.col("length") - F.col("start") + 1))
    candidates = (
        whole.withColumn("block", F.explode(F.sequence(F.lit(0), last_block)))
        .withColumn("stretch", F.substring("word", F.col("block") * BLOCK + 1, F.lit(BLOCK + longest)))
        .withColumn("offset", F.explode(F.sequence(F.lit(1), starts)))
        .withColumn("start", F.col("block") * BLOCK + F.col("offset"))
        .withColumn("size", F.explode(F.sequence(F.lit(1), lengths)))
        .withColumn("text", F.substring("stretch", F.col("offset"), F.col("size")))
        .filter(F.col("ascii") | (F.octet_length("text") <= PIECE_BYTES) | first)
        .select(
            "word_key", "n", "length", "whole", "start", "size",
            F.when(F.col("start") == 1, F.col("text")).otherwise(F.concat(F.lit(INNER), F.col("text"))).alias("piece"),
            *([F.when(first, F.col("word")).alias("word")] if named else []),  # its first candidate always stays
        )
    )

    def matching(rows: DataFrame, table: DataFrame) -> DataFrame:
        # The first candidate stays without a match too, so that no word is lost.
        found_or_first = F.col("value").isNotNull() | first
        return rows.join(table, rows["piece"] == table["token"], "left_outer").filter(found_or_first)

    if vocabulary.bytes <= limit:
        matched = matching(candidates, entries)
    else:
        # Most candidates are inner ones, and the inner tokens are few even if the vocabulary is
        # too large to broadcast: then only the openings, 20 per word at most, are shuffled.
        opening = matching(candidates.filter(F.col("start") == 1), entries)
        inner = matching(candidates.filter(F.col("start") > 1), valued(vocabulary.inner_by_token(limit)))
        matched = opening.union(inner)
    match = F.struct("start", (-F.col("size")).alias("shorter"), "value")
    gathered = matched.groupBy("word_key", "n", "length", "whole").agg(
        F.collect_list(F.when(F.col("value").isNotNull(), match)).alias("matches"),
        *([F.max("word").alias("word")] if named else []),
    )
    ordered = gathered.withColumn("matches", F.sort_array("matches"))
    folded = ordered.withColumn("walk", _follow(F.col("matches"), value_type))
    pieces = F.flatten("walk.values")
    rest = F.when(F.col("walk.next") <= F.col("length"), F.array(unknown)).otherwise(F.array().cast(f"array<{value_type}>"))
    return folded.select(
        "word_key", *(["word"] if named else []), "n",
        F.when(found, F.array("whole")).otherwise(F.concat(pieces, rest)).alias("pieces"),
    )


@dataclass(frozen=True)
class Lexicon:
    """The distinct words of a corpus with the ids of their pieces, settled and measured."""

    entries: DataFrame  # word_key, n (occurrences), ids
    words: int
    bytes: int
    tokens: int  # pieces of all word occurrences

    def split(self, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame | None]:
        """The entries to broadcast, and the others (None if all fit into ``limit`` bytes).

        Beyond the limit the most frequent words are broadcast, so the words
        left for a shuffle are rare ones: no join key can be hot.
        """
        table = self.entries.select("word_key", "ids")
        if self.bytes <= limit:
            return table, None
        # One row per power of two of the occurrences: at most 64 rows reach the driver.
        sizes = (
            self.entries.groupBy(F.floor(F.log2("n")).cast("int").alias("magnitude"))
            .agg(F.sum(entry_bytes()).alias("bytes"))
            .orderBy(F.desc("magnitude"))
            .collect()
        )
        kept, threshold = 0, None
        for row in sizes:
            if kept + row.bytes > limit:
                break
            kept, threshold = kept + row.bytes, 1 << row.magnitude
        if threshold is None:
            return table.limit(0), table
        often = F.col("n") >= threshold
        return self.entries.filter(often).select("word_key", "ids"), self.entries.filter(~often).select("word_key", "ids")


def entry_bytes() -> Column:
    """Estimated size of an entry in a broadcast table."""
    return F.octet_length("word_key") + F.size("ids") * 4 + 80


def count_words(words: DataFrame) -> DataFrame:
    """Distinct words with their occurrences; counting is partly done before the shuffle."""
    return words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))


def build_lexicon(
    texts: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    max_words: int | None = None,
    limit: int = BROADCAST_BYTES,
    stored: bool = True,
) -> Lexicon:
    """Segment the distinct words of ``texts``. Runs one job and settles its result.

    ``stored=False`` is for a few texts in memory: nothing is written or counted, the
    words are segmented in the plan that uses them.
    """
    distinct = count_words(word_table(texts, (), text, max_words))
    entries = segment(distinct, vocabulary, limit=limit).withColumnRenamed("pieces", "ids")
    if not stored:
        return Lexicon(entries, 0, 0, 0)
    table, measured = settle_measured(
        entries,
        "lexicon",
        words=F.count("*"),
        bytes=F.sum(entry_bytes()),
        tokens=F.sum(F.col("n") * F.size("ids")),
    )
    return Lexicon(table, measured["words"], measured["bytes"] or 0, measured["tokens"] or 0)
