"""The vocabulary: tokens and their ids, kept as two tables.

Looking up an id and looking up a token are different relations: if a token
occurs twice, the forward table has its last id and the reverse table has both.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import BROADCAST_BYTES, settle

# Special tokens and the ids they have unless the vocabulary names them.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
INNER = "##"  # the mark of a piece inside a word
DEFAULT_PAD, DEFAULT_UNK, DEFAULT_CLS, DEFAULT_SEP = 0, 100, 101, 102


def token_lines(content: Column) -> Column:
    """The tokens of a vocabulary file, in order; the index in the array is the id.

    Empty lines take no id. Text after the first tab is not part of the token.
    """
    lines = F.filter(F.split(content, "\n"), lambda line: line != "")
    return F.transform(lines, lambda line: F.substring_index(line, "\t", 1))


def forward(entries: DataFrame, *group: str) -> DataFrame:
    """One row per token with the last id it was given."""
    return entries.groupBy(*group, "token").agg(F.max("token_id").alias("token_id"))


@dataclass(frozen=True)
class SpecialTokens:
    pad: int = DEFAULT_PAD
    unk: int = DEFAULT_UNK
    cls: int = DEFAULT_CLS
    sep: int = DEFAULT_SEP


def _special_columns() -> list[Column]:
    def found(token: str, default: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("token") == token, F.col("token_id"))), F.lit(default))

    return [
        found(PAD, DEFAULT_PAD).alias("pad"),
        found(UNK, DEFAULT_UNK).alias("unk"),
        found(CLS, DEFAULT_CLS).alias("cls"),
        found(SEP, DEFAULT_SEP).alias("sep"),
    ]


def special_tokens(entries: DataFrame, *group: str) -> DataFrame:
    """The special ids of each vocabulary: found ones, else the defaults."""
    return entries.groupBy(*group).agg(*_special_columns())


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary table with its measured size and its special ids."""

    entries: DataFrame  # token_id, token: one row per id
    lookup: DataFrame  # token, token_id: one row per token, settled
    special: SpecialTokens
    unk_piece: int  # id of a produced [UNK] piece: the vocabulary's own if it has one
    tokens: int
    bytes: int
    inner_bytes: int  # of the tokens that are pieces inside a word
    longest: int  # characters of the longest token

    @classmethod
    def from_entries(cls, entries: DataFrame) -> Vocabulary:
        """From ``(token_id, token)`` rows. The lookup table is written and measured at once."""
        last, copies = F.max("token_id").alias("token_id"), F.count("*").alias("copies")
        tokens = settle(entries.groupBy("token").agg(last, copies), "tokens")
        size = F.col("copies") * (F.octet_length("token") + 48)
        facts = tokens.agg(
            *_special_columns(),
            F.count("*").alias("tokens"),
            F.sum(size).alias("bytes"),
            F.sum(F.when(F.col("token").startswith(INNER), size)).alias("inner_bytes"),
            F.max(F.char_length("token")).alias("longest"),
        ).head()
        special = SpecialTokens(facts.pad, facts.unk, facts.cls, facts.sep)
        lookup = tokens.select("token", "token_id")
        return cls(
            entries, lookup, special, facts.unk, facts.tokens, facts.bytes or 0, facts.inner_bytes or 0, facts.longest or 0
        )

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Vocabulary:
        """From a text file with a token per line."""
        content = spark.read.text(path, wholetext=True)
        lines = content.select(F.posexplode(token_lines(F.col("value"))).alias("token_id", "token"))
        return cls.from_entries(lines)

    def with_special(self, pad: int, unk: int, cls: int, sep: int) -> Vocabulary:
        """Override the special ids.

        A piece ``[UNK]`` is looked up like any other, so the new unk id counts
        for it only if the vocabulary has no such token.
        """
        has_unk = not self.lookup.filter(F.col("token") == UNK).isEmpty()
        unk_piece = self.unk_piece if has_unk else unk
        return replace(self, special=SpecialTokens(pad, unk, cls, sep), unk_piece=unk_piece)

    def by_token(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``(token, token_id)``, marked for broadcast while it is small enough."""
        return self._sized(self.lookup, self.bytes, limit)

    def inner_by_token(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``by_token`` for the pieces inside a word only."""
        return self._sized(self.lookup.filter(F.col("token").startswith(INNER)), self.inner_bytes, limit)

    def by_id(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``(token_id, token)``, marked for broadcast while it is small enough."""
        return self._sized(self.entries.select("token_id", "token"), self.bytes, limit)

    @staticmethod
    def _sized(table: DataFrame, size: int, limit: int) -> DataFrame:
        return F.broadcast(table) if size <= limit else table
