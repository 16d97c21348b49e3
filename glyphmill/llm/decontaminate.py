"""Benchmark passages in documents: word n-grams as seeds, a bound, then Smith-Waterman alignment.

Words are runs of letters and digits of the lower-cased text. All n-grams of an
item are seeds, however often they occur: which of them a copy keeps depends on its
edits, so none can be left out for its frequency. One pass looks up the seeds in each whole
text; around their hits the item is aligned with the words of the text, unless the
words that it shares with the item are too few for ``threshold`` in any order (``most``,
never below the score). ``score`` is the best local alignment over that of an
untouched copy (match 2, mismatch and gap -1), so 1 is verbatim and edited copies
lose with every edit.

The corpus is never shuffled. The benchmark is sent to the tasks in blocks of a
bounded number of words; a larger one takes more passes.

Defined cases: a null text has no words; items that are null or have fewer than
``LEAST_WORDS`` words take no part; repeated items are found each; hits tie to
the leftmost alignment; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import settle_measured, ship

SEED_WORDS = 4
LEAST_WORDS = 5
THRESHOLD = 0.6
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1

_words = re.compile(r"[^\W_]+").findall
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20

LEAKS = "array<struct<item_id:bigint,score:double,first_word:bigint,last_word:bigint>>"


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def gram_keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key of the n-gram at every position; callers leave out those with unknown words."""
    count = len(ids) - SEED_WORDS + 1
    key = np.zeros(max(count, 0), np.uint64)
    wide = ids.astype(np.uint64)
    for k in range(SEED_WORDS):
        key = (key ^ wide[k : k + len(key)]) * _FACTOR
        key ^= key >> np.uint64(29)
    return key


def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the n-grams whose words are all in the benchmark."""
    if len(ids) < SEED_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = (ids >= 0).astype(np.int32)
    runs = np.concatenate([[0], np.cumsum(known)])
    at = np.flatnonzero(runs[SEED_WORDS:] - runs[:-SEED_WORDS] == SEED_WORDS)
    return at, gram_keys(ids)[at]


@dataclass
class Block:
    """A bounded part of the benchmark: items as word numbers, and seeds as (key, item, position), sorted by key."""

    item_ids: list[int]
    items: list[np.ndarray]
    numbers: dict[str, int]
    keys: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Block:
        numbers: dict[str, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            found = words(text)
            if item_id is not None and len(found) >= LEAST_WORDS:
                ids.append(item_id)
                items.append(np.array([numbers.setdefault(word, len(numbers)) for word in found], np.int32))
        keys, owners, offsets = [], [], []
        for owner, item in enumerate(items):
            at, key = grams(item)
            keys.append(key)
            offsets.append(at)
            owners.append(np.full(len(at), owner))
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, owners, offsets)]
        order = np.argsort(joined[0], kind="stable")
        return Block(ids, items, numbers, joined[0].astype(np.uint64)[order], joined[1][order], joined[2][order])

    @cached_property
    def table(self) -> np.ndarray:
        """One bit of truth per key prefix, to pass by most n-grams quickly."""
        present = np.zeros(1 << _TABLE_BITS, bool)
        present[self.keys >> np.uint64(64 - _TABLE_BITS)] = True
        return present

    @cached_property
    def marks(self) -> np.ndarray:
        """Scratch: a word number's place tells whether it is in the item at hand; -1 is never."""
        return np.zeros(len(self.numbers) + 1, bool)

    def ids(self, text: str | None) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(word, -1) for word in words(text)], np.int32)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of the text's n-grams that are in the block."""
        at, key = grams(ids)
        likely = self.table[key >> np.uint64(64 - _TABLE_BITS)]
        at, key = at[likely], key[likely]
        place = np.searchsorted(self.keys, key)
        found = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == key) if len(self.keys) else likely[:0]
        return at[found], key[found]


def local_scores(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the position after its end in ``text`` (the leftmost one)."""
    steps = -GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        aligned = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        row = np.concatenate([[0], np.maximum(np.maximum(aligned, row[1:] + GAP), 0)])
        # A gap along the text: the best earlier value less its distance.
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.argmax())
        if row[top] > best or (row[top] == best and top < end):
            best, end = int(row[top]), top
    return best, end


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Score from 0 to 1, first and last word of the aligned part."""
    best, end = local_scores(item, text)
    if not best:
        return 0.0, 0, 0
    _, back = local_scores(item[::-1], text[:end][::-1])
    return best / (MATCH * len(item)), end - back, end - 1


def most(shared: np.ndarray) -> int:
    """No alignment with a text scores more; ``shared`` marks the words of the text that are in the item.

    A word of the text matches at best, and costs as much as a gap if it is not in the item.
    """
    sums = np.cumsum(np.where(shared, MATCH, max(MISMATCH, GAP)))
    return int((sums - np.minimum(np.minimum.accumulate(np.append(0, sums[:-1])), 0)).max(initial=0))


def _windows(starts: np.ndarray, length: int, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of text around where the item would start, overlapping ones joined."""
    slack = length // 3 + SEED_WORDS
    low = high = None
    for start in np.unique(starts):
        a, b = max(0, int(start) - slack), min(limit, int(start) + length + slack)
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def leaks(text: str | None, block: Block, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
    """The items found in a text, each with its best score and place."""
    ids = block.ids(text)
    at, key = block.hits(ids)
    if not len(at):
        return []
    low, high = np.searchsorted(block.keys, key, "left"), np.searchsorted(block.keys, key, "right")
    seed = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
    owner, start = block.owners[seed], np.repeat(at, high - low) - block.offsets[seed]
    found = []
    for number in np.unique(owner):
        item = block.items[number]
        best = (0.0, 0, 0)
        block.marks[item] = True
        for a, b in _windows(start[owner == number], len(item), len(ids)):
            if most(block.marks[ids[a:b]]) / (MATCH * len(item)) < threshold:
                continue
            value, first, last = align(item, ids[a:b])
            if value > best[0]:
                best = (value, a + first, a + last)
        block.marks[item] = False
        if best[0] >= threshold:
            found.append((block.item_ids[number], *best))
    return sorted(found)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Block]:
    """The benchmark in parts of about ``BLOCK_WORDS`` words, brought to the driver one at a time."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text")).dropna()
    size = F.sum(F.regexp_count("text", F.lit(r"\s+")) + 1)
    table, measured = settle_measured(rows, "benchmark", words=size)
    count = -(-(measured["words"] or 0) // BLOCK_WORDS)
    for number in range(count):
        part = table.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        yield Block.of([(row.item, row.text) for row in part.orderBy("item", "text").collect()])


def with_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    name: str = "leaks",
) -> DataFrame:
    """``documents`` with the benchmark items found in each: ``item_id, score, first_word, last_word``."""
    spark = documents.sparkSession
    ship(spark)
    columns = []
    for block in _blocks(benchmark, item, item_text):
        columns.append(_finder(spark.sparkContext.broadcast(block), threshold)(F.col(text)))
    return documents.withColumn(name, F.concat(*columns) if columns else F.array().cast(LEAKS))


def _finder(shared: Broadcast, threshold: float):
    """A column function; not deterministic only so that Spark never runs it twice for a filter."""
    names = ("item_id", "score", "first_word", "last_word")

    @F.pandas_udf(LEAKS)
    def found(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([[dict(zip(names, leak, strict=True)) for leak in leaks(t, own, threshold)] for t in texts])

    return found.asNondeterministic()
