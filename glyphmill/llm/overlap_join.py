"""Similarity join on word 5-grams: T-occurrence search over inverted lists, long ones probed.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two sets
of sizes m and n with a Jaccard similarity of 0.8 or more share at least
``T = 0.8 / 1.8 * (m + n)`` shingles. All shingles are ordered, frequent ones
last. As in DivideSkip, the rarest shingles of a set have short inverted lists,
which are merged (one shuffle brings each list together, sorted); the others
have long lists, which are never read: for each candidate of the merge the
remaining shingles are probed in its sorted set by binary search, until T is
reached or out of reach. Every linked pair shares one of the ``m - 0.8 m + 1``
rarest shingles, so nothing is lost.

Between merge and probe, an upper bound drops candidates: from the places of a
common shingle in both sets, and from bit patterns of the sets.

Copies are one node from the start. A list with more than ``SHORT`` nodes gives
no pairs among themselves: all are compared with its most central node; only while a
list still spans several components are they compared with more of its
nodes, up to all of them. So components are exact, and a
large group of near copies costs a few comparisons per member.

Defined cases: a null or blank text has an empty set, links with nothing and is
its own component; repeated rows are copies; rows without an id get the
component of their copies; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from glyphmill.llm.components import components
from glyphmill.session import bounded, settle, settle_measured, ship

WORDS = 5
SHARED, OF_UNION = 80, 100  # A link: 100 * intersection >= 80 * union.
SHORT = 32
BITS = 2048
LEAST_LOCAL = 3
MOST_RANKED = 1 << 20  # Shingles ranked by frequency; more would only change the order.
HOT = 256
BROADCAST_BYTES = 16 * 1024 * 1024

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < size:
        count = 1 << max(14, (size - 1).bit_length())
        for number, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(count, factor, np.uint64)
            table[0] = 1
            _powers[number] = np.multiply.accumulate(table)
    return _powers[0][:size], _powers[1][:size]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word of the lower-cased (A-Z) text; words end at ASCII white space."""
    codes = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    solid = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _power_tables(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes."""
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.int64)
    size = min(WORDS, len(words))
    value = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        value = value * np.uint64(_BASE) + words[k : k + len(value)]
    return np.unique(_mixed(value).view(np.int64))


def needed(m, n):
    """The shingles that sets of these sizes must share."""
    return -(-SHARED * (m + n) // (OF_UNION + SHARED))


@dataclass
class Ranks:
    """Frequent shingles and about how many documents have them; all others count as rare."""

    keys: np.ndarray
    counts: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray) -> Ranks:
        order = np.argsort(keys)
        table = np.zeros(1 << 22, bool)
        table[keys & 0x3FFFFF] = True
        return Ranks(keys[order], counts[order], table)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        ranks = np.zeros(len(found), np.int64)
        at = np.flatnonzero(self.table[found & 0x3FFFFF])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
            ranks[at] = np.where(self.keys[place] == found[at], self.counts[place], 0)
        return ranks


def frequent(documents: DataFrame, text: str) -> Ranks:
    """The ``MOST_RANKED`` most frequent shingles, counted before the shuffle; bounded in size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(value) for value in frame["text"]]
            keys, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0), np.empty(0))
            often = counts >= LEAST_LOCAL
            yield pd.DataFrame({"shingle": keys[often], "n": counts[often]}, dtype="int64")

    found = documents.select(F.col(text).alias("text")).mapInPandas(count, "shingle bigint, n bigint")
    found = found.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(MOST_RANKED).toPandas()
    return Ranks.of(found["shingle"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def bit_pattern(found: np.ndarray) -> np.ndarray:
    """Parity of the set's shingles in each of ``BITS`` cells, as bytes."""
    cells = np.bincount(found.view(np.uint64) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(cells.astype(np.uint8))


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


SETS = "doc bigint, node bigint, n bigint, central double, bits binary, prefix array<bigint>, ranks array<bigint>"


def described(documents: DataFrame, ranks: Ranks, key: str, text: str) -> DataFrame:
    """Per document: node (equal sets are one), size, bit pattern and its rarest shingles in order."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        for frame in frames:
            rows = []
            for value in frame["text"]:
                found = shingles(value)
                often = rank(found)
                size = len(found)
                keep = np.lexsort((found, often))[: size - (-(-SHARED * size // OF_UNION)) + 1 if size else 0]
                central = float((often > 0).sum() / size) if size else 0.0
                rows.append((node_of(found) if size else 0, size, central, bit_pattern(found).tobytes(), found[keep], often[keep]))
            out = pd.DataFrame(rows, columns=["node", "n", "central", "bits", "prefix", "ranks"])
            out.insert(0, "doc", frame["doc"].astype("Int64").to_numpy())
            yield out

    return documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInPandas(describe, SETS)


def _pairs_of_runs(rows: dict[str, np.ndarray], lengths: np.ndarray) -> pd.DataFrame:
    """The pairs within short runs that a common shingle at these places leaves possible."""
    found = []
    shingle, node, size, place = (rows[c] for c in ("shingle", "node", "n", "place"))
    for step in range(1, int(lengths.max(initial=1))):
        left = np.flatnonzero(shingle[:-step] == shingle[step:])
        right = left + step
        possible = 1 + np.minimum(size[left] - place[left], size[right] - place[right]) - 1
        keep = (possible >= needed(size[left], size[right])) & (node[left] != node[right])
        keep &= SHARED * np.maximum(size[left], size[right]) <= OF_UNION * np.minimum(size[left], size[right])
        found.append((left[keep], right[keep]))
    left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return pd.DataFrame({"shingle": np.nan, "a": np.minimum(node[left], node[right]), "b": np.maximum(node[left], node[right])})


MERGED = "shingle bigint, a bigint, b bigint, n bigint, place bigint, central double"
_COLUMNS = ["shingle", "a", "b", "n", "place", "central"]


def _merge_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted postings to pairs (``a, b``) from short lists and postings (``shingle, a``) of long ones."""
    kept, long_one = None, None

    def finished(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal long_one
        shingle = rows["shingle"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        lengths = np.diff(np.append(starts, len(shingle)))
        long_list = np.repeat((lengths > SHORT) | (shingle[starts] == (long_one if long_one is not None else 0)) & (long_one is not None), lengths)
        long_list |= rows["hot"].to_numpy(bool)
        short = rows[~long_list & np.repeat(lengths > 1, lengths)]
        if len(short):
            columns = {c: short[c].to_numpy() for c in ("shingle", "node", "n", "place")}
            pairs = _pairs_of_runs(columns, lengths[lengths <= SHORT])
            if len(pairs):
                yield _typed(pairs)
        rest = rows[long_list]
        if len(rest):
            yield _typed(rest.rename(columns={"node": "a"}))
            if long_list[-1]:
                long_one = int(shingle[-1])

    for frame in frames:
        rows = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        if not len(rows):
            continue
        shingle, node = rows["shingle"].to_numpy(), rows["node"].to_numpy()
        rows = rows[np.append(True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]))]
        last = rows["shingle"].iloc[-1]
        done = rows[rows["shingle"] != last]
        kept = rows[rows["shingle"] == last]
        if len(kept) > 4 * SHORT:
            done, kept = rows, rows.iloc[:0]
        if len(done):
            yield from finished(done)
    if kept is not None and len(kept):
        yield from finished(kept)


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: rows[c] if c in rows else np.nan for c in _COLUMNS})
    for c in _COLUMNS[:-1]:
        out[c] = out[c].astype("Int64")
    return out


def merged_lists(sets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Candidate pairs ``a, b`` of short lists; postings of long lists and their number."""
    postings = sets.filter("n > 0").select(
        "doc", "node", "n", "central", F.posexplode(F.arrays_zip("prefix", "ranks")).alias("place", "entry")
    )
    hot = F.col("entry.ranks") >= HOT
    salt = F.when(hot, F.pmod(F.xxhash64("doc"), F.ceil(F.col("entry.ranks") / HOT))).otherwise(0)
    postings = postings.select(
        F.col("entry.prefix").alias("shingle"), "node", "n", F.col("place").cast("bigint").alias("place"), "central",
        hot.alias("hot"), salt.alias("salt"),
    )
    dealt = postings.repartition("shingle", "salt").sortWithinPartitions("shingle", "node").drop("salt")
    merged, measured = settle_measured(
        dealt.mapInPandas(_merge_lists, MERGED), "merged", long=F.sum(F.col("shingle").isNotNull().cast("bigint"))
    )
    pairs = merged.filter("shingle is null").select("a", "b")
    long_lists = merged.filter("shingle is not null").select("shingle", F.col("a").alias("node"), "n", "place", "central")
    return pairs, long_lists, measured["long"] or 0


def _bounded_by_bits(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """Pairs whose bit patterns leave enough common shingles possible."""

    def of(side: str) -> DataFrame:
        return traits.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))

    joined = pairs.join(of("a"), "a").join(of("b"), "b")

    def differing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            a, b = (np.frombuffer(b"".join(frame[c]), np.uint64).reshape(len(frame), -1) for c in ("bits_a", "bits_b"))
            unlike = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
            m, n = frame["n_a"].to_numpy(), frame["n_b"].to_numpy()
            yield frame[["a", "b", "n_a", "n_b"]][(m + n - unlike) // 2 >= needed(m, n)]

    return joined.mapInPandas(differing, "a bigint, b bigint, n_a bigint, n_b bigint")


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """Probe the smaller set in the larger one, in blocks, until the answer is known."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    wanted, have = needed(len(small), len(large)), 0
    for start in range(0, len(small), 256):
        part = small[start : start + 256]
        place = np.minimum(np.searchsorted(large, part), len(large) - 1)
        have += int((large[place] == part).sum())
        if have >= wanted:
            return True
        if have + len(small) - start - len(part) < wanted:
            return False
    return False


class Join:
    """The steps over one table of documents, and what they share."""

    def __init__(self, documents: DataFrame, key: str, text: str):
        ship(documents.sparkSession)
        self.documents, self.key, self.text = documents, key, text
        self.sets = settle(described(documents, frequent(documents, text), key, text), "sets")
        nodes = self.sets.filter("n > 0").groupBy("node").agg(F.min("doc").alias("doc"))
        self.nodes = settle(nodes, "nodes")
        self.traits = self.sets.filter("n > 0").select("node", "n", "bits")
        self.traits = settle(self.traits.dropDuplicates(["node"]), "traits")

    def edges(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Those of the candidate pairs that are links, settled, and their number."""
        likely, measured = settle_measured(_bounded_by_bits(pairs.distinct(), self.traits), "likely", n=F.count(F.lit(1)))
        if not measured["n"]:
            return likely.select("a", "b"), 0
        wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        owners = wanted.join(self.nodes, "node").select(F.col("doc").alias("_doc"))
        owners = bounded(owners, "owners", F.lit(8), BROADCAST_BYTES)
        key = F.col(self.key).cast("bigint")
        texts = self.documents.select(key.alias("doc"), F.col(self.text).alias("text"))
        texts = texts.join(owners, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi").select("text")

        def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [shingles(value) for value in frame["text"]]
                yield pd.DataFrame({"node": [node_of(x) if len(x) else 0 for x in found], "found": found})

        sets = texts.mapInPandas(sets_of, "node bigint, found array<bigint>")

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    keep = [linked(x, y) for x, y in zip(frame["found_a"], frame["found_b"], strict=True)]
                    yield frame[["a", "b"]][keep]

        left = sets.select(F.col("node").alias("a"), F.col("found").alias("found_a"))
        right = sets.select(F.col("node").alias("b"), F.col("found").alias("found_b"))
        joined = likely.select("a", "b").join(left, "a").join(right, "b")
        edges, measured = settle_measured(joined.mapInPandas(probe, "a bigint, b bigint"), "links", n=F.count(F.lit(1)))
        return edges, measured["n"]

    def labels(self) -> DataFrame:
        """``node, label`` of all nodes with a link."""
        pairs, long_lists, count = merged_lists(self.sets)
        found, _ = self.edges(pairs)
        labels = components(found)
        if not count:
            return labels
        long_lists, measured = settle_measured(long_lists.dropDuplicates(["shingle", "node"]), "long", n=F.count(F.lit(1)))
        compared, size = 1, measured["n"]
        while True:
            current = long_lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            spans = current.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
            open_lists = spans.filter("low < high and members > 1").select("shingle", "members")
            current, state = settle_measured(current.join(open_lists, "shingle"), "open", most=F.max("members"))
            if not state["most"]:
                return labels
            order = Window.partitionBy("shingle").orderBy(F.desc("central"), "node")
            pivots = current.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= compared)
            pivots = settle(pivots.select("shingle", *[F.col(c).alias(f"{c}_p") for c in ("node", "n", "place", "label")]), "pivots")
            left = F.least(F.col("n") - F.col("place"), F.col("n_p") - F.col("place_p"))
            fits = (
                (F.col("label") != F.col("label_p"))
                & (F.lit(SHARED) * F.greatest("n", "n_p") <= F.lit(OF_UNION) * F.least("n", "n_p"))
                & (left * (OF_UNION + SHARED) >= F.lit(SHARED) * (F.col("n") + F.col("n_p")))
            )
            more = current.join(pivots, "shingle").filter(fits)
            more = more.select(F.least("node", "node_p").alias("a"), F.greatest("node", "node_p").alias("b"))
            fresh, number = self.edges(more)
            if number:
                found = settle(found.unionByName(fresh), "links")
                labels = components(found)
            if compared >= min(state["most"], size):
                return labels
            compared *= 8

    def classes(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` per row of the documents."""
        labels = self.labels()
        groups = self.nodes.join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
        groups = settle(groups, "groups")
        smallest = settle(groups.groupBy("label").agg(F.min("doc").alias("component")), "smallest")
        named = settle(groups.join(smallest, "label").select("node", "component"), "named")
        rows = self.sets.select("doc", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
        joined = rows.join(named, "node", "left")
        return joined.select(
            F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
        )


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return Join(documents, key, text).classes()
