"""Conversations as a trie of their turns: one row per distinct prefix, from double-array tries.

Every conversation opens with the first turns of the first one of its hundred (``rebuilt``), so many share a
prefix. A turn is 20 bytes, a 128-bit digest of role and text and the text's length; a conversation is the
string of its turns. The strings are sorted and dealt by ranges, so a prefix that any share of
the conversations has spreads over many shards. A shard, at most ``SHARD`` turns of
conversations in a row, numbers its turns densely and packs their trie into a BASE and a CHECK
array: the child of state ``s`` by turn ``c`` is the cell ``BASE[s] + c`` whose ``CHECK`` names
``s``. Its conversations walk the arrays and leave counts in the cells; sums over subtrees follow the cells back
to the root.

Only nodes on the path of a shard's first or last conversation can be in other shards too. They leave the
shard as parts under the digest of their prefix and are merged over all shards: counts
add up, and the sums over the subtrees of nodes in several shards climb by doubling, in as many rounds as the logarithm
of their depth. All other nodes are final when they leave their shard. The ids of the conversations that end at
a node are in order within a shard and from shard to shard, so their digest is taken in passing; nothing is gathered.

Defined cases: a null role or text is an empty one; a null turn comes first, turns of one number go by their digest;
repeated rows are turns of their own; rows without a conversation id belong to none; texts of any length count
with all their code points; no rows give no nodes, not even a root. A conversation's turns are held
together, 20 bytes each, as a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.hot_keys import lookup
from glyphmill.session import settle, settle_measured, ship

SHARED_TURNS = 6
GROUP = 100
TURN = 20  # Bytes of a turn: digest and length.
SHARD = 1 << 17  # Turns of a trie.
PARTITION = 1 << 20  # Turns of a task.
TRIES = 256


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: every conversation with the turns it opens with, as a string of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.concat(digest, F.lpad(F.hex(F.char_length(text).cast("bigint")), 8, "0"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn.alias("of"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "of"))).alias("turns"))
    own = settle(own.select("conv_id", F.transform("turns", lambda t: t["of"]).alias("turns")), "conversations")
    heads = own.select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    named = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("shared", shared)
    joined = named.join(heads, "first", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("shared"))
    rest = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


# --- a double-array trie ---------------------------------------------------------


class DoubleArray:
    """The trie of sorted paths. ``base`` and ``check`` are its arrays; ``nodes`` lists the cells, parents first."""

    def __init__(self, paths: list[bytes]):
        self.ids: dict[bytes, int] = {}  # Turns numbered densely from 0, siblings in a row.
        self.base, self.check, self.depth, self.turn = [0], [-1], [0], [b""]
        self.nodes = [0]
        self._free = 1
        waiting = [(0, 0, len(paths))]
        for state, low, high in waiting:
            start = self.depth[state] * TURN
            groups: list[tuple[int, int, bytes]] = []
            while low < high and len(paths[low]) == start:
                low += 1  # Conversations that end here come first.
            while low < high:
                turn, first = paths[low][start : start + TURN], low
                while low < high and paths[low][start : start + TURN] == turn:
                    low += 1
                groups.append((first, low, turn))
            if groups:
                codes = [self.ids.setdefault(turn, len(self.ids)) for _, _, turn in groups]
                self.base[state] = base = self._fit(sorted(codes))
                for code, (first, end, turn) in zip(codes, groups, strict=True):
                    cell = base + code
                    self.check[cell], self.depth[cell], self.turn[cell] = state, self.depth[state] + 1, turn
                    self.nodes.append(cell)
                    waiting.append((cell, first, end))

    def _fit(self, codes: list[int]) -> int:
        """The base for which the cells of all codes are free, looked for from the front; else behind the end."""
        check, size, cell = self.check, len(self.check), self._free
        while cell < size and check[cell] != -1:
            cell += 1
        self._free = cell
        for _ in range(TRIES):
            while cell < size and check[cell] != -1:
                cell += 1
            if cell >= size:
                break
            base = cell - codes[0]
            if all(base + code >= size or check[base + code] == -1 for code in codes):
                break
            cell += 1
        else:
            cell = size
        base = cell - codes[0]
        more = base + codes[-1] + 1 - size
        if more > 0:
            check.extend([-1] * more)
            self.base.extend([0] * more)
            self.depth.extend([0] * more)
            self.turn.extend([b""] * more)
        return base

    def walk(self, path: bytes) -> Iterator[int]:
        """The cells of a path, the root first; KeyError where it leaves the trie."""
        state = 0
        yield state
        for start in range(0, len(path), TURN):
            cell = self.base[state] + self.ids[path[start : start + TURN]]
            if not 0 < cell < len(self.check) or self.check[cell] != state:
                raise KeyError(path)
            state = cell
            yield state


# --- a shard -----------------------------------------------------------------------

# Parts: what nodes of first and last paths leave; the others are final.
PART = pa.schema(
    [
        ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
        ("tokens", pa.int64()), ("in_children", pa.int64()), ("in_leaves", pa.int64()), ("in_saved", pa.int64()),
        ("ends_sha256", pa.string()), ("ends", pa.binary()), ("first_end", pa.int64()),
    ]
)
PART_DDL = (
    "node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, tokens bigint, in_children bigint, in_leaves bigint, in_saved bigint, ends_sha256 string, ends binary, first_end bigint"
)
NOTHING = hashlib.sha256(b"").hexdigest()


def decimal(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def shard_nodes(paths: list[bytes], convs: list[int]) -> pa.RecordBatch:
    """The nodes of a shard's conversations, which come sorted by path and id."""
    trie = DoubleArray(paths)
    size = len(trie.check)
    members, lowest, ends = [0] * size, [0] * size, {}
    for path, conv in zip(paths, convs, strict=True):
        cell = 0
        for cell in trie.walk(path):
            lowest[cell] = min(lowest[cell], conv) if members[cell] else conv
            members[cell] += 1
        ends.setdefault(cell, []).append(conv)
    edge: dict[int, bytes] = {}  # Nodes that other shards may have, with the digest of their prefix.
    for path in (paths[0], paths[-1]):
        running = hashlib.blake2b(digest_size=16)
        for cell in trie.walk(path):
            running.update(trie.turn[cell])
            edge[cell] = running.copy().digest()
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    inner = {cell: [0, 0, 0] for cell in edge}
    tokens = [int.from_bytes(turn[16:], "big") for turn in trie.turn]
    for cell in reversed(trie.nodes):
        leaves[cell] += children[cell] == 0
        saved[cell] += (members[cell] - 1) * tokens[cell]
        parent = trie.check[cell]
        if cell:
            children[parent] += 1
            leaves[parent] += leaves[cell]
            saved[parent] += saved[cell]
            if parent in inner and cell not in edge:
                part = inner[parent]
                part[0], part[1], part[2] = part[0] + 1, part[1] + leaves[cell], part[2] + saved[cell]
    columns: dict[str, list] = {name: [] for name in PART.names}
    for cell in trie.nodes:
        parent, own = trie.check[cell], ends.get(cell)
        known = edge.get(cell)
        parts = inner.get(cell, (None, None, None))
        packed = decimal(own) if own else b""
        row = (
            known, edge.get(parent), lowest[cell], trie.depth[cell], None if parent in edge or not cell else lowest[parent],
            members[cell], children[cell], leaves[cell], saved[cell], tokens[cell], *parts,
            None if known else hashlib.sha256(packed).hexdigest() if own else NOTHING,
            packed if known and own else None, own[0] if own else None,
        )
        for name, value in zip(PART.names, row, strict=True):
            columns[name].append(value)
    return pa.RecordBatch.from_pydict(columns, schema=PART)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations to nodes, a trie for every ``SHARD`` turns."""
    paths, convs, turns = [], [], 0
    for batch in batches:
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            paths.append(path)
            convs.append(conv)
            turns += len(path) // TURN + 1
            if turns >= SHARD:
                yield shard_nodes(paths, convs)
                paths, convs, turns = [], [], 0
    if paths:
        yield shard_nodes(paths, convs)


# --- nodes that several shards have --------------------------------------------------

_SUMS = ("n_convs", "in_children", "in_leaves", "in_saved")
MERGED_DDL = (
    "node binary, parent binary, conv_id bigint, depth bigint, n_convs bigint, in_children bigint, in_leaves bigint, in_saved bigint, "
    "tokens bigint, parts bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by node and first end to one row per node; the ends pass through a running digest."""
    current, digest, out = None, None, []

    def finished() -> None:
        out.append({**current, "ends_sha256": digest.hexdigest()})

    for batch in batches:
        for row in batch.to_pylist():
            ends = row.pop("ends")
            if current is None or row["node"] != current["node"]:
                if current is not None:
                    finished()
                current, digest, some = {**row, "parts": 1}, hashlib.sha256(), False
            else:
                current["conv_id"] = min(current["conv_id"], row["conv_id"])
                for name in _SUMS:
                    current[name] += row[name]
                current["parts"] += 1
            if ends:
                digest.update(b"," + ends if some else ends)
                some = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_MERGED)
            out = []
    if current is not None:
        finished()
        yield pa.RecordBatch.from_pylist(out, schema=_MERGED)


_MERGED = pa.schema([(f.split()[0], {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in MERGED_DDL.split(", ")])


def _climbed(shared: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens``: each node's ``leaves, saved`` and those of all nodes below it, by doubling."""
    state, measured = settle_measured(shared.select("node", F.col("parent").alias("up"), "leaves", "saved"), "climb", left=F.count("up"))
    while measured["left"]:
        given = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = state.join(given, "node", "left").join(above, "up", "left")
        moved = moved.select(
            "node", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("most", F.lit(0))).alias("saved"),
        )
        state, measured = settle_measured(moved, "climb", left=F.count("up"))
    return state.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _edges(parts: DataFrame) -> DataFrame:
    """The final rows of all nodes that left their shards as parts."""
    dealt = parts.repartition("node").sortWithinPartitions("node", "first_end")
    columns = ("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "tokens", "in_children", "in_leaves", "in_saved", "ends")
    merged = settle(dealt.select(*columns).mapInArrow(_merge, MERGED_DDL), "merged")
    alone = F.col("parts") == 1
    below = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum(F.when(alone, F.col("n_leaves")).otherwise(0)).alias("leaves"),
        F.sum(F.when(alone, F.col("saved_tokens")).otherwise(0)).alias("saved"),
    )
    shared = merged.filter(~alone).drop("n_children", "n_leaves", "saved_tokens").join(below, "node", "left").na.fill(0, ["edges", "leaves", "saved"])
    shared = shared.withColumn("n_children", F.col("in_children") + F.col("edges"))
    shared = shared.withColumn("leaves", F.col("in_leaves") + F.col("leaves") + (F.col("n_children") == 0).cast("bigint"))
    shared = shared.withColumn("saved", F.col("in_saved") + F.col("saved") + (F.col("n_convs") - 1) * F.col("tokens"))
    shared = settle(shared, "shared")
    kept = ("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    summed = shared.drop("leaves", "saved").join(_climbed(shared), "node")
    return settle(merged.filter(alone).select(*kept).unionByName(summed.select(*kept)), "edges")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node."""
    ship(conversations.sparkSession)
    turns = F.octet_length("path") / TURN + 1
    paths, measured = settle_measured(rebuilt(conversations), "paths", turns=F.sum(turns.cast("bigint")))
    tasks = max(paths.sparkSession.sparkContext.defaultParallelism, -(-(measured["turns"] or 0) // PARTITION))
    dealt = paths.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found, counted = settle_measured(
        dealt.mapInArrow(_shards, PART_DDL), "nodes", below=F.count(F.when(F.col("node").isNull() & F.col("parent").isNotNull(), 1))
    )
    edges = _edges(found.filter("node is not null"))
    done = found.filter("node is null and parent is null").select(*RESULT)
    names = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("uses"))
    columns = [c for c in RESULT if c != "parent_conv_id"]
    below = found.filter("node is null and parent is not null").select("parent", *columns)
    below = below.unionByName(edges.filter("parent is not null").select("parent", *columns))
    named = lookup(below, names, ["parent"], F.col("uses"), counted["below"] or 0)
    top = edges.filter("parent is null").select("*", F.lit(None).cast("bigint").alias("parent_conv_id"))
    return done.unionByName(named.select(*RESULT)).unionByName(top.select(*RESULT))
