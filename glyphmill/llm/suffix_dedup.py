"""Remove every byte that a repeated 200-byte string covers, by sorting suffixes.

Sorting all suffixes of a corpus would move each byte 200 times. Instead every
200-byte window is filed under its minimizer, the leftmost of its 40-byte strings
with the smallest hash: equal windows have it at the same place, and the windows
of a stretch that share one form a run of about 80. Runs are counted by
minimizer; those whose minimizer is unique are done (a bit table of fixed size carries
the others into the second pass, more bits only mean more work). Equal runs are
repeated as a whole. Where runs of one minimizer differ, their texts meet in one
task, and the suffixes from the minimizer on, and the reversed ones before it, are put in order by
deep-shallow sorting: multikey quicksort on words of 8 bytes to a shallow
depth, then a blind trie for each remaining group with a long common prefix. Two
windows at the same distance from the minimizer are equal when both orders keep them
together down to their ends.

A minimizer with more than ``CROWD`` different runs, more than are compared at a time, is
not gathered: its windows are counted one by one instead, by 128 bits of hash.

Defined cases: a null text has no bytes; texts under 200 bytes lose nothing;
repeated rows repeat each other's windows; rows with equal id and text get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.overlap_join import _mixed, _power_tables
from glyphmill.session import bounded, settle, settle_measured, ship

WINDOW = 200
SEED = 40
SPAN = WINDOW - SEED + 1  # Seeds in a window, and distances a window can have from its seed.
SHALLOW = 64
CHUNK = 1 << 19
WORDS = 1 << 19  # The bit tables have 64 times as many bits.
GATHERED = 20_000  # Runs compared at a time, some 6 MB of text.
CROWD = GATHERED
BROADCAST_BYTES = 16 * 1024 * 1024
_POSITION = np.uint64((1 << 20) - 1)


# --- windows and runs -------------------------------------------------------


def seed_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the 40 bytes from every position on."""
    value, size, factor = codes.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    parts = {1: value}
    while size < 32:
        value = value[: max(len(value) - size, 0)] * np.uint64(factor) + value[size:]
        size, factor = size * 2, factor * factor % (1 << 64)
        parts[size] = value
    count = max(len(codes) - SEED + 1, 0)
    power = np.uint64(pow(0x9E3779B97F4A7C15, 8, 1 << 64))
    return _mixed(parts[32][:count] * power + parts[8][32 : 32 + count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    count = len(values)
    filled = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:count] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: count - width + 1], ahead[width - 1 : count])


def _chunks(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Texts packed to at most about a megabyte: bytes, and pieces (text, offset in it, place, length)."""
    parts, pieces, size = [], [], 0
    for number, data in enumerate(texts):
        for offset in range(0, max(len(data) - WINDOW + 1, 0), CHUNK):
            part = data[offset : offset + CHUNK + WINDOW - 1]
            if size + len(part) >= 1 << 20:
                yield b"".join(parts), pieces
                parts, pieces, size = [], [], 0
            pieces.append((number, offset, size, len(part)))
            parts.append(part)
            size += len(part)
    if parts:
        yield b"".join(parts), pieces


RUN = ("text", "at", "windows", "ahead", "seed", "body_hash")


def runs(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, dict[str, np.ndarray]]]:
    """Per chunk: its bytes, the place of each run in them, and the runs.

    ``at`` is the first window's offset in its text, ``windows`` their number, ``ahead`` the seed's
    distance from the first window, ``seed`` and ``body_hash`` the hashes of seed and run.
    """
    for data, pieces in _chunks(texts):
        codes = np.frombuffer(data, np.uint8)
        hashes = seed_hashes(codes)
        packed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        least = (sliding_least(packed, SPAN) & _POSITION).astype(np.int64)
        valid = np.zeros(len(least) + 1, bool)
        number, offset, place, length = (np.array(x) for x in zip(*pieces, strict=True))
        owner = np.repeat(np.arange(len(pieces)), length)
        for start, size in zip(place, length, strict=True):
            valid[start : start + size - WINDOW + 1] = True
        valid = valid[:-1]
        change = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])])
        starts = np.flatnonzero(change)
        counts = np.diff(np.append(starts, len(least)))
        keep = valid[starts]
        starts, counts = starts[keep], counts[keep]
        powers, inverse = _power_tables(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64)])
        ends = starts + counts - 1 + WINDOW
        seeds = least[starts]
        body = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (seeds - starts).astype(np.uint64))
        own = owner[starts]
        yield data, starts, {
            "text": number[own], "at": offset[own] + starts - place[own], "windows": counts, "ahead": seeds - starts,
            "seed": hashes[seeds].view(np.int64), "body_hash": body.view(np.int64),
        }


def _bytes_of(texts: pd.Series) -> list[bytes]:
    return [(text or "").encode("utf-8", "replace") for text in texts]


# --- deep-shallow sorting ----------------------------------------------------


def common_length(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of strings by a trie that keeps branching places only.

    A new string walks down by the bytes at the branching places alone, is compared with
    the one leaf it comes to, and branches off where the two differ. Ends count as before any byte.
    """

    def byte(number: int, place: int) -> int:
        return strings[number][place] if place < len(strings[number]) else -1

    root: list | None = None  # A leaf is [None, numbers]; a branching [place, {byte: node}].
    for number, string in enumerate(strings):
        if root is None:
            root = [None, [number]]
            continue
        node = root
        while node[0] is not None:
            node = node[1].get(byte(number, node[0])) or next(iter(node[1].values()))
        shared = common_length(string, strings[node[1][0]])
        if shared == len(string) == len(strings[node[1][0]]):
            node[1].append(number)
            continue
        other = byte(node[1][0], shared)
        parent, key, node = None, None, root
        while node[0] is not None and node[0] < shared:
            parent, key, node = node, byte(number, node[0]), node[1][byte(number, node[0])]
        if node[0] == shared:
            node[1][byte(number, shared)] = [None, [number]]
            continue
        branch = [shared, {byte(number, shared): [None, [number]], other: node}]
        if parent is None:
            root = branch
        else:
            parent[1][key] = branch
    order, stack = [], [root] if root else []
    while stack:
        place, below = stack.pop()
        if place is None:
            order.extend(below)
        else:
            stack.extend(below[k] for k in sorted(below, reverse=True))
    return order


def _matrix(strings: list[bytes]) -> np.ndarray:
    """Strings as rows of words of 8 bytes (big-endian), filled up with zeros."""
    width = -(-max(map(len, strings), default=1) // 8) * 8 or 8
    joined = b"".join(string.ljust(width, b"\0") for string in strings)
    return np.frombuffer(joined, ">u8").reshape(len(strings), -1).astype(np.uint64)


def deep_shallow_order(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings within their groups, and what each shares with the one before it (-1: another group)."""
    words = _matrix(strings)
    lengths = np.array([len(string) for string in strings])
    order = np.argsort(groups, kind="stable")
    segment = np.concatenate([[0], np.cumsum(groups[order][1:] != groups[order][:-1])]) if len(order) else order
    for depth in range(min(SHALLOW // 8, words.shape[1])):
        # Quicksort of every open segment by its next word; ties stay open.
        open_ = np.bincount(segment)[segment] > 1
        if not open_.any():
            break
        column = words[order, depth]
        within = np.lexsort((np.where(open_, column, 0), segment))
        order, column, segment = order[within], column[within], segment[within]
        split = (segment[1:] != segment[:-1]) | (column[1:] != column[:-1])
        segment = np.concatenate([[0], np.cumsum(split)])
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(order) else order
    for start, end in zip(starts, np.append(starts[1:], len(order)), strict=True):
        if end - start > 1:
            part = order[start:end]
            order[start:end] = part[blind_trie_order([strings[i] for i in part])]
    shared = np.full(len(order), -1)
    if len(order) > 1:
        rows = words[order].astype(">u8").view(np.uint8)
        unlike = rows[1:] != rows[:-1]
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
        shared[1:] = np.minimum(first, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
        shared[1:][groups[order[1:]] != groups[order[:-1]]] = -1
    return order, shared


def repeated_windows(groups: np.ndarray, bodies: list[bytes], ahead: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For runs with a common seed (``groups``): which windows occur in another run, by distance from the seed."""
    count = len(bodies)
    right, right_shared = deep_shallow_order(groups, [b[a:] for b, a in zip(bodies, ahead, strict=True)])
    left, left_shared = deep_shallow_order(groups, [b[:a][::-1] for b, a in zip(bodies, ahead, strict=True)])
    found = np.zeros((count, SPAN), bool)
    right_class, left_class = np.empty(count, np.int64), np.empty(count, np.int64)
    for distance in range(SPAN):
        valid = np.flatnonzero((distance <= ahead) & (distance > ahead - windows))
        if len(valid) < 2:
            continue
        right_class[right] = np.cumsum(right_shared < WINDOW - distance)
        left_class[left] = np.cumsum(left_shared < distance)
        key = right_class[valid] * (count + 1) + left_class[valid]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(valid), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found[valid[twice], distance] = True
    return found


def _spans(found: np.ndarray, ahead: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per run the stretches of repeated windows, as first and last-but-one window numbers."""
    out = []
    for row, distance in zip(found, ahead, strict=True):
        numbers = np.sort(distance - np.flatnonzero(row))
        if not len(numbers):
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(numbers) > 1)
        out.append(list(zip(numbers[np.append(0, cut + 1)].tolist(), (numbers[np.append(cut, len(numbers) - 1)] + 1).tolist(), strict=True)))
    return out


# --- the corpus ---------------------------------------------------------------


def _seed_counts(texts: DataFrame) -> DataFrame:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, _, found in runs(_bytes_of(frame["text"])):
                yield pd.DataFrame({"seed": found["seed"], "body_hash": found["body_hash"]})

    found = texts.select("text").mapInPandas(count, "seed bigint, body_hash bigint")
    counted = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("body_hash").alias("low"), F.max("body_hash").alias("high"))
    return counted.filter("n > 1").select("seed", (F.col("low") != F.col("high")).alias("mixed"))


def _bit_tables(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of the repeated seeds and of those with different runs; ``WORDS`` rows at most."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("seed").bitwiseAND(63).cast("int"))
    word = F.pmod(F.shiftright("seed", 6), F.lit(WORDS))
    rows = seeds.groupBy(word.alias("word")).agg(
        F.bit_or(bit).alias("all"), F.bit_or(F.when(F.col("mixed"), bit).otherwise(F.lit(0).cast("bigint"))).alias("mixed")
    )
    frame = rows.toPandas()
    tables = np.zeros((2, WORDS), np.int64)
    tables[0, frame["word"].to_numpy(np.int64)] = frame["all"].to_numpy(np.int64)
    tables[1, frame["word"].to_numpy(np.int64)] = frame["mixed"].to_numpy(np.int64)
    return tables[0].view(np.uint64), tables[1].view(np.uint64)


def _in_table(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    words = table[(seeds >> 6) % WORDS]
    return (words >> (seeds & 63).astype(np.uint64)) & np.uint64(1) > 0


MEMBER = "key bigint, at bigint, windows bigint, ahead bigint, seed bigint, body_hash bigint, body binary"


def _members(texts: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The runs whose seed is repeated; with their bytes where runs of the seed differ."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repeated, mixed = shared.value
        for frame in frames:
            keys = frame["key"].to_numpy()
            for data, places, found in runs(_bytes_of(frame["text"])):
                keep = _in_table(repeated, found["seed"])
                if not keep.any():
                    continue
                rows = pd.DataFrame({name: found[name][keep] for name in RUN[1:]})
                rows.insert(0, "key", keys[found["text"][keep]])
                with_body = _in_table(mixed, found["seed"][keep])
                ends = places[keep] + found["windows"][keep] - 1 + WINDOW
                rows["body"] = [data[a:b] if need else None for a, b, need in zip(places[keep], ends, with_body, strict=True)]
                yield rows

    return texts.mapInPandas(pick, MEMBER)


SPANS = "seed bigint, body_hash bigint, spans array<struct<low:bigint,high:bigint>>"


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Different runs of each seed, all of a seed in a row, to their repeated windows."""
    kept: pd.DataFrame | None = None

    def finished(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        groups = np.concatenate([[0], np.cumsum(np.diff(rows["seed"].to_numpy()) != 0)])
        ahead, windows = rows["ahead"].to_numpy(), rows["windows"].to_numpy()
        found = repeated_windows(groups, [bytes(b) for b in rows["body"]], ahead, windows)
        out = rows[["seed", "body_hash"]].copy()
        out["spans"] = [[{"low": a, "high": b} for a, b in spans] for spans in _spans(found, ahead)]
        yield out[found.any(axis=1)]

    for frame in frames:
        rows = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        kept = rows
        while len(kept) > GATHERED:
            seeds = kept["seed"].to_numpy()
            cuts = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
            ready = cuts[cuts <= GATHERED]
            cut = int(ready[-1]) if len(ready) else int(cuts[0]) if len(cuts) else 0
            if not cut:
                break
            yield from finished(kept.iloc[:cut])
            kept = kept.iloc[cut:].reset_index(drop=True)
    if kept is not None and len(kept):
        yield from finished(kept)


def _window_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of the runs of crowded seeds by 128 bits of hash."""
    for frame in frames:
        for seed, body_hash, windows, body in zip(frame["seed"], frame["body_hash"], frame["windows"], frame["body"], strict=True):
            codes = np.frombuffer(body, np.uint8).astype(np.uint64)
            powers, inverse = _power_tables(len(codes) + 1)
            at = np.arange(windows)
            hashes = []
            for add in (1, 331):
                values = (codes + np.uint64(1)) * (codes + np.uint64(add))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[: len(codes)], dtype=np.uint64)])
                hashes.append(_mixed((sums[at + WINDOW] - sums[at]) * inverse[at]).view(np.int64))
            yield pd.DataFrame({"seed": seed, "body_hash": body_hash, "window": at, "h1": hashes[0], "h2": hashes[1]})


def _crowded_spans(crowded: DataFrame) -> DataFrame:
    rows = crowded.select("seed", "body_hash", "windows", "body").mapInPandas(
        _window_rows, "seed bigint, body_hash bigint, window bigint, h1 bigint, h2 bigint"
    )
    rows = settle(rows, "windows")
    twice = settle(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), "twice")
    found = rows.join(twice, ["h1", "h2"]).select("seed", "body_hash", "window")
    one = F.struct(F.col("window").alias("low"), (F.col("window") + 1).alias("high"))
    return found.groupBy("seed", "body_hash").agg(F.collect_list(one).alias("spans"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``key, spans``: the stretches of repeated windows of every text that has any."""
    members = settle(_members(texts, _bit_tables(_seed_counts(texts))), "members")
    counted = members.groupBy("seed", "body_hash").agg(F.count(F.lit(1)).alias("n"))
    whole = settle(counted.filter("n > 1").select("seed", "body_hash"), "whole")
    different = members.filter("body is not null").select("seed", "body_hash", "windows", "ahead", "body")
    different = settle(different.dropDuplicates(["seed", "body_hash"]), "different")
    crowd, measured = settle_measured(
        different.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("seed"), "crowd", n=F.count(F.lit(1))
    )
    calm = different
    if measured["n"]:
        crowd = bounded(crowd, "crowd", F.lit(8), BROADCAST_BYTES)
        calm = different.join(crowd, "seed", "left_anti")
    dealt = calm.repartition("seed").sortWithinPartitions("seed", "body_hash")
    spans = settle(dealt.mapInPandas(_compare, SPANS), "spans")
    if measured["n"]:
        spans = settle(spans.unionByName(_crowded_spans(different.join(crowd, "seed", "left_semi"))), "spans")
    places = members.select("key", "at", "windows", "seed", "body_hash")
    all_of = places.join(whole, ["seed", "body_hash"]).select("key", F.col("at").alias("low"), (F.col("at") + F.col("windows")).alias("high"))
    some_of = places.join(spans, ["seed", "body_hash"]).select("key", "at", F.explode("spans").alias("span"))
    some_of = some_of.select("key", (F.col("at") + F.col("span.low")).alias("low"), (F.col("at") + F.col("span.high")).alias("high"))
    found = all_of.union(some_of).distinct().groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return settle(found.withColumn("spans", F.expr(_JOINED)), "repeated")


# Stretches of windows that touch or overlap in bytes as one.
_JOINED = f"""
aggregate(
  array_sort(spans), cast(array() as array<struct<low:bigint,high:bigint>>),
  (done, s) -> if(size(done) > 0 and element_at(done, -1).high + {WINDOW - 1} >= s.low,
    concat(slice(done, 1, size(done) - 1),
      array(named_struct('low', element_at(done, -1).low, 'high', greatest(element_at(done, -1).high, s.high)))),
    concat(done, array(s))))
"""

CLEANED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def kept_bytes(data: bytes, spans) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs; ``spans`` are in order and apart."""
    parts, position = [], 0
    for low, high in spans:
        parts.append(data[position:low])
        position = high + WINDOW - 1
    parts.append(data[position:])
    return b"".join(parts), len(spans)


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document."""
    ship(documents.sparkSession)
    texts = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeated_spans(texts.select("key", "text"))
    found = bounded(found, "repeated", F.lit(32) + F.size("spans") * 24, BROADCAST_BYTES)
    joined = texts.join(found, "key", "left").select("doc_id", "text", "spans")

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, data, spans in zip(frame["doc_id"], _bytes_of(frame["text"]), frame["spans"], strict=True):
                spans = [(s["low"], s["high"]) for s in spans] if spans is not None else []
                kept, number = kept_bytes(data, spans)
                rows.append((None if pd.isna(doc) else int(doc), len(data), len(data) - len(kept), number, hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return joined.mapInPandas(clean, CLEANED)
