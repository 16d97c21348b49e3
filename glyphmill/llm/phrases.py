"""Remove every word that a repeated window of ``WINDOW`` words covers, by automata of recurring passages.

Confirming passages. A window is filed under its anchor, the leftmost of its ``ANCHOR``-word strings with
the smallest hash: equal windows have equal anchors at equal places. The windows of a stretch
that share one form a run, one for about every twelve words. An anchor met once ends there: a first pass counts
anchors, a bit table of those met twice, ``MOST_BITS`` at most, thins the runs of the second (a full table lets more
runs through, which costs a shuffle of some 40 bytes a run and no result). Runs with the same words are
one body. A body met twice recurs as a whole, and bodies that follow each other wherever they are met
form one passage. Of a body met once, under an anchor with other bodies, the windows are compared with those of
the others by 128-bit digests, and each stretch of windows met elsewhere is a passage. A passage is read from one
place only.

Locating them. Texts are dealt in blocks of about ``BLOCK_BYTES``. A block is sent each passage that one of its
bodies opens, once however many of its texts have it, so no passage is hot. The texts of the block are read into memory,
then the passages stream by: every ``SHARD`` words of them are compiled into an Aho-Corasick automaton over
numbered words, all texts of the block run through it, the words it finds are marked, and the automaton is dropped. A worker
holds one block, or one longer text, and one automaton, however many passages recur.

Defined cases: a null text has no words; texts under ``WINDOW`` words lose nothing; texts are used whole, longer ones in
overlapping pieces that give the same windows; a window that starts twice in one text recurs as well; repeated rows are
places of their own, with equal results; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.hot_keys import HOT, lookup
from glyphmill.llm.overlap_join import _mixed, _power_tables
from glyphmill.session import settle, settle_measured, ship

WINDOW = 35
ANCHOR = 12
PLACES = WINDOW - ANCHOR + 1  # Anchors in a window.
PACK = 1 << 16  # Words looked at together; a longer text comes in pieces of this size.
BLOCK_BYTES = 1 << 20
SHARD = 1 << 19  # Words of the passages in an automaton.
PASSAGE = 1 << 14  # Windows of a passage; a longer one is sent in overlapping parts.
MOST_BITS = 1 << 27
BROADCAST_BYTES = 16 * 1024 * 1024
_POSITION = np.uint64((1 << 20) - 1)
_FACTOR = 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: what ASCII white space parts."""
    return (text or "").encode("utf-8", "replace").split()


# --- runs ---------------------------------------------------------------------------


def _packs(texts: Iterable[list[bytes]]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Texts, read one by one, as pieces (text, first word, words), overlapping by a window less one, packed to ``PACK`` words."""
    pieces, size = [], 0
    for number, words in enumerate(texts):
        for start in range(0, max(len(words) - WINDOW + 1, 0), PACK):
            piece = words[start : start + PACK + WINDOW - 1]
            if pieces and size + len(piece) > 2 * PACK:
                yield pieces
                pieces, size = [], 0
            pieces.append((number, start, piece))
            size += len(piece)
    if pieces:
        yield pieces


def _word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    powers, inverse = _power_tables(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def _strings(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` words in a row from every word on."""
    value = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        value = value * np.uint64(_FACTOR) + hashes[k : k + len(value)]
    return _mixed(value)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    count = len(values)
    filled = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:count] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: count - width + 1], ahead[width - 1 : count])


def runs(texts: Iterable[list[bytes]]) -> Iterator[dict[str, list]]:
    """Per pack the runs of windows with one anchor: ``text, at`` (first word), ``windows, anchor, body``."""
    for pieces in _packs(texts):
        data = b" ".join(word for _, _, words in pieces for word in words)
        ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
        starts = np.append(0, ends[:-1] + 1)
        anchors = _strings(_word_hashes(data, starts, ends), ANCHOR)
        packed = (anchors & ~_POSITION) | np.arange(len(anchors), dtype=np.uint64)
        least = (_least(packed, PLACES) & _POSITION).astype(np.int64)
        sizes = np.array([len(words) for _, _, words in pieces])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        whole = owner[: len(least)] == owner[WINDOW - 1 : WINDOW - 1 + len(least)]
        change = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])
        first = np.flatnonzero(np.concatenate([[True], change]))
        windows = np.diff(np.append(first, len(least)))
        first, windows = first[whole[first]], windows[whole[first]]
        low, high = starts[first], ends[first + windows + WINDOW - 2]
        bodies = [hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        body = np.frombuffer(b"".join(bodies), np.int64)
        piece = owner[first]
        number, offset = (np.array([p[k] for p in pieces]) for k in (0, 1))
        place = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        follows = (piece[1:] == piece[:-1]) & (first[1:] == first[:-1] + windows[:-1])
        yield {
            "text": number[piece], "at": offset[piece] + first - place[piece], "windows": windows, "anchor": anchors[least[first]].view(np.int64),
            "body": body, "next": np.append(np.where(follows, body[1:], LAST), LAST),
        }


LAST = -1  # Stands for no following run.


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in runs(map(words_of, batch.column("text").to_pylist())):
            yield pa.RecordBatch.from_arrays([pa.array(found["anchor"])], names=["anchor"])


def _bit_table(anchors: DataFrame, count: int) -> np.ndarray:
    """Bits of the anchors, 16 for each, ``MOST_BITS`` at most."""
    bits = min(max(1 << (16 * count).bit_length(), 1 << 16), MOST_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("anchor").bitwiseAND(63).cast("int"))
    word = F.pmod(F.shiftright("anchor", 6), F.lit(bits // 64))
    frame = anchors.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[frame["word"].to_numpy(np.int64)] = frame["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


RUN_DDL = "anchor bigint, body bigint, next bigint, key bigint"
RUN = ("anchor", "body", "next")


def _hits(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """The runs whose anchor is in the table, with the key of their text."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for found in runs(map(words_of, batch.column("text").to_pylist())):
                anchor = found["anchor"]
                inside = (words[(anchor >> 6) % len(words)] >> (anchor & 63).astype(np.uint64)) & np.uint64(1) > 0
                columns = [found[name][inside] for name in RUN] + [keys[found["text"][inside]]]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=[*RUN, "key"])

    return texts.select("key", "text").mapInArrow(pick, RUN_DDL)


# --- passages that recur ---------------------------------------------------------------

WANTED_DDL = "anchor bigint, body bigint, n bigint, part int, words binary"
_WANTED = pa.schema([("anchor", pa.int64()), ("body", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("words", pa.binary())])
COMPARED = -1  # The part of a body whose windows are compared.


class _Reader:
    """The passages of a text that its wanted bodies make up: bodies that go on into each other are one."""

    def __init__(self, words: list[bytes], wanted: list[dict], out: list[dict]):
        self.words, self.left, self.out = words, {(w["anchor"], w["body"]): w for w in wanted}, out
        self.chain: dict | None = None

    def add(self, w: dict, part: int, low: int, windows: int) -> None:
        joined = b" ".join(self.words[low : low + windows + WINDOW - 1])
        self.out.append({"anchor": w["anchor"], "body": w["body"], "n": w["n"], "part": part, "words": joined})

    def run(self, anchor: int, body: int, at: int, windows: int) -> None:
        w, chain = self.left.pop((anchor, body), None), self.chain
        if w is not None and w["mixed"]:
            self.add(w, COMPARED, at, windows)
        if w is None or w["n"] < 2:
            self.close()
        elif chain is not None and chain["end"] == at and chain["next"] == body and chain["first"]["n"] == w["n"]:
            chain |= {"end": at + windows, "next": w["next"]}
        else:
            self.close()
            self.chain = {"first": w, "low": at, "end": at + windows, "next": w["next"]}

    def close(self) -> None:
        if self.chain is not None:
            for part, low in enumerate(range(self.chain["low"], self.chain["end"], PASSAGE)):
                self.add(self.chain["first"], part, low, min(PASSAGE, self.chain["end"] - low))
        self.chain = None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the bodies to read from them: passages in parts, and bodies whose windows are compared."""
    for batch in batches:
        wanted, out = batch.column("wanted"), []
        readers: dict[int, _Reader] = {}

        def opened(batch: pa.RecordBatch = batch, wanted: pa.Array = wanted, out: list = out, readers: dict = readers) -> Iterator[list[bytes]]:
            for number, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                readers[number] = _Reader(words, wanted[number].as_py(), out)
                yield words

        current = -1
        for found in runs(opened()):
            for number, *run in zip(*(found[k].tolist() for k in ("text", "anchor", "body", "at", "windows")), strict=True):
                if number != current:
                    for done in [k for k in readers if k < number]:
                        readers.pop(done).close()
                    current = number
                readers[number].run(*run)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_WANTED)
                out.clear()
        for reader in readers.values():
            reader.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_WANTED)


WINDOW_DDL = "id bigint, n bigint, at int, window binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each body by their digests."""
    for batch in batches:
        number, n, at, window = [], [], [], []
        for row in batch.to_pylist():
            words = row["words"].split(b" ")
            count = len(words) - WINDOW + 1
            window += [hashlib.blake2b(b" ".join(words[k : k + WINDOW]), digest_size=16).digest() for k in range(count)]
            number += [row["id"]] * count
            n += [row["n"]] * count
            at += range(count)
        columns = [pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.int32()), pa.array(window, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "at", "window"])


def _stretches(places: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as stretches (first, last)."""
    out: list[list[int]] = []
    for place in places:
        if out and place == out[-1][1] + 1:
            out[-1][1] = place
        else:
            out.append([place, place])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies with the windows of theirs that recur, to passages."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            words = row["words"].split(b" ")
            for part, (low, high) in enumerate(_stretches(sorted(row["places"]))):
                cut = b" ".join(words[low : high + WINDOW])
                out.append({"anchor": row["anchor"], "body": row["body"], "n": row["n"], "part": part, "words": cut})
        yield pa.RecordBatch.from_pylist(out, schema=_WANTED)


def passages(texts: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """``anchor, body, n, part, words``: the passages that recur, under the body that opens them, which is met ``n`` times."""
    bodies = hits.groupBy("anchor", "body").agg(
        F.count(F.lit(1)).alias("n"), F.min("next").alias("next"), F.max("next").alias("other"), F.min("key").alias("key")
    )
    bodies = settle(bodies.withColumn("next", F.when(F.col("next") == F.col("other"), F.col("next"))).drop("other"), "bodies")
    kinds = bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    kinds = settle(kinds.filter("kinds > 1 and least = 1"), "kinds")
    mixed = lookup(bodies, kinds.drop("least"), ["anchor"], F.col("kinds"), total).withColumn("mixed", F.lit(True)).drop("kinds")
    plain = bodies.filter("n > 1").join(kinds.select("anchor"), "anchor", "left_anti").withColumn("mixed", F.lit(False))
    columns = ("anchor", "body", "n", "next", "mixed")
    wanted = mixed.select("key", *columns).unionByName(plain.select("key", *columns))
    wanted, counted = settle_measured(wanted.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("wanted")), "wanted", n=F.count(F.lit(1)))
    if counted["n"] * 16 <= BROADCAST_BYTES:  # Few texts to read: the others are not shuffled.
        texts = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    # Two texts of one key are both read; what they share is dropped here.
    read = texts.join(wanted, "key").select("text", "wanted").mapInArrow(_read, WANTED_DDL)
    read = settle(read.dropDuplicates(["anchor", "body", "part"]).withColumn("id", F.monotonically_increasing_id()), "passages")
    compared = read.filter(F.col("part") == COMPARED)
    rows, counted = settle_measured(compared.select("id", "n", "words").mapInArrow(_windows, WINDOW_DDL), "windows", n=F.count(F.lit(1)))
    twice = rows.groupBy("window").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("uses")).filter("n > 1").select("window", "uses")
    single = rows.filter("n = 1").select("id", "at", "window")
    again = lookup(single, settle(twice, "twice"), ["window"], F.col("uses"), counted["n"] or 0)
    places = again.groupBy("id").agg(F.collect_list("at").alias("places"))
    cut = compared.filter("n = 1").join(places, "id").select("anchor", "body", "n", "words", "places").mapInArrow(_cut, WANTED_DDL)
    return settle(read.filter(F.col("part") != COMPARED).drop("id").unionByName(cut), "recurring")


def sent(hits: DataFrame, recurring: DataFrame, blocks: int, total: int) -> DataFrame:
    """``block, words``: every passage once for each block that has the body that opens it.

    A body met often is dealt in shares of about ``HOT`` blocks, its passages to every share.
    """
    openings = settle(recurring.groupBy("anchor", "body").agg(F.first("n").alias("n")), "openings")
    met = lookup(hits.select("anchor", "body", _block(blocks).alias("block")).distinct(), openings, ["anchor", "body"], F.col("n"), total)
    shares = F.ceil(F.col("n") / HOT).cast("bigint")
    met = met.select("block", "anchor", "body", F.pmod(F.xxhash64("block"), shares).alias("share"))
    dealt = recurring.select("anchor", "body", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share"))
    return met.join(dealt, ["anchor", "body", "share"]).select("block", "words")


def _block(blocks: int):
    return F.pmod(F.xxhash64("key"), F.lit(blocks))


# --- places ------------------------------------------------------------------------------


class Passages:
    """An Aho-Corasick automaton of word sequences; words are numbered, and a sequence is a string of numbers."""

    def __init__(self):
        self.numbers: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        self.words = 0

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers
        self.automaton.add_word("".join([numbers.setdefault(word, chr(len(numbers) + 1 + (len(numbers) >= 0xD7FF) * 0x800)) for word in words]), len(words))
        self.words += len(words)

    def compile(self) -> None:
        self.automaton.make_automaton()

    def mark(self, words: list[bytes], edges: np.ndarray) -> None:
        """Count the passages that begin (+1) and have ended (-1) at every word."""
        numbers = self.numbers
        text = "".join([numbers.get(word, "\0") for word in words])
        for end, size in self.automaton.iter(text):
            edges[end + 1 - size] += 1
            edges[end + 1] -= 1


CLEANED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
CLEANED_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


class _Block:
    """The texts of a block, and what is covered in them so far."""

    def __init__(self):
        self.ids, self.texts, self.edges, self.passages = [], [], [], Passages()

    def add(self, doc_id, text: str | None) -> None:
        words = words_of(text)
        self.ids.append(doc_id)
        self.texts.append(words)
        self.edges.append(np.zeros(len(words) + 1, np.int32) if len(words) >= WINDOW else None)

    def look_for(self, words: bytes) -> None:
        self.passages.add(words.split(b" "))
        if self.passages.words >= SHARD:
            self.search()

    def search(self) -> None:
        if self.passages.words:
            self.passages.compile()
            for words, edges in zip(self.texts, self.edges, strict=True):
                if edges is not None:
                    self.passages.mark(words, edges)
        self.passages = Passages()

    def cleaned(self) -> pa.RecordBatch:
        """The finished texts; a block has at least one."""
        self.search()
        rows = []
        for doc_id, words, edges in zip(self.ids, self.texts, self.edges, strict=True):
            kept = words
            if edges is not None and edges.any():
                covered = np.cumsum(edges[:-1]) > 0
                kept = [word for word, gone in zip(words, covered.tolist(), strict=True) if not gone]
            joined = b" ".join(kept)
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")))
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), CLEANED, strict=True)], schema=CLEANED)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in a row, of each first the texts and then the passages, to cleaned texts."""
    current, block = None, None
    for batch in batches:
        columns = (batch.column(name) for name in ("block", "doc_id", "text", "words"))
        for number, doc_id, text, words in zip(*(column.to_pylist() for column in columns), strict=True):
            if block is None or number != current:
                if block is not None:
                    yield block.cleaned()
                current, block = number, _Block()
            if words is None:
                block.add(doc_id, text)
            else:
                block.look_for(words)
    if block is not None:
        yield block.cleaned()


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every document."""
    ship(documents.sparkSession)
    texts = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes")).head().bytes or 0
    blocks = -(-size // BLOCK_BYTES) + 1
    # Texts that share a key by chance share a block and are read together; nothing else depends on it.
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    counted = texts.select("text").mapInArrow(_anchors, "anchor bigint").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    anchors, measured = settle_measured(counted.filter("n > 1").select("anchor"), "anchors", n=F.count(F.lit(1)))
    hits, found = settle_measured(_hits(texts, _bit_table(anchors, measured["n"])), "hits", n=F.count(F.lit(1)))
    total = found["n"] or 0
    recurring = passages(texts.select("key", "text"), hits, total)
    none = F.lit(None)
    rows = texts.select(_block(blocks).alias("block"), "doc_id", "text", none.cast("binary").alias("words")).unionByName(
        sent(hits, recurring, blocks, total).select("block", none.cast("bigint").alias("doc_id"), none.cast("string").alias("text"), "words")
    )
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, blocks // 16)
    dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", F.col("words").isNotNull())
    return dealt.mapInArrow(_locate, CLEANED_DDL)
