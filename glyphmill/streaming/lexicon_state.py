"""Tokenising a stream with a lexicon that grows: a word is segmented once in the life of the stream.

The lexicon is the state of the stream, kept by bucket, a hash of the word. Texts travel in chunks of a bounded size: a
chunk sends each bucket the different words it has there, in one row, however often and in how many texts they occur, and
its texts as numbers of these words. A bucket looks the words of a micro-batch up in its state, segments those it has
not met and remembers them; it also sees that no two texts have one key. The parts of a chunk come back together in the
batch's sink, where numbers become ids.

State lives in the state store of the query's checkpoint: a stream that is started again knows its words. A bucket keeps
them in pages, which double in number as words come, so a page stays small and is read and written at once.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b
from itertools import chain, count, islice
from struct import Struct
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from glyphmill.functions.ids import MAX_LENGTH, truncate
from glyphmill.functions.pieces import Segmenter, SentIds, sent_ids
from glyphmill.functions.text import LOWER, UPPER, WORD, ascii_lower
from glyphmill.functions.text import words as words  # the words of a column, which are those that a chunk takes
from glyphmill.operators.embed import BATCH_SIZE, Encoder, embedding
from glyphmill.operators.tokens import KEYS
from glyphmill.session import BROADCAST_BYTES, ship
from glyphmill.sources.vocabulary import Vocabulary

BUCKETS = 64
CHUNK_CHARS = 1 << 21  # of the texts of a chunk, unless a single text has more; it has no more words or tokens than that
KEY_CHARS = 16  # a text's key counts as so many, also that of an empty text
PAGE_WORDS = 512  # words of a page before a bucket takes twice as many pages
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 * 1024 * 1024  # of what goes to a worker at once
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROWS = "bucket int, chunk string, words string, owners binary, texts binary"
_PARTS = "chunk string, bucket int, ids string, fresh binary, dropped binary, texts binary"
_OWNER = Struct("<16sI?")  # a text's key, its place in the chunk, whether it has words


def _spot(word: str, buckets: int) -> tuple[int, int]:
    """A hash that tells pages apart, and the bucket."""
    return divmod(crc32(word.encode()), buckets)


class _Chunk:
    """Texts by numbers of their different words."""

    def __init__(self):
        self.keys: list[pa.RecordBatch] = []
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a word not met before gets the next number
        self.codes, self.ends, self.chars = array("I"), array("I", [0]), 0

    def add(self, text: str, found: Sequence[str]) -> None:
        self.codes.extend(map(self.numbers.__getitem__, found))
        self.ends.append(len(self.codes))
        self.chars += len(text) + KEY_CHARS

    def rows(self, name: str, buckets: int, labels: Sequence[int]) -> pa.RecordBatch:
        """A row for each bucket that words or keys fall to; the texts go with one of them.

        Words are numbered by bucket, so the ids of the buckets' words in a row are those of all numbers.
        """
        self.numbers.default_factory = None  # else the two hold each other, and all chunks of a task stay in memory
        listed = list(self.numbers)
        at = np.fromiter((_spot(word, buckets)[1] for word in listed), np.int64, len(listed))
        order = np.argsort(at, kind="stable")
        rank = np.empty(len(listed), np.uint16 if len(listed) <= 1 << 16 else np.uint32)
        rank[order] = np.arange(len(listed))
        ends = np.frombuffer(self.ends, np.uint32)
        codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rank[np.frombuffer(self.codes, np.uint32)]))
        keys = pa.Table.from_batches(self.keys).combine_chunks()
        sink = pa.BufferOutputStream()
        table = pa.table([*keys.columns, codes], names=[str(k) for k in range(keys.num_columns + 1)])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        texts = sink.getvalue().to_pybytes()
        owners = defaultdict(bytearray)
        for place, (key, has) in enumerate(zip(zip(*(c.to_pylist() for c in keys.columns), strict=True), np.diff(ends) > 0, strict=True)):
            digest = blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            owners[crc32(digest) % buckets] += _OWNER.pack(digest, place, has)
        cuts = np.searchsorted(at[order], np.arange(buckets + 1))
        shares = [[listed[i] for i in order[cuts[b] : cuts[b + 1]]] for b in range(buckets)]
        # Named by its content too: parts of a chunk that was made anew in another way are not taken for parts of this one.
        content = blake2b(texts, digest_size=16)
        content.update("\n".join(listed).encode())
        name, home = f"{name}-{content.hexdigest()}", crc32(texts) % buckets
        rows = [
            (labels[b], name, "\n".join(shares[b]), bytes(owners[b]), texts if b == home else None)
            for b in range(buckets)
            if shares[b] or b in owners or b == home
        ]
        types = [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "words", "owners", "texts"])


def _chunks(
    buckets: int, labels: Sequence[int], max_words: int | None, chars: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(keys, lowered text)`` to the rows of ``_ROWS``."""
    pattern = re.compile(WORD)

    def first(text: str) -> list[str]:
        return [found.group() for found in islice(pattern.finditer(text), max_words)]

    split = pattern.findall if max_words is None else first

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk = TaskContext.get().partitionId(), count(), _Chunk()
        for batch in batches:
            start, last = 0, batch.num_columns - 1
            keys = batch.select(range(last))
            for place, value in enumerate(batch.column(last), 1):
                text = value.as_py()
                chunk.add(text, split(text))
                if chunk.chars >= chars:
                    chunk.keys.append(keys.slice(start, place - start))
                    yield chunk.rows(f"{task}-{next(number)}", buckets, labels)
                    start, chunk = place, _Chunk()
            chunk.keys.append(keys.slice(start))
        if len(chunk.ends) > 1:
            yield chunk.rows(f"{task}-{next(number)}", buckets, labels)

    return chunks


class _Lexicon(StatefulProcessor):
    """One bucket: pages of lines ``word ids`` as its state."""

    def __init__(self, ids: SentIds, unknown: int, buckets: int, page_words: int):
        self.ids, self.unknown, self.buckets, self.page_words = ids, unknown, buckets, page_words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("pages", "page int", "lines string")
        self.size = handle.getValueState("size", "words bigint, pages int")
        self.pieces: Segmenter | None = None  # made when rows come: the driver opens this object too

    def _page_of(self, word: str, pages: int) -> int:
        return _spot(word, self.buckets)[0] & (pages - 1)

    def _read(self, page: int) -> dict[str, str]:
        state = self.known.getValue((page,))
        return {} if state is None else dict(line.split(" ", 1) for line in state[0].split("\n"))

    def _write(self, page: int, lines: dict[str, str]) -> None:
        self.known.updateValue((page,), ("\n".join([f"{word} {ids}" for word, ids in lines.items()]),))

    def _paged(self, words: int, pages: int, met: int) -> int:
        """As many pages as the words, known or met now, need: a power of two."""
        wanted = max(pages, 1)
        while wanted * self.page_words < max(words, met):
            wanted *= 2
        for page in range(pages if wanted > pages else 0):
            parts: dict[int, dict[str, str]] = defaultdict(dict)
            for word, ids in self._read(page).items():
                parts[self._page_of(word, wanted)][word] = ids
            for part, lines in parts.items():
                self._write(part, lines)
            if parts and page not in parts:
                self.known.removeKey((page,))
        return wanted

    def _resolve(self, met: set[str]) -> tuple[dict[str, str], set[str]]:
        """The ids of words, and those words that were segmented now."""
        self.pieces = self.pieces or Segmenter(self.ids.value, self.unknown)
        words, before = self.size.get() if self.size.exists() else (0, 0)
        pages = self._paged(words, before, len(met))
        asked: dict[int, list[str]] = defaultdict(list)
        for word in met:
            asked[self._page_of(word, pages)].append(word)
        ids, fresh = {}, set()
        for page, own in asked.items():
            lines = self._read(page) if words else {}  # a bucket's first micro-batch has nothing to look up
            new = [word for word in own if word not in lines]
            lines.update((word, " ".join(map(str, self.pieces.ids(word)))) for word in new)
            ids.update((word, lines[word]) for word in own)
            if new:
                self._write(page, lines)
                fresh.update(new)
        if fresh or pages != before:
            self.size.update((words + len(fresh), pages))
        return ids, fresh

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket, names = int(key[0]), ["chunk", "bucket", "ids", "fresh", "dropped", "texts"]
        shares: list[tuple[str, str]] = []
        met: set[str] = set()
        owner: dict[bytes, tuple[str, int, bool]] = {}
        dropped: dict[str, list[int]] = defaultdict(list)  # texts without words whose key another text has
        for frame in rows:
            for chunk, share, owners in zip(frame["chunk"], frame["words"], frame["owners"], strict=True):
                if share:
                    shares.append((chunk, share))
                    met.update(share.split("\n"))
                for digest, place, has in _OWNER.iter_unpack(owners):
                    other = owner.get(digest)
                    if other and other[2] and has:
                        raise ValueError("two texts have one key")
                    if other is None or has:
                        owner[digest] = (chunk, place, has)
                    lost = (chunk, place) if other and not has else other
                    if lost:
                        dropped[lost[0]].append(lost[1])
            passed = frame.loc[frame["texts"].notna(), ["chunk", "texts"]]
            yield passed.assign(bucket=bucket, ids=None, fresh=None, dropped=None)[names]
        ids, fresh = self._resolve(met) if met else ({}, set())
        found = []
        for chunk, share in shares:
            own = share.split("\n")
            new = [k for k, word in enumerate(own) if word in fresh] if fresh else []
            fresh.difference_update([own[k] for k in new])
            lost = dropped.pop(chunk, [])
            lines = "\n".join([ids[word] for word in own])
            found.append((chunk, bucket, lines, np.array(new, np.uint32).tobytes(), np.array(lost, np.uint32).tobytes(), None))
        found += [(chunk, bucket, None, None, np.array(lost, np.uint32).tobytes(), None) for chunk, lost in dropped.items()]
        for start in range(0, len(found), 1000):
            yield pd.DataFrame(found[start : start + 1000], columns=names)

    def close(self) -> None:
        pass


def _labels(spark: SparkSession, buckets: int) -> list[int]:
    """A number for every bucket, ascending, so that any number of tasks that divides them gets as many of them each."""
    number = F.col("id").cast("int")
    drawn = spark.range(64 * buckets).select(number.alias("label"), F.pmod(F.hash(number), F.lit(buckets)).alias("at"))
    return sorted({row["at"]: row["label"] for row in sorted(drawn.collect(), reverse=True)}.values())


def _lowered(text: Column) -> Column:
    """``ascii_lower`` with bytes that are no text replaced, as ``words`` replaces them: a worker cannot read them."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.is_valid_utf8(text), ascii_lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_ids(
    texts: DataFrame,
    vocabulary: Vocabulary,
    keys: Sequence[str] = KEYS,
    max_words: int | None = None,
    buckets: int = BUCKETS,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """The parts of the chunks of a stream of texts, which ``token_ids`` puts together: from each bucket the ids of a chunk's
    words, which of them were segmented for it, which texts are another's copies, and once the texts by their words."""
    ship(texts.sparkSession)
    labels = _labels(texts.sparkSession, buckets)
    rows = texts.select(*keys, _lowered(F.col("text")).alias("_text")).mapInArrow(_chunks(buckets, labels, max_words, CHUNK_CHARS), _ROWS)
    lexicon = _Lexicon(sent_ids(vocabulary, limit), vocabulary.unk_piece, buckets, PAGE_WORDS)
    return rows.groupBy("bucket").transformWithStateInPandas(lexicon, outputStructType=_PARTS, outputMode="Update", timeMode="None")


def _places(values: pa.ChunkedArray, shifts: Sequence[int]) -> np.ndarray:
    """Places that parts give, each shifted by where the part starts."""
    found = [np.frombuffer(v, np.uint32).astype(np.int64) + shift for v, shift in zip(values.to_pylist(), shifts, strict=True) if v]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _whole(names: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """The parts of a chunk to ``(keys, ids, segmented)``."""

    def whole(parts: pa.Table) -> pa.Table:
        sent = parts.column("texts").drop_null()
        if len(sent) != 1:
            raise RuntimeError(f"a chunk has its texts {len(sent)} times")
        table = pa.ipc.open_stream(sent[0].as_py()).read_all().combine_chunks()
        codes = table.column(table.num_columns - 1).chunk(0)
        ends, numbers = codes.offsets.to_numpy(), codes.values.to_numpy()
        shares = parts.filter(pc.is_valid(parts.column("ids"))).sort_by("bucket")
        own = [share.split("\n") for share in shares.column("ids").to_pylist()]
        lines = list(chain.from_iterable(own))
        if len(lines) != (int(numbers.max()) + 1 if len(numbers) else 0):
            raise RuntimeError("a chunk lacks words")
        split = pc.split_pattern(pa.array(lines, pa.string()), " ")
        ids = pa.ListArray.from_arrays(split.offsets, split.values.cast(pa.int32()))
        taken = ids.take(pa.array(numbers))
        tokens = pa.ListArray.from_arrays(taken.offsets.take(codes.offsets), taken.values)
        # A word segmented now counts for the first text of the chunk that has it.
        fresh = _places(shares.column("fresh"), np.cumsum([0, *map(len, own)])[:-1])
        first = np.zeros(len(lines), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        segmented = np.bincount(np.searchsorted(ends, first[fresh], side="right") - 1, minlength=len(codes))
        kept = np.ones(len(codes), bool)
        kept[_places(parts.column("dropped"), [0] * len(parts))] = False
        out = pa.table([*table.columns[:-1], tokens, pa.array(segmented, pa.int64())], names=[*names, "ids", "segmented"])
        return out if kept.all() else out.filter(pa.array(kept))

    return whole


def token_ids(parts: DataFrame, vocabulary: Vocabulary, keys: StructType, tasks: int | None = None) -> DataFrame:
    """``(keys, token_ids, segmented)``: the parts of a micro-batch, put together in ``tasks`` tasks."""
    parts = parts if tasks is None else parts.repartition(tasks, "chunk")
    special = vocabulary.special
    schema = StructType([*keys.fields]).add("ids", ArrayType(IntegerType())).add("segmented", LongType())
    whole = parts.groupBy("chunk").applyInArrow(_whole(keys.names), schema)
    ids = F.concat(F.array(F.lit(special.cls)), F.col("ids"), F.array(F.lit(special.sep)))
    return whole.select(*keys.names, ids.alias("token_ids"), "segmented")


def _start(spark: SparkSession, writer, buckets: int) -> StreamingQuery:
    """Start a query with a state store that such state needs, in tasks of as many buckets each: a task opens a
    store and a worker even if no bucket falls to it. The session keeps its own settings."""
    before = {name: spark.conf.get(name) for name in (_PROVIDER, _PARTITIONS, _BATCH)}
    tasks = max(n for n in range(1, min(int(before[_PARTITIONS]), buckets) + 1) if buckets % n == 0)
    for name, value in ((_PROVIDER, _ROCKS), (_PARTITIONS, tasks), (_BATCH, BATCH_BYTES)):
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tokenize_stream(
    texts: DataFrame,
    vocabulary: Vocabulary,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = KEYS,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """``tokenize`` on a stream, into Parquet: ``(keys, token_ids, segmented)``, a folder per micro-batch.

    A micro-batch that is repeated after a failure overwrites its own folder.
    """

    tasks, kept = int(texts.sparkSession.conf.get(_PARTITIONS)), texts.select(*keys).schema

    def write(batch: DataFrame, number: int) -> None:
        token_ids(batch, vocabulary, kept, tasks).write.mode("overwrite").parquet(f"{path}/batch={number}")

    parts = word_ids(texts, vocabulary, keys, **options)
    writer = parts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(texts.sparkSession, writer.trigger(**(trigger or {"availableNow": True})), options.get("buckets", BUCKETS))


def embed_stream(
    texts: DataFrame,
    vocabulary: Vocabulary,
    encoder: Encoder,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = KEYS,
    trigger: dict | None = None,
    batch_size: int | None = None,
    length: int = MAX_LENGTH,
    **options,
) -> StreamingQuery:
    """Embed a stream of texts into Parquet, ``(keys, embedding)``: only words the stream has not met are segmented."""

    tasks, kept = int(texts.sparkSession.conf.get(_PARTITIONS)), texts.select(*keys).schema

    def write(batch: DataFrame, number: int) -> None:
        tokens = token_ids(batch, vocabulary, kept, tasks)
        cut = truncate(F.col("token_ids"), vocabulary.special.sep, length)
        vectors = embedding(cut, encoder, vocabulary.special.pad, batch_size or BATCH_SIZE, length)
        tokens.select(*keys, vectors.alias("embedding")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    parts = word_ids(texts, vocabulary, keys, max_words=max(length - 1, 1), **options)
    writer = parts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(texts.sparkSession, writer.trigger(**(trigger or {"availableNow": True})), options.get("buckets", BUCKETS))
