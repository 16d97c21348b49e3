"""Word pieces of single words, from a vocabulary that a Python worker holds or, if it is large, maps.

For vocabularies of a usual size; ``operators.lexicon`` segments by joins beyond it.
"""

from __future__ import annotations

import hashlib
import mmap
import pickle
import tempfile
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from pathlib import Path
from zlib import crc32

from pyspark import SparkFiles

from glyphmill.functions.ids import MAX_LENGTH
from glyphmill.functions.text import words_of
from glyphmill.sources.vocabulary import INNER, UNK, SpecialTokens, Vocabulary

# Fixed value: the longest text of a piece.
PIECE_BYTES = 20

REMEMBERED = 1 << 16
WORKER_BYTES = 32 * 1024 * 1024  # A vocabulary that every Python worker may hold, some half a million tokens.


# Bytes that no text has: one before a token, one between it and its id.
OPENS, CLOSES = b"\xff", b"\xfe"


def packed_ids(ids: dict[str, int]) -> bytes:
    """Tokens and ids for ``MappedIds``: the number of runs, where each starts, and the runs, a token falling to one by its checksum."""
    runs = max(len(ids), 1)
    keyed = ((token.encode("utf-8", "surrogatepass"), i) for token, i in ids.items())
    entries = sorted((crc32(key) % runs, key, i) for key, i in keyed)
    firsts, content = array("I", [runs]), bytearray()
    for run, key, i in entries:
        firsts.extend([len(content)] * (run + 2 - len(firsts)))
        content += OPENS + key + CLOSES + b"%d" % i
    firsts.extend([len(content)] * (runs + 2 - len(firsts)))
    return firsts.tobytes() + bytes(content)


class MappedIds:
    """Tokens and ids in a mapped file: a worker holds none of them as objects, and the workers of a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._file = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._file)
        width = array("I").itemsize
        self._runs = int(view[:width].cast("I")[0])
        self._content = width * (self._runs + 2)
        self._starts = view[width : self._content].cast("I")

    def get(self, token: str, default: int | None = None) -> int | None:
        key = token.encode("utf-8", "surrogatepass")
        run = crc32(key) % self._runs
        start, end = self._content + self._starts[run], self._content + self._starts[run + 1]
        at = self._file.find(OPENS + key + CLOSES, start, end)
        if at < 0:
            return default
        at += len(key) + 2
        following = self._file.find(OPENS, at, end)
        return int(self._file[at : end if following < 0 else following])

    def __contains__(self, token: str) -> bool:
        return self.get(token) is not None


MAPPED = "-mapped"


@lru_cache(maxsize=2)
def _open_ids(name: str) -> dict[str, int] | MappedIds:
    """The ids of a file, opened once per Python worker and kept between tasks."""
    path = SparkFiles.get(name)
    return MappedIds(path) if name.endswith(MAPPED) else pickle.loads(Path(path).read_bytes())


class SentIds:
    """The forward table of a vocabulary, which every worker can open: ``value``.

    A file sent to the executors and not a broadcast variable, which the state of a stream cannot hold.
    """

    def __init__(self, name: str):
        self.name = name

    @property
    def value(self) -> dict[str, int] | MappedIds:
        return _open_ids(self.name)


_sent: set[tuple[str, str]] = set()


def sent_ids(vocabulary: Vocabulary, limit: int = WORKER_BYTES) -> SentIds:
    """Send the forward table once per application, under a name of its content; beyond ``limit`` bytes it is refused.

    Up to ``WORKER_BYTES`` a worker reads it into a dictionary, beyond that it maps the file.
    """
    if vocabulary.bytes > limit:
        raise ValueError(f"a vocabulary of {vocabulary.bytes} bytes is too large to send to every worker; use embed()")
    context = vocabulary.entries.sparkSession.sparkContext
    rows = vocabulary.lookup.select("token", "token_id").toArrow()
    ids = dict(sorted(zip(rows["token"].to_pylist(), rows["token_id"].to_pylist(), strict=True)))
    held = vocabulary.bytes <= WORKER_BYTES
    content = pickle.dumps(ids) if held else packed_ids(ids)
    name = f"{hashlib.sha256(content).hexdigest()[:16]}{'-ids' if held else MAPPED}"
    if (context.applicationId, name) not in _sent:
        file = Path(tempfile.mkdtemp(prefix="glyphmill-")) / name
        file.write_bytes(content)
        context.addFile(str(file))
        _sent.add((context.applicationId, name))
    return SentIds(name)


class Segmenter:
    """``segmenter(word)``: the ids of its pieces; words met before are remembered, up to a bound."""

    def __init__(self, ids: dict[str, int] | MappedIds, unknown: int, remembered: int = REMEMBERED):
        self.known, self.unknown = ids, unknown
        self._remembered = lru_cache(remembered)(self.ids)

    def __call__(self, word: str) -> tuple[int, ...]:
        return self._remembered(word)

    def tokens(self, word: str) -> list[str]:
        """The pieces of a word: itself, or the longest entries that continue each other, ``[UNK]`` where none does."""
        if word in self.known:
            return [word]
        found, start, plain = [], 0, word.isascii()
        while start < len(word):
            mark = INNER if start else ""
            for end in range(min(len(word), start + PIECE_BYTES), start, -1):
                piece = mark + word[start:end]
                if piece in self.known and (plain or len(piece.encode()) - len(mark) <= PIECE_BYTES):
                    break
            else:
                return [*found, UNK]
            found.append(piece)
            start = end
        return found

    def ids(self, word: str) -> tuple[int, ...]:
        return tuple([self.known.get(token, self.unknown) for token in self.tokens(word)])


def model_sequence(text: str | None, pieces: Segmenter, special: SpecialTokens, length: int = MAX_LENGTH) -> list[int]:
    """The ids of a text as a model takes them: closed by special ids, cut to ``length``, not padded."""
    return closed(chain.from_iterable(map(pieces, words_of(text)[: max(length - 1, 1)])), special, length)


def closed(ids: Iterable[int], special: SpecialTokens, length: int = MAX_LENGTH) -> list[int]:
    tokens = [special.cls, *ids, special.sep]
    return tokens if len(tokens) <= length else [*tokens[: length - 1], special.sep]
