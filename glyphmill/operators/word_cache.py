"""Words and their ids kept on the driver, for calls on a few strings.

Tables of texts never come here: their words are segmented by joins on the
executors. A call on a handful of strings would spend its time on planning and starting
those joins, so the session remembers the words it has met, up to a bound, the least recently
used ones going first. Only words it has not met are segmented, by the same join.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from threading import Lock

from glyphmill.operators.lexicon import segment
from glyphmill.sources.vocabulary import Vocabulary

WORDS = 1 << 16


class WordCache:
    def __init__(self, vocabulary: Vocabulary, words: int = WORDS):
        self.vocabulary, self.words = vocabulary, words
        self._known: OrderedDict[str, tuple[int, ...]] = OrderedDict()
        self._lock = Lock()

    def __len__(self) -> int:
        return len(self._known)

    def ids_of(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of the pieces of each word; one job if there are words not met before."""
        asked, found = set(words), {}
        with self._lock:
            for word in asked & self._known.keys():
                self._known.move_to_end(word)
                found[word] = self._known[word]
        new = sorted(asked - found.keys())
        if new:
            spark = self.vocabulary.entries.sparkSession
            distinct = spark.createDataFrame([(word, 1) for word in new], "word string, n bigint")
            pieces = segment(distinct, self.vocabulary, named=True).select("word", "pieces").collect()
            found |= {row.word: tuple(row.pieces) for row in pieces}
            with self._lock:
                for word in new[-self.words :]:
                    self._known[word] = found[word]
                while len(self._known) > self.words:
                    self._known.popitem(last=False)
        return found
