"""Word pieces against an independent statement of the rule, as regular expressions."""

import random
import re

import pytest

from glyphmill.operators.lexicon import BLOCK, RUN, segment
from glyphmill.operators.words import KEY_BYTES, word_key
from glyphmill.session import BROADCAST_BYTES
from pyspark.sql import functions as F


def expected(word, vocabulary):
    """The longest first alternative is what a regular expression takes."""
    if word in vocabulary:
        return [word]

    def longest_first(texts):
        fitting = sorted((t for t in texts if 0 < len(t.encode()) <= 20), key=lambda t: len(t.encode()))
        return re.compile("|".join(map(re.escape, reversed(fitting))) or "(?!)")

    opening = longest_first(vocabulary).match(word)
    if not opening:
        return ["[UNK]"]
    inner = longest_first({t[2:] for t in vocabulary if t.startswith("##")})
    pieces, end = [opening.group()], opening.end()
    while end < len(word):
        found = inner.match(word, end)
        if not found:
            return pieces + ["[UNK]"]
        pieces.append("##" + found.group())
        end = found.end()
    return pieces


def pieces_of(spark, vocabulary, words, **options):
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    keyed = rows.withColumn("word_key", word_key(F.col("word"))).select("word", "word_key")
    found = segment(rows, vocabulary, value="token", **options).join(keyed, "word_key")
    return {r.word: r.pieces for r in found.collect()}


@pytest.mark.parametrize(
    "tokens, word, pieces",
    [
        (["ab"], "abz", ["ab", "[UNK]"]),
        (["ab", "##ab", "##a"], "abab", ["ab", "##ab"]),
        (["x" * 25], "x" * 25, ["x" * 25]),
        (["x" * 25, "x", "##x"], "x" * 26, ["x"] + ["##x"] * 25),
        (["é" * 10, "##é"], "é" * 11, ["é" * 10, "##é"]),
        (["é" * 11, "é", "##é"], "é" * 12, ["é"] + ["##é"] * 11),
        (["##ab"], "##ab", ["##ab"]),
        (["##ab", "##z"], "##abz", ["##ab", "##z"]),
        (["b"], "ab", ["[UNK]"]),
        ([], "ab", ["[UNK]"]),
        (["a", "##bc", "##b", "##cd"], "abcd", ["a", "##bc", "[UNK]"]),
    ],
)
def test_cases(spark, vocabulary_of, tokens, word, pieces):
    vocabulary = vocabulary_of(tokens)
    for limit in (0, BROADCAST_BYTES):  # by joins, and in the workers
        assert pieces_of(spark, vocabulary, [word], limit=limit) == {word: pieces}
    assert expected(word, set(tokens)) == pieces


@pytest.mark.parametrize("seed", range(4))
def test_random_words(spark, vocabulary_of, seed):
    pick = random.Random(seed)
    letters = ["ab", "abcé", "aß#漢", "ab😀"][seed]
    text = lambda most: "".join(pick.choice(letters) for _ in range(pick.randint(1, most)))
    tokens = sorted({text(7) for _ in range(15)} | {"##" + text(6) for _ in range(25)} | {"##" + letters[0]})
    words = sorted({text(14) for _ in range(300)})
    found = pieces_of(spark, vocabulary_of(tokens), words)
    assert found == {word: expected(word, set(tokens)) for word in words}
    own = vocabulary_of(tokens)
    assert 0 < own.inner_bytes < own.bytes
    for limit in (own.inner_bytes, 0):  # only the inner tokens broadcast, and nothing
        assert pieces_of(spark, own, words, limit=limit) == found


@pytest.mark.parametrize("limit", [0, BROADCAST_BYTES])
def test_long_words(spark, vocabulary_of, limit):
    """Words over the width of a key, of a block and of a run of pieces."""
    tokens = ["ab", "##ab", "##a", "##b", "é", "##é"]
    words = ["ab" * (KEY_BYTES // 2), "ab" * KEY_BYTES, "ab" * (BLOCK + 3), "é" * (2 * BLOCK + 5), "ab" * (3 * RUN) + "z"]
    found = pieces_of(spark, vocabulary_of(tokens), words, limit=limit)
    assert found == {word: expected(word, set(tokens)) for word in words}


@pytest.mark.parametrize("limit", [0, BROADCAST_BYTES])
def test_very_long_word(spark, vocabulary_of, limit):
    word = "abcdefgh" * 25_000
    found = pieces_of(spark, vocabulary_of(["ab", "##cd", "##ef", "##gh", "##ab"]), [word], limit=limit)
    assert len(found[word]) == 100_000 and found[word][-1] == "##gh"


def test_two_long_words_with_one_beginning(spark, vocabulary_of):
    words = ["a" * 100 + "b", "a" * 100 + "c"]
    found = pieces_of(spark, vocabulary_of(["a", "##a", "##b"]), words)
    assert [found[w][-1] for w in words] == ["##b", "[UNK]"]
