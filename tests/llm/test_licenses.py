import re
from re import _parser as parser

import pytest

from glyphmill.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    """Words, base places, and the detections that no other one suppresses."""
    words = WORDS.findall(lowered(text))
    base = sorted(
        (k, label)
        for phrase, label in licenses.BASE.items()
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    )
    line = " " + " ".join(words) + " "
    found = []
    for number, label, _, pattern, priority, weight in licenses.RULES:
        for match in re.finditer(pattern, line):
            start = line[: match.start()].count(" ") - 1
            found.append((number, label, priority, weight, start, start + match[0].count(" ")))

    def beaten(d, e):
        if d[0] == e[0] or not (e[4] <= d[4] and e[5] >= d[5]):
            return False
        mine, other = d[5] - d[4], e[5] - e[4]
        return e[2] < d[2] or (e[2] == d[2] and (other > mine or (other == mine and e[0] < d[0])))

    kept = [d for d in found if not any(beaten(d, e) for e in found)]
    return len(words), base, sorted(kept)


TEXTS = [
    None,
    "",
    "   ",
    "Released under the MIT License.",
    "under the MIT license under-the-mit_license UNDER the Mit\nLICENSE",
    "Licensed under the Apache License, Version 2.0. See LICENSE.",
    "apache license version 2x and apache license version 2",
    "CC-BY-NC 4.0, CC BY NC SA; cc_by_nc; Creative Commons Attribution ShareAlike 4.0 license",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: BSD 3-Clause",
    "This program is distributed under the terms of the GNU Lesser General Public License v2.1 or later.",
    "licence é mit licence, das ist die MIT-Lizenz",
    "The word license alone; a summit license; permit licensed",
    "x " * 5000 + "under the mit license " + "y " * 5000 + "under the mit license",
    "GPLv2 and MPL 2.0 license, Boost Software License 1.0",
    "We want to boost our sales",
    "use the business source of income",
    "a public cc by attribution desk",
    "Business Source License 1.1, cc by 4.0, CC BY license",
    "under the boost license, released under Boost.",
]


def test_texts_against_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for row in licenses.scan(rows).collect():
        n_words, base, kept = brute(TEXTS[row.doc_id])
        assert row.n_words == n_words
        assert sorted((b.start, b.label) for b in row.base) == base
        found = sorted((d.id, d.label, d.priority, d.weight, d.start, d.stop) for d in row.found or [])
        assert found == kept, TEXTS[row.doc_id][:80]
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(base or kept)


@pytest.mark.parametrize(
    "text", ["We want to boost our sales", "use the business source of income", "a public cc by attribution desk", "an artistic summit"]
)
def test_ordinary_words_are_no_licenses(spark, text):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert not row.found and row.score == 0 and not row.base


def test_a_keyword_is_a_word_and_every_name_has_one():
    for label, keywords, name in licenses.FAMILIES:
        assert all(len(word.strip()) >= 3 or " " in word.strip() for word in keywords), label
        for turn in range(8):
            line = f" the {minimal(name, turn)} license "
            assert any(word in line for word in keywords), (label, line)


def test_very_long_text(spark):
    text = "word " * 300_000 + "released under the MIT License. " + "word " * 300_000
    row = licenses.scan(spark.createDataFrame([(1, text), (2, "x" * 2_000_000)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert row[0].n_words == 600_005 and [d.start for d in row[0].found] == [300_000] and row[1].n_words == 1


def test_there_are_hundreds_of_rules():
    assert len(licenses.RULES) > 300 and len({r[3] for r in licenses.RULES}) == len(licenses.RULES)


@pytest.mark.parametrize("columns", ["doc_id bigint, text string, base string, found int, score string, n_words int"])
def test_clashing_columns_and_empty_table(spark, columns):
    empty = spark.createDataFrame([], columns)
    assert licenses.scan(empty).count() == 0
    one = spark.createDataFrame([(1, "under the mit license", "x", 3, "y", 7)], columns)
    row = licenses.scan(one).first()
    assert row.base[0].label == "mit" and row.n_words == 4


def minimal(pattern, turn):
    """A text that a rule needs nothing but to match; ``turn`` chooses among alternatives."""

    def of(parts):
        out = ""
        for kind, value in parts:
            if kind is parser.LITERAL:
                out += chr(value)
            elif kind is parser.IN:
                out += chr(value[turn % len(value)][1]) if value[0][0] is parser.LITERAL else chr(value[0][1][0])
            elif kind is parser.BRANCH:
                out += of(value[1][turn % len(value[1])])
            elif kind is parser.SUBPATTERN:
                out += of(value[3])
            elif kind is parser.MAX_REPEAT:
                out += of(value[2]) * value[0]
        return out

    return of(parser.parse(pattern))


def test_every_rule_on_a_text_of_its_own(spark):
    texts = sorted({minimal(rule[3], turn) for rule in licenses.RULES for turn in range(6)})
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    for row in licenses.scan(rows).collect():
        found = sorted((d.id, d.label, d.priority, d.weight, d.start, d.stop) for d in row.found or [])
        assert found and found == brute(texts[row.doc_id])[2], texts[row.doc_id]
