"""License notices: ordered signature rules behind a keyword filter.

A text is lower-cased (A-Z) and read as words, runs of digits, letters and non-ASCII
characters. Rules are regular expressions over the words joined by blanks: every
license family is written in every form of notice. A text is looked at only if it holds
a word that any notice needs, and a rule only if one of its family's keywords occurs. What is
found is an interval of words; an interval inside another one is suppressed if
the other's rule comes first in priority, or has the same and is longer (then:
the earlier rule). Base phrases are matched besides and are never suppressed.

Everything is a DataFrame expression, per text, without a shuffle. Defined cases:
a null text is an empty one, without words and labels; texts of any length are read whole; places of one phrase are
counted each; of detections of one interval and priority that of the earlier rule stays; rows are taken as they
come, repeated ones alike; columns named like the added ones give way to them; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import ascii_lower

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# What separates words in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# What the keyword filter looks for: alternatives of which a text that holds the family's name holds one.
GPL, LGPL, AGPL = (" gpl", "general public"), (" lgpl", "lesser general public", "library general public"), (" agpl", "affero general public")
GFDL, MPL, EPL = (" gfdl", " fdl", "free documentation"), (" mpl", "mozilla public"), (" epl", "eclipse public")
CC = ("creative commons", " cc by", " cc attribution")

# Families: label, keywords, name as a pattern over words.
FAMILIES = [
    ("mit", (" mit ",), "mit"),
    ("mit-0", (" mit ",), "mit (?:0|no attribution)"),
    ("apache-2", (" apache",), "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", (" apache",), "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1 1"),
    ("bsd-2", ("bsd ",), "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", ("bsd ",), "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", ("bsd ",), "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", (" bsd ",), "bsd"),
    ("gpl-1", GPL, "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?1(?: 0)?(?: or later)?"),
    ("gpl-2", GPL, "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?2(?: 0)?(?: or later)?"),
    ("gpl-3", GPL, "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?3(?: 0)?(?: or later)?"),
    ("gpl", GPL, "(?:gnu )?(?:gpl|general public licen[sc]e)"),
    ("lgpl-2.1", LGPL, "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version| v)? ?2(?: 1| 0)?"),
    ("lgpl-3", LGPL, "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? ?3(?: 0)?"),
    ("lgpl", LGPL, "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)"),
    ("agpl-3", AGPL, "(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version| v)? ?3(?: 0)?"),
    ("agpl", AGPL, "(?:gnu )?(?:agpl|affero general public licen[sc]e)"),
    ("gfdl-1", GFDL, "(?:gnu )?(?:gfdl|fdl|free documentation licen[sc]e)(?: version| v)? ?1 [123]"),
    ("gfdl", GFDL, "(?:gnu )?(?:gfdl|fdl|free documentation licen[sc]e)"),
    ("mpl-1", MPL, "(?:mpl|mozilla public licen[sc]e)(?: version| v)? ?1 [01]"),
    ("mpl-2", MPL, "(?:mpl|mozilla public licen[sc]e)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", EPL, "(?:epl|eclipse public licen[sc]e)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", EPL, "(?:epl|eclipse public licen[sc]e)(?: version| v)? ?2(?: 0)?"),
    ("eupl", (" eupl", "european union public"), "(?:eupl|european union public licen[sc]e)(?: version| v)?(?: 1 [012])?"),
    ("cddl-1", (" cddl", "common development and"), "(?:cddl|common development and distribution licen[sc]e)(?: version| v)?(?: 1 [01])?"),
    ("cpl-1", ("common public",), "common public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?"),
    ("isc", (" isc ",), "isc"),
    ("zlib", (" zlib ",), "zlib(?: libpng)?"),
    ("boost-1", (" boost",), "boost(?: software)?(?: licen[sc]e)?(?: version| v)?(?: 1 0)?"),
    ("artistic-1", (" artistic",), "artistic(?: licen[sc]e)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", (" artistic",), "artistic(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("python-2", (" python ",), "python(?: software foundation)?"),
    ("postgresql", (" postgresql ",), "postgresql"),
    ("openssl", (" openssl ",), "openssl"),
    ("unlicense", (" unlicense ",), "unlicense"),
    ("wtfpl", (" wtfpl ",), "wtfpl"),
    ("ofl-1.1", (" ofl", "open font"), "(?:ofl|(?:sil )?open font licen[sc]e)(?: version| v)?(?: 1 1)?"),
    ("odbl-1", (" odbl", "open database"), "(?:odbl|open database licen[sc]e)(?: version| v)?(?: 1 0)?"),
    ("odc-by", (" odc by",), "odc by(?: 1 0)?"),
    ("cc0", ("cc0",), "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", CC, "(?:creative commons|cc) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|no derivatives)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", CC, "(?:creative commons|cc) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)(?: [1-4] [05])?"),
    ("cc-by-nc", CC, "(?:creative commons|cc) (?:by|attribution) (?:nc|noncommercial|non commercial)(?: [1-4] [05])?"),
    ("cc-by-nd", CC, "(?:creative commons|cc) (?:by|attribution) (?:nd|noderivatives|no derivatives)(?: [1-4] [05])?"),
    ("cc-by-sa", CC, "(?:creative commons|cc) (?:by|attribution) (?:sa|sharealike|share alike)(?: [1-4] [05])?"),
    ("cc-by", CC, "(?:creative commons|cc) (?:by|attribution)(?: [1-4] [05])?"),
    ("ms-pl", (" ms pl ", "microsoft public"), "(?:ms pl|microsoft public licen[sc]e)"),
    ("elastic-2", (" elastic",), "elastic(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("bsl-1.1", (" business source",), "business source(?: licen[sc]e)?(?: version| v)?(?: 1 1)?"),
    ("proprietary", (" proprietary ",), "proprietary"),
]

# Names whose words are also ordinary ones: alone they count only with a version or the word for license.
STRICT = {
    "boost-1": "boost software licen[sc]e(?: version| v)?(?: 1 0)?",
    "bsl-1.1": "business source licen[sc]e(?: version| v)?(?: 1 1)?",
    "cc-by": "(?:creative commons|cc) (?:by|attribution) (?:[1-4] [05]|licen[sc]e)",
}

# Forms of a notice in order of priority: name, pattern around the family's name, confidence.
FORMS = [
    ("identifier", "spdx licen[sc]e identifier {name}", 1.0),
    ("granted", "permission (?:is )?(?:hereby )?granted under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", 0.98),
    ("notice", "(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", 0.95),
    ("terms", "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name} licen[sc]e", 0.9),
    ("governed", "(?:governed|covered) by (?:the )?{name}(?: licen[sc]e)?", 0.85),
    ("heading", "the {name} licen[sc]e", 0.7),
    ("field", "licen[sc]e(?: is| name| type)? {name}", 0.6),
    ("name", "{name} licen[sc]e", 0.5),
]
# A name that holds its own word for license stands for itself, with the weight of a name.
ALONE = ("alone", "{name}", 0.4)
BASE_SCORE = 0.9

RULES = [
    (number, label, keywords, f"(?<= ){form.format(name=name)}(?= )", priority, weight)
    for number, (priority, (_, form, weight), (label, keywords, name)) in enumerate(
        (p, f, (label, keywords, STRICT.get(label, name) if f is ALONE else name))
        for p, f in enumerate([*FORMS, ALONE])
        for label, keywords, name in FAMILIES
        if f is not ALONE or "licen" in name or label.startswith("cc")
    )
]

# What rules without the word for license need: leading words of the forms, or how a name alone begins.
LEADS = ("released under", "distributed under", "published under", "available under", "provided under", "granted under", "governed by", "covered by")
NAMES = "apache gnu gpl lgpl agpl gfdl fdl mpl epl eupl cddl boost artistic ofl odbl cc0 elastic".split()
PAIRS = ("creative commons", "cc by", "cc attribution", "ms pl", "business source")


def _gate(words: Column) -> Column:
    """Whether joined words can hold a notice or a base phrase; one that can is never left out."""
    needed = ["license", "licence", *[f" {start}" for start in (*LEADS, *NAMES, *PAIRS)]]
    return reduce(lambda a, b: a | b, [words.contains(word) for word in needed])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def places(words: Column, pattern: Column) -> Column:
    """Where a pattern is found: ``start, stop`` in words, the last word included."""
    between, found = F.split(words, pattern, -1), F.regexp_extract_all(words, pattern, F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(_spaces(b).alias("before"), _spaces(m).alias("inside")))
    empty = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["before"]
        place = F.struct(start.alias("start"), (start + item["inside"]).alias("stop"))
        return F.struct((start + item["inside"]).alias("at"), F.array_append(state["found"], place).alias("found"))

    return F.aggregate(steps, empty, step)["found"]


def _stated(words: Column, phrase: str, label: str) -> Column:
    found = places(words, F.lit(f"(?<= ){phrase}(?= )"))
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label")))


def _families() -> Column:
    """The rules by family: ``keywords`` and ``rules``."""
    names = ("id", "label", "pattern", "priority", "weight")

    def literal(rule: tuple) -> Column:
        number, label, _, pattern, priority, weight = rule
        return F.struct(*[F.lit(v).alias(n) for v, n in zip((number, label, pattern, priority, weight), names, strict=True)])

    return F.array(
        *[
            F.struct(
                F.array(*[F.lit(word) for word in keywords]).alias("keywords"),
                F.array(*[literal(rule) for rule in RULES if rule[1] == label]).alias("rules"),
            )
            for label, keywords, _ in FAMILIES
        ]
    )


def detections(words: Column) -> Column:
    """All intervals that rules find, before suppression; only rules of families with a keyword in the text are tried."""
    named = F.filter(_families(), lambda f: F.exists(f["keywords"], lambda word: words.contains(word)))
    rules = F.flatten(F.transform(named, lambda f: f["rules"]))
    live = F.array_sort(F.filter(rules, lambda r: F.rlike(words, r["pattern"])))

    def of(rule: Column) -> Column:
        return F.transform(
            places(words, rule["pattern"]),
            lambda p: F.struct(rule["id"].alias("id"), rule["label"].alias("label"), rule["priority"].alias("priority"),
                               rule["weight"].alias("weight"), p["start"].alias("start"), p["stop"].alias("stop")),
        )

    return F.flatten(F.transform(live, of))


def unsuppressed(found: Column) -> Column:
    """Those that lie in no interval which comes before them."""

    def beaten(d: Column, e: Column) -> Column:
        inside = (e["start"] <= d["start"]) & (e["stop"] >= d["stop"]) & (e["id"] != d["id"])
        longer = (e["stop"] - e["start"]) > (d["stop"] - d["start"])
        same = (e["stop"] - e["start"]) == (d["stop"] - d["start"])
        return inside & ((e["priority"] < d["priority"]) | (e["priority"] == d["priority"]) & (longer | same & (e["id"] < d["id"])))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: beaten(d, e)))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``n_words, base`` (start, label), ``found`` (kept detections), ``score``."""
    value = F.coalesce(F.col(text), F.lit(""))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(value), BETWEEN, " ")), F.lit(" "))
    words = documents.withColumn("_words", joined)
    count = F.when(F.length("_words") > 2, _spaces(F.col("_words")) - 1).otherwise(0)
    words = words.withColumns({"n_words": count.cast("bigint"), "_words": F.when(_gate(F.col("_words")), F.col("_words"))})
    base = F.flatten(F.array(*[_stated(F.col("_words"), phrase, label) for phrase, label in BASE.items()]))
    looked = words.withColumns(
        {
            "base": F.when(F.col("_words").isNotNull(), base),
            "found": F.when(F.col("_words").isNotNull(), detections(F.col("_words"))),
        }
    )
    kept = looked.withColumns(
        {
            "base": F.coalesce("base", F.array().cast("array<struct<start:int,label:string>>")),
            "found": F.when(F.size("found") > 0, unsuppressed(F.col("found"))),
        }
    ).drop("_words")
    weight = F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0))
    return kept.withColumn("score", F.greatest(weight, F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0)))
