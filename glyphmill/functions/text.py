"""Text functions: every one is a Column expression, none leaves the JVM.

``words_of`` alone works on a string in memory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these characters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = r""".,!?;:()\[\]{}"'"""
WHITESPACE = r" \t\n\x0B\f\r"
TRIMMED = " \t\n\r"
WORD = f"[{PUNCTUATION}]|[^{PUNCTUATION}{WHITESPACE}]+"
PREVIEW_BYTES = 50


def ascii_lower(text: Column) -> Column:
    """Lowercase A-Z only; accented letters keep their case.

    ``lower`` equals this on pure ASCII text and has a fast byte path for it;
    ``translate`` covers the rest.
    """
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def isolate_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"[{PUNCTUATION}]", " $0 ")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITESPACE}]+", " ")


def trim_ends(text: Column) -> Column:
    """Remove spaces, tabs and line ends from both ends."""
    return F.btrim(text, F.lit(TRIMMED))


def preprocess(text: Column) -> Column:
    """Lowercase, isolate punctuation, collapse whitespace, trim. NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return trim_ends(collapse_whitespace(isolate_punctuation(ascii_lower(text))))


def words(text: Column) -> Column:
    """The words of ``preprocess(text)``, as an array, in one regular-expression pass.

    After isolation a word is either one punctuation character or a longest run
    of characters that are neither punctuation nor whitespace, so the words can
    be matched directly and the spaced-out text never has to be built.
    """
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def words_of(text: str | None) -> list[str]:
    """The same words of a string in memory."""
    return re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))


def preview(text: Column, width: int = PREVIEW_BYTES) -> Column:
    """The first ``width`` bytes, cut back to a whole letter, with ``...`` if text is left."""
    fitting = F.filter(
        F.sequence(F.lit(0), F.lit(width)), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= width
    )
    cut = F.concat(F.substring(text, F.lit(1), F.array_max(fitting)), F.lit("..."))
    return F.when(F.octet_length(text) > width, cut).otherwise(text)
