"""Text expressions.

Patterns follow ASCII word boundaries and the wide whitespace set (no-break
space, byte-order mark, Unicode spaces), which differ from the JVM defaults,
so both are spelled out here.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import config as C

# The whitespace characters, as a pattern set and as plain text
SPACE_SET = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_SET}]"
# whitespace that is not already one plain space; the plain ranges settle most characters
LOOSE_SPACE = rf"[\x09-\x0D\x{{A0}}\x{{1680}}-\x{{FEFF}}&&{SPACE}]{SPACE}*| (?![!-~]){SPACE}+"
SPACE_CHARS = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)))

BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# The address and number patterns
EMAIL_PATTERN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE_PATTERN = rf"(?:\+91[{SPACE_SET}-]?)?[6-9]\d{{4}}[-{SPACE_SET}]?\d{{5}}(?!\w)"


# The address pattern, tried only where a run of address characters starts or the last match
# ended, and taking the run whole: the same matches, in time linear in the text.
EMAIL_SCAN = EMAIL_PATTERN.replace("(?i)[A-Z0-9._%+-]+", r"(?i)(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++")

# How a number option may be written
NUMBER_PATTERN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def portable(pattern: str) -> str:
    """A JVM pattern in which ``\\b`` is ASCII and ``\\s`` the wide set."""
    return pattern.replace(r"\b", BOUNDARY).replace(r"\s", SPACE)


def whole_word(term: str) -> str:
    """Pattern for a literal between ASCII word boundaries.

    Next to a term that ends in punctuation ("c++") a boundary asks for a word
    character on the far side.  The literal comes first in the pattern, so most
    positions fail on one character.
    """
    literal = re.escape(term)

    def is_word(char: str) -> bool:
        return re.match(r"\w", char, re.ASCII) is not None

    before = rf"(?<!\w{literal})" if is_word(term[0]) else rf"(?<=\w{literal})"
    after = r"(?!\w)" if is_word(term[-1]) else r"(?=\w)"
    return literal + before + after


def text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def lowered(col: Column) -> Column:
    return F.lower(text(col))


def trimmed(col: Column) -> Column:
    return F.btrim(text(col), F.lit(SPACE_CHARS))


def non_blank(col: Column) -> Column:
    """The column, with the empty string turned to null."""
    return F.nullif(col, F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[non_blank(c) for c in cols], F.lit(""))


def collapsed(col: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(text(col), LOOSE_SPACE, " "))


def cleaned(col: Column, max_chars: int = C.DESCRIPTION_CHARS) -> Column:
    """Collapsed text, shortened with an ellipsis to at most ``max_chars``."""
    flat = collapsed(col)
    return F.when(F.length(flat) > max_chars,
                  F.concat(F.substring(flat, 1, max_chars - 1), F.lit("…"))).otherwise(flat)


def slug(col: Column) -> Column:
    return F.btrim(F.regexp_replace(lowered(col), "[^a-z0-9]+", " "))


def plus_joined(col: Column) -> Column:
    return F.regexp_replace(trimmed(col), SPACE + "+", "+")


def as_count(col: Column) -> Column:
    """Numeric reading of a string option, fractions included; anything unreadable counts as 0.

    The same rule as config.number.
    """
    flat = trimmed(col)
    value = F.when(flat.rlike(f"^{NUMBER_PATTERN}$"), flat.try_cast("double"))
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(C.BEYOND))


# ---- vocabulary matching ---------------------------------------------------

def contains_any(col: Column, words: Sequence[str]) -> Column:
    """True when any word occurs anywhere in the lower-cased text."""
    low = lowered(col)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word.lower())
    return hit


def matches_any(col: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern matches the lower-cased text, in one regex pass.

    Where every pattern starts and ends with a word boundary, these are tested
    once around the whole alternation; the patterns' outer characters are then
    taken to be word characters.
    """
    edged = all(p.startswith(r"\b") and p.endswith(r"\b") for p in patterns)
    joined = "|".join(f"(?:{portable(p[2:-2] if edged else p)})" for p in patterns)
    return lowered(col).rlike(rf"(?<!\w)(?:{joined})(?!\w)" if edged else joined)


def first_match(cols: Sequence[Column], phrases: Sequence[str]) -> Column:
    """First phrase in list order found in any of the texts, else empty."""
    lows = [lowered(c) for c in cols]
    tests = []
    for phrase in phrases:
        found = F.lit(False)
        for low in lows:
            found = found | low.contains(phrase.lower())
        tests.append(F.when(found, F.lit(phrase)))
    return F.coalesce(*tests, F.lit(""))


def _true_terms(terms: Sequence[str], tests: Sequence[Column]) -> Column:
    """The terms whose test holds.

    Built without a lambda: the tests then stay in generated code, where the
    lower-cased text they share is worked out once.
    """
    found = [F.when(test, F.lit(term)).otherwise("") for term, test in zip(terms, tests)]
    return F.array_remove(F.array(*found), "")


def vocabulary_hits(col: Column, terms: Sequence[str]) -> Column:
    """Array of the terms found as whole words, in vocabulary order.

    The substring test comes first: it is cheap and settles most terms, so the
    regex only runs where the term occurs at all.
    """
    low = lowered(col)
    return _true_terms(terms, [low.contains(t) & low.rlike(whole_word(t)) for t in terms])


def substring_hits(col: Column, terms: Sequence[str]) -> Column:
    """Array of the terms found anywhere in the text, in vocabulary order."""
    low = lowered(col)
    return _true_terms(terms, [low.contains(t.lower()) for t in terms])


def occurrences(col: Column, word: str) -> Column:
    """How often a literal occurs in the lower-cased text, without overlaps."""
    low = lowered(col)
    gone = F.replace(low, F.lit(word.lower()), F.lit(""))
    return ((F.length(low) - F.length(gone)) / len(word)).cast("int")


# ---- contacts --------------------------------------------------------------

def emails(col: Column) -> Column:
    """Distinct addresses; texts without an at sign are not scanned."""
    found = F.regexp_extract_all(text(col), F.lit(EMAIL_SCAN), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(text(col).contains("@"), F.array_distinct(found)).otherwise(none)


def phones(col: Column) -> Column:
    """Indian mobile numbers, normalised; ten bare digits get the country code."""
    raw = F.regexp_extract_all(text(col), F.lit(PHONE_PATTERN), F.lit(0))
    none = F.array().cast("array<string>")

    def normal(match: Column) -> Column:
        digits = F.regexp_replace(match, r"[^\d+]", "")
        return F.when(F.length(digits) == 10, F.concat(F.lit("+91"), digits)).otherwise(digits)

    # every match holds five digits in a row, which is quick to look for
    return F.when(text(col).rlike(r"[6-9]\d{4}"),
                  F.array_distinct(F.transform(raw, normal))).otherwise(none)


def listed(array: Column, sep: str = "; ") -> Column:
    return F.concat_ws(sep, array)
