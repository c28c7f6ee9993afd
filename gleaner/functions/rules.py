"""Row predicates.  Each takes its vocabulary; the defaults are in config."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import config as C
from gleaner.functions import text as X
from gleaner.functions import urls as U

HOME = X.portable(C.HOME_PATTERN)


def has_negative_word(title: Column, words: Sequence[str] = C.NEGATIVE_TITLE_WORDS) -> Column:
    return X.contains_any(title, words)


def title_likely_match(title: Column, phrases: Sequence[str] = C.BOARD_TITLES,
                       negatives: Sequence[str] = C.NEGATIVE_TITLE_WORDS) -> Column:
    return ~X.contains_any(title, negatives) & X.contains_any(title, phrases)


def role_matches(title: Column, description: Column, phrases: Sequence[str] = C.BOARD_TITLES,
                 negatives: Sequence[str] = C.NEGATIVE_TITLE_WORDS) -> Column:
    """Phrase in title or description; negative words count in the title only."""
    return ~X.contains_any(title, negatives) & (
        X.contains_any(title, phrases) | X.contains_any(description, phrases))


def says_remote(col: Column) -> Column:
    """Any wording of remote work; the regex only runs on texts with "work"."""
    return X.contains_any(col, C.REMOTE_WORDS) | (
        X.contains_any(col, ("work",)) & X.lowered(col).rlike(HOME))


def place_or_remote_quick(location: Column, title: Column,
                          places: Sequence[str] = ("india",)) -> Column:
    return X.contains_any(location, (*places, "remote")) | X.contains_any(title, ("remote",))


def place_or_remote(location: Column, title: Column, description: Column,
                    places: Sequence[str] = ("india",)) -> Column:
    return place_or_remote_quick(location, title, places) | says_remote(description)


def experience_allowed(words: Column,
                       patterns: Sequence[str] = C.EXPERIENCE_REJECT_PATTERNS) -> Column:
    """No rejecting pattern matches; text that states no years is allowed.

    Every default pattern needs a unit of years, which a substring test rules
    out for most texts before any regex runs.
    """
    rejected = X.matches_any(words, patterns)
    if patterns is C.EXPERIENCE_REJECT_PATTERNS:
        rejected = X.contains_any(words, C.YEAR_UNITS) & rejected
    return ~rejected


def is_blocked(url: Column, domains: Sequence[str] = C.BLOCKED_DOMAINS) -> Column:
    return X.contains_any(U.host(url), domains)


def is_career_url(url: Column, sites: Sequence[str] = C.CAREER_SITES,
                  path: str = C.CAREER_PATH_PATTERN) -> Column:
    known = [s.removeprefix("site:") for s in sites]
    return X.contains_any(url, known) | X.text(url).rlike(f"(?i){path}")


def tokens_ok(title: Column, body: Column, include: Sequence[str] = C.INCLUDE_TOKENS,
              exclude: Sequence[str] = C.EXCLUDE_TOKENS) -> Column:
    wanted = X.contains_any(title, include) | X.contains_any(body, include)
    unwanted = X.contains_any(title, exclude) | X.contains_any(body, exclude)
    return wanted & ~unwanted


def remote_label(location: Column, description: Column) -> Column:
    """Yes/No from location and description; the title is not looked at."""
    hit = says_remote(location) | says_remote(description)
    return F.when(hit, F.lit("Yes")).otherwise(F.lit("No"))
