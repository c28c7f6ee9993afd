"""The board and web feeds as lazy DataFrames, and their merge, which writes its rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.functions import urls as U
from gleaner.operators.dedupe import greedy_keep, posting_keys, soft_dedupe, uniq_by
from gleaner.operators.enrich import only_new, with_descriptions, with_found
from gleaner.operators.shape import as_place, ordered_union, shape_board, shape_web, unify


def unique_cards(cards: DataFrame) -> DataFrame:
    c = F.col
    return uniq_by(cards, U.posting_key(c("jobUrl"), c("company"), c("position")))


def likely_cards(cards: DataFrame, config: Config = Config()) -> DataFrame:
    """Unique cards whose title and place pass the tests that need no description."""
    c = F.col
    return unique_cards(cards).filter(
        R.title_likely_match(c("position"), config.role_phrases, config.negative_words)
        & R.place_or_remote_quick(c("location"), c("position"), config.places))


def board_feed(cards: DataFrame, details: DataFrame, config: Config = Config(),
               seen: DataFrame | None = None) -> DataFrame:
    """Cards (with ``seq``) and descriptions by posting number to output rows.

    Cheap tests run before the join.  They already imply the place and role
    tests on the description, so only the experience test follows it; and rows
    unique by key stay so, which saves a second pass.
    """
    c = F.col
    picked = likely_cards(cards, config)
    described = with_descriptions(
        picked.withColumn("job_id", U.job_id(c("jobUrl"))), details)
    fit = described.filter(R.experience_allowed(
        F.concat(X.text(c("position")), F.lit(" "), c("description"))))
    if config.soft_dedupe:
        fit = soft_dedupe(fit, "company", "position")
    rows = shape_board(fit, config)
    if config.incremental and seen is not None:
        rows = only_new(rows, seen, "li_job_id")
    return rows


def accepted_hits(hits: DataFrame, config: Config = Config()) -> DataFrame:
    """Hits whose URL and text pass the rules; first per link among those."""
    c = F.col
    passed = hits.filter(
        (X.text(c("link")) != "")
        & ~R.is_blocked(c("link"), config.blocked_domains)
        & R.is_career_url(c("link"), config.career_sites, config.career_path)
        & R.tokens_ok(c("title"), c("snippet"), config.include_tokens, config.exclude_tokens))
    return uniq_by(passed, c("link"))


def web_feed(hits: DataFrame, found: DataFrame, config: Config = Config(),
             seen_today: DataFrame | None = None) -> DataFrame:
    """Hits (with ``seq``) and page data by URL to output rows.

    The rules look at the hit before enrichment, and only accepted links count
    as seen, so filtering comes before uniqueness.
    """
    rows = accepted_hits(hits, config)
    if seen_today is not None:
        rows = only_new(rows, seen_today, "link")
    return shape_web(with_found(rows, found))


def combined_feed(web: DataFrame, board: DataFrame) -> DataFrame:
    """Both feeds in the common schema; web rows come first."""
    return ordered_union(unify(web), unify(board))


def merged_feed(web: DataFrame, board: DataFrame) -> DataFrame:
    """The rows a scan of both feeds keeps.

    The dedupe reads the feeds for their keys alone.  They are read again for the rows that are
    kept, by their own ``seq``, so that a description is looked up, carried and trimmed for those only.
    """
    kept = greedy_keep(combined_feed(web, board), posting_keys())
    own = kept.schema["seq"].dataType["own"].dataType
    feeds = []
    for rank, feed in enumerate((web, board)):
        seq = F.col("seq") if feed.schema["seq"].dataType == own else as_place(feed, "seq")
        wanted = kept.filter(F.col("seq.rank") == rank).select(F.col("seq.own").alias("_own"))
        feeds.append(feed.join(wanted, seq.eqNullSafe(F.col("_own")), "left_semi"))
    return combined_feed(*feeds)
