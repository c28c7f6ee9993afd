"""Row shaping: one common schema for differing feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import config as C
from gleaner import schema as S
from gleaner.config import Config
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.functions import urls as U

def unify(df: DataFrame, aliases: Mapping[str, Sequence[str]] = S.COLUMN_ALIASES,
          keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Fixed columns, each from the first alias with a non-blank value."""
    present = set(df.columns)
    columns = [
        X.first_non_blank(*[X.trimmed(F.col(a)) for a in names if a in present]).alias(target)
        for target, names in aliases.items()
    ]
    return df.select(*[c for c in keep if c in present], *columns)


def shape_board(cards: DataFrame, config: Config = Config()) -> DataFrame:
    """Output row of the board feed from a card with its description."""
    c = F.col
    url = U.without_query(c("jobUrl"))
    description = X.text(c("description"))
    return cards.select(
        "seq",
        F.coalesce(U.job_id(c("jobUrl")), url).alias("li_job_id"),
        X.text(c("company")).alias("company"),
        X.text(c("position")).alias("title"),
        X.first_match([c("position"), description], config.role_phrases).alias("matched_role"),
        X.text(c("location")).alias("location"),
        R.remote_label(c("location"), description).alias("is_remote"),
        X.text(c("date")).alias("date_posted"),
        X.text(c("agoTime")).alias("ago_time"),
        X.text(c("salary")).alias("salary"),
        url.alias("job_url"),
        X.listed(X.emails(description)).alias("contact_emails"),
        X.listed(X.phones(description)).alias("contact_phones"),
        X.listed(X.vocabulary_hits(description, config.skills)).alias("skills"),
        description.alias("description"),
    )


def shape_web(hits: DataFrame, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Output row of the web feed from a hit with its (nullable) ``found`` struct.

    The title stays the hit's own, even where the page states another.
    """
    c = F.col
    company = X.first_non_blank(c("found.company"), U.without_www(c("displayLink")))
    return hits.select(
        *keep,
        F.lit(C.WEB_SOURCE).alias("source"),
        U.posting_token(c("title"), company, c("link")).alias("g_job_id"),
        company.alias("company"),
        X.text(c("title")).alias("title"),
        X.text(c("found.location")).alias("location"),
        X.text(c("found.posted_at")).alias("posted_at"),
        X.text(c("displayLink")).alias("via"),
        c("link").alias("job_url"),
        X.cleaned(X.first_non_blank(c("found.description"), X.text(c("snippet"))))
        .alias("description"),
    )


def as_place(df: DataFrame, seq: str) -> Column:
    """A feed's order as a place (file, start, pos, item), whatever type it has."""
    kind = df.schema[seq].dataType
    if kind == S.PLACE:
        return F.col(seq)
    nought = F.lit(0).cast("long")
    if isinstance(kind, T.StringType):
        return F.struct(F.col(seq).alias("file"), nought.alias("start"), nought.alias("pos"), nought.alias("item"))
    return F.struct(F.lit("").alias("file"), nought.alias("start"), F.col(seq).cast("long").alias("pos"),
                    nought.alias("item"))


def ordered_union(*feeds: DataFrame, seq: str = "seq") -> DataFrame:
    """All rows, earlier feeds first; ``seq`` becomes the pair (rank of the feed, the feed's own seq).

    Feeds whose seqs differ in type are ordered by place.
    """
    same = len({str(feed.schema[seq].dataType) for feed in feeds}) == 1
    parts = [
        feed.withColumn("source_rank", F.lit(rank)).withColumn(seq, F.struct(
            F.lit(rank).alias("rank"), (F.col(seq) if same else as_place(feed, seq)).alias("own")))
        for rank, feed in enumerate(feeds)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
