"""Search over a postings table: criteria codes, filters, order, pages, grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import config as C
from gleaner.config import Config, Criteria
from gleaner.functions import text as X
from gleaner.operators.skew import first_per_group
from gleaner.session import Steps
from gleaner.sources.state import Snapshots

ANY = "any"
TOP_ROWS = 100_000  # up to so many ranks a task keeps its own first rows


def _code(col: Column, table: Mapping[str, str], fold_case: bool = True) -> Column:
    pairs = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    name = X.lowered(col) if fold_case else X.text(col)
    return F.coalesce(F.try_element_at(pairs, name), F.lit(""))


def encode_criteria(options: DataFrame) -> DataFrame:
    """Codes of the option words; an unknown word gives the empty code."""
    c = F.col
    return options.withColumns({
        "date_code": _code(c("date_since_posted"), C.DATE_WINDOW_CODES),
        "experience_code": _code(c("experience_level"), C.EXPERIENCE_CODES),
        "job_type_code": _code(c("job_type"), C.JOB_TYPE_CODES),
        "remote_code": _code(c("remote_filter"), C.REMOTE_CODES),
        "salary_code": _code(c("salary"), C.SALARY_CODES, fold_case=False),
        "sort_code": _code(c("sort_by"), C.SORT_CODES, fold_case=False),
        "verified_code": F.when(c("has_verification"), "true").otherwise("false"),
        "few_applicants_code": F.when(c("under_10_applicants"), "true").otherwise("false"),
        "keyword_code": X.plus_joined(c("keyword")),
        "location_code": X.plus_joined(c("location")),
        "start": F.floor(F.least(X.as_count(c("page")) * C.BOARD_PAGE_ROWS, F.lit(C.BEYOND))),
        "row_limit": F.floor(X.as_count(c("limit"))),
    })


SNAPSHOT_PARTS = (
    "keyword_code", "location_code", "date_code", "salary_code", "experience_code", "remote_code",
    "job_type_code", "verified_code", "few_applicants_code", "start", "sort_code", "row_limit",
)


def snapshot_key(parts: Sequence[str] = SNAPSHOT_PARTS) -> Column:
    """Name under which a result is kept: all codes, the offset and the limit."""
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def matching(postings: DataFrame, criteria: Criteria, as_of: Column) -> DataFrame:
    """Rows that satisfy every option that is set."""
    c, out = F.col, postings
    if criteria.keyword:
        word = (criteria.keyword.strip(),)
        out = out.filter(X.contains_any(c("title"), word) | X.contains_any(c("description"), word))
    if criteria.location:
        out = out.filter(X.contains_any(c("location"), (criteria.location.strip(),)))
    if criteria.window_seconds is not None:
        oldest = as_of.cast("timestamp_ntz") - F.make_dt_interval(
            secs=F.lit(criteria.window_seconds))
        out = out.filter(c("date_posted").cast("timestamp_ntz") >= oldest)
    if criteria.job_type_code:
        out = out.filter(c("job_type") == criteria.job_type_code)
    if criteria.remote_code:
        out = out.filter(c("remote_code") == criteria.remote_code)
    if criteria.salary_floor is not None:
        out = out.filter(c("salary") >= criteria.salary_floor)
    if criteria.experience_code:
        out = out.filter(c("experience") == criteria.experience_code)
    if criteria.has_verification:
        out = out.filter(c("verified"))
    if criteria.under_10_applicants:
        out = out.filter(c("applicants") < 10)
    return out


def _sorting(postings: DataFrame, mode: str, keyword: str = "") -> tuple[DataFrame, list[Column]]:
    """The rows, if need be with a column ``_hits``, and the columns they are sorted by."""
    if mode == "recent":
        return postings, [F.desc("date_posted"), F.col("seq").asc()]
    if mode == "relevant" and keyword:
        hits = X.occurrences(F.col("title"), keyword) + X.occurrences(F.col("description"), keyword)
        # a column of its own, or the sort would work it out at every comparison
        return postings.withColumn("_hits", hits), [F.desc("_hits"), F.col("seq").asc()]
    return postings, [F.col("seq").asc()]


def sort_postings(postings: DataFrame, mode: str, keyword: str = "") -> DataFrame:
    """``recent`` newest first; ``relevant`` most keyword hits first; else in order."""
    rows, order = _sorting(postings, mode, keyword)
    return rows.orderBy(*order).drop("_hits")


def page(ordered: DataFrame, number: int, size: int = C.BOARD_PAGE_ROWS) -> DataFrame:
    """One page of an ordered result."""
    return ordered.offset(number * size).limit(size)


def limit_n(ordered: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows; 0 means all."""
    return ordered.limit(n) if n else ordered


def ranks(rows: DataFrame, order: Sequence[Column], offset: int, limit: int = 0) -> DataFrame:
    """The rows from rank ``offset`` on (the first has 0), at most ``limit`` where it isn't 0, in order.

    ``order`` tells any two rows apart.  Up to TOP_ROWS rows are kept task by task, as Spark does for a limit.  A place further
    back is found by rank: the rows are dealt to ranges of the order, cut by Spark's sample, and written; the
    ranges are counted, and only those that hold wanted ranks are sorted, each by itself.  Numbers may be of any size.
    """
    if 0 < offset + limit <= TOP_ROWS and limit:
        return rows.orderBy(*order).offset(offset).limit(limit)
    if not offset and not limit:
        return rows.orderBy(*order)
    steps = Steps(rows.sparkSession, "ranks")
    dealt = steps.keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    start, wanted = 0, []  # ranges with the ranks before them
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        if start + r["count"] > offset and (not limit or start < offset + limit):
            wanted.append((r["_range"], max(0, offset - start), min(r["count"], offset + limit - start) if limit else r["count"]))
        start += r["count"]
    if not wanted:
        return rows.limit(0)
    (low, skipped, _), (high, _, last) = wanted[0], wanted[-1]
    inside = dealt.filter(F.col("_range").between(low, high)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    kept = inside.filter(((F.col("_range") > low) | (F.col("_rank") > skipped)) & ((F.col("_range") < high) | (F.col("_rank") <= last)))
    return kept.orderBy(*order).drop("_range", "_rank")


def search_postings(postings: DataFrame, criteria: Criteria, as_of: Column) -> DataFrame:
    """One page of the matches, or all from the page's start on where no limit is set."""
    rows, order = _sorting(matching(postings, criteria, as_of), criteria.sort_by, criteria.keyword.strip())
    return ranks(rows, order, criteria.row_offset, criteria.row_limit).drop("_hits")


def search_stored(store: Snapshots, postings: DataFrame, criteria: Criteria, now: datetime,
                  as_of: Column) -> DataFrame:
    """A stored result that is still good, else a search whose result is stored unless it is empty."""
    stored = store.get(criteria.snapshot_key, now)
    if stored is None and store.put(criteria.snapshot_key, search_postings(postings, criteria, as_of), now):
        stored = store.get(criteria.snapshot_key, now)
    return postings.limit(0) if stored is None else stored


def top_per_group(postings: DataFrame, group: Column, pages: int = 2,
                  page_rows: int = C.WEB_PAGE_ROWS) -> DataFrame:
    """The first pages of every group, newest first."""
    return first_per_group(postings, [group], [F.desc("date_posted"), F.col("seq")],
                           pages * page_rows, spread=F.col("seq"))


def criteria_grid(titles: DataFrame, title: str, experiences: Sequence[str]) -> DataFrame:
    """Every title with every level (and any level), for all and for remote only."""
    return (
        titles.select(F.col(title).alias("title"))
        .withColumn("experience", F.explode(F.array(*[F.lit(e) for e in (*experiences, ANY)])))
        .withColumn("remote_only", F.explode(F.array(F.lit(0), F.lit(1))))
    )


def page_grid(roles: DataFrame, role: str, pages: int = 2,
              page_rows: int = C.WEB_PAGE_ROWS) -> DataFrame:
    """Every role with the first row number of each of its result pages."""
    starts = F.array(*[F.lit(1 + i * page_rows) for i in range(pages)])
    return roles.select(F.col(role).alias("role"), F.explode(starts).alias("start"))


def tag_by_criteria(postings: DataFrame, config: Config = Config()) -> DataFrame:
    """(seq, title, experience, remote_only) of every grid cell a posting satisfies.

    The cell is worked out from the row itself, so there is no join: which
    titles occur, which level it has, and whether it is remote.
    """
    c = F.col
    levels = F.array(F.lit(ANY), *[
        F.when(c("experience") == C.EXPERIENCE_CODES[e], F.lit(e)) for e in config.experiences])
    remote = c("remote_code") == C.REMOTE_CODES["remote"]
    return (
        postings.select(
            "seq", F.array_compact(levels).alias("_levels"), remote.alias("_remote"),
            F.explode(X.substring_hits(c("title"), config.role_phrases)).alias("title"))
        .select("seq", "title", "_remote", F.explode("_levels").alias("experience"))
        .select("seq", "title", "experience", F.explode(
            F.when(c("_remote"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ).alias("remote_only"))
    )


def rows_per_criteria(tagged: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows per grid cell, cells without rows included."""
    cell = ["title", "experience", "remote_only"]
    counts = tagged.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    return grid.join(counts, cell, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
