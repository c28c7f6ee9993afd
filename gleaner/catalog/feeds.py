"""Whole feeds over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import registry as Q
from gleaner.catalog.postings import SHAPED_SQL, sorted_contacts
from gleaner.catalog.registry import query
from gleaner.catalog.views import CARDS_SQL, DETAILS_SQL, POSTINGS_SQL
from gleaner.catalog.views import bare_postings, cards, details, with_texts
from gleaner.catalog.webpages import HITS_SQL, LANDED_SQL, RULES_SQL, WEB_ROWS_SQL, found, hits
from gleaner.functions import text as X
from gleaner.functions import urls as U
from gleaner.operators.dedupe import greedy_dedupe, greedy_keep, posting_keys
from gleaner.operators.ledger import merge_counts
from gleaner.plans.feeds import board_feed, combined_feed, merged_feed, web_feed
from gleaner.session import materialize

_CARD_KEY = Q.sql_key('"jobUrl"', "company", "position")
_CARD_ID = Q.sql_job_id('c."jobUrl"')


_BOARD_SQL = f"""
{CARDS_SQL}, {DETAILS_SQL},
first_cards AS (
  SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY {_CARD_KEY} ORDER BY seq) = 1),
described AS (
  SELECT c.*, coalesce(d.description, '') AS description
  FROM first_cards c LEFT JOIN details d ON d.job_id = {_CARD_ID}
  WHERE {Q.sql_title_match('position')} AND {Q.sql_quick_place('location', 'position')}),
board AS (
  SELECT {SHAPED_SQL}, description FROM described
  WHERE {Q.sql_experience("position || ' ' || description")})"""


@query("board_feed", f"""
WITH {_BOARD_SQL}
SELECT * EXCLUDE (description), md5(description) AS description FROM board""")
def board(spark, folder):
    rows = board_feed(cards(spark, folder), details(spark, folder), Q.CONFIG)
    return sorted_contacts(rows).withColumn("description", F.md5("description"))


_WEB_SQL = f"""
{HITS_SQL}, {LANDED_SQL},
first_hit AS (
  SELECT * FROM hits WHERE {RULES_SQL}
  QUALIFY row_number() OVER (PARTITION BY link ORDER BY seq) = 1),
first_found AS (
  SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
web AS ({WEB_ROWS_SQL})"""


@query("web_feed", f"WITH {_WEB_SQL} SELECT * FROM web")
def web(spark, folder):
    return web_feed(hits(spark, folder), found(spark, folder), Q.CONFIG)


def _split_feeds(spark, folder):
    """The postings as a web feed (career sites) and a board feed (the rest)."""
    c, rows = F.col, bare_postings(spark, folder)
    ats = c("job_url").startswith("https://ats.")
    as_web = rows.filter(ats).select(
        "doc_slot", "seq", "company", "title", "location", c("date_posted").cast("string").alias("posted_at"), "job_url")
    as_board = rows.filter(~ats).select(
        "doc_slot", "seq", U.job_id(c("job_url")).alias("li_job_id"), "company", "title", "location",
        c("date_posted").cast("string").alias("date_posted"), "job_url")
    return with_texts(spark, folder, as_web, "snippet"), with_texts(spark, folder, as_board)


_BLANKS = ("matched_role", "is_remote", "ago_time", "salary", "contact_emails", "contact_phones",
           "skills")


_MERGE_SQL = f"""
{POSTINGS_SQL},
feed AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY job_url NOT LIKE 'https://ats.%', seq) AS seq, seq AS own_seq,
    CASE WHEN job_url LIKE 'https://ats.%' THEN 0 ELSE 1 END AS source_rank,
    coalesce({Q.sql_job_id('job_url')}, '') AS li_job_id, company, title, location,
    CAST(date_posted AS VARCHAR) AS date_posted, job_url, description FROM postings),
{Q.sql_walk('feed')}"""


@query("merged_feed", f"""
WITH RECURSIVE {_MERGE_SQL}
SELECT * EXCLUDE (description, seq, own_seq), own_seq AS seq, md5({Q.sql_trim('description')}) AS description,
  {", ".join(f"'' AS {b}" for b in _BLANKS)}
FROM feed WHERE seq IN (SELECT seq FROM kept)""")
def merged(spark, folder):
    rows = merged_feed(*_split_feeds(spark, folder))
    return rows.withColumn("description", F.md5("description")).withColumn("seq", F.col("seq.own"))


@query("merge_funnel", f"""
WITH RECURSIVE {_MERGE_SQL}
SELECT count(*) FILTER (source_rank = 0) AS web, count(*) FILTER (source_rank = 1) AS board,
  count(*) AS combined, (SELECT count(*) FROM kept) AS kept FROM feed""")
def merge_funnel(spark, folder):
    # the counts and the dedupe need no texts, so none are carried through the merge
    combined = combined_feed(*_split_feeds(spark, folder)).select(
        "seq", "source_rank", "li_job_id", "job_url", "company", "title")
    return merge_counts(combined, lambda rows: greedy_keep(rows, posting_keys()), {"web": 0, "board": 1})


@query("full_feed", f"""
WITH RECURSIVE {_BOARD_SQL}, {_WEB_SQL},
both_feeds AS MATERIALIZED (
  SELECT * REPLACE (row_number() OVER (ORDER BY source_rank, seq) AS seq), seq AS own_seq FROM (
    SELECT 0 AS source_rank, seq, '' AS li_job_id, company, title, '' AS matched_role, job_url, description FROM web
    UNION ALL
    SELECT 1, seq, li_job_id, company, title, matched_role, job_url, description FROM board)),
{Q.sql_walk('both_feeds')}
SELECT source_rank, own_seq AS seq, {Q.sql_trim('li_job_id')} AS li_job_id, {Q.sql_trim('company')} AS company,
  {Q.sql_trim('title')} AS title, matched_role, {Q.sql_trim('job_url')} AS job_url,
  md5({Q.sql_trim('description')}) AS description_md5
FROM both_feeds WHERE seq IN (SELECT seq FROM kept)""")
def full(spark, folder):
    """Board and web feeds of the given tables, merged."""
    both = combined_feed(web(spark, folder),
                         board_feed(cards(spark, folder), details(spark, folder), Q.CONFIG))
    rows = greedy_dedupe(materialize(both))
    return rows.select("source_rank", F.col("seq.own").alias("seq"), "li_job_id", "company", "title", "matched_role",
                       "job_url", F.md5(X.text(F.col("description"))).alias("description_md5"))
