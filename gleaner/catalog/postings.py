"""Operators over the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import registry as Q
from gleaner.catalog.registry import query, table
from gleaner.catalog.views import CARDS_SQL, DETAILS_SQL, POSTINGS_SQL
from gleaner.catalog.views import details, postings, unique_postings
from gleaner.config import Criteria
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.functions import urls as U
from gleaner.operators import search as S
from gleaner.operators.dedupe import greedy_dedupe, soft_dedupe, uniq_by
from gleaner.operators.enrich import advance_seen, only_new, with_descriptions
from gleaner.operators.ledger import funnel
from gleaner.operators.shape import ordered_union, shape_board, unify
from gleaner.session import scratch_path
from gleaner.sources.seen_keys import SeenKeys

_KEY = Q.sql_key("job_url", "company", "title")
_JOB_ID = Q.sql_job_id("job_url")
C = F.col


def _with(body: str) -> str:
    return f"WITH {POSTINGS_SQL} {body}"


# ---- expressions ---------------------------------------------------------------

@query("job_id", _with(f"SELECT seq, {_JOB_ID} AS job_id FROM postings"))
def job_id(spark, folder):
    return postings(spark, folder).select("seq", U.job_id(C("job_url")).alias("job_id"))


@query("posting_key", _with(f"SELECT seq, {_KEY} AS posting_key FROM postings"))
def posting_key(spark, folder):
    return postings(spark, folder).select(
        "seq", U.posting_key(C("job_url"), C("company"), C("title")).alias("posting_key"))


@query("posting_token", _with("""
SELECT seq, to_base64(encode(CAST(json_object(
  'job_title', title, 'company_name', company, 'url', job_url) AS VARCHAR))) AS token
FROM postings"""))
def posting_token(spark, folder):
    return postings(spark, folder).select(
        "seq", U.posting_token(C("title"), C("company"), C("job_url")).alias("token"))


@query("matched_role", _with(f"""
SELECT seq, {Q.sql_first(['title', 'description'], Q.ROLE_PHRASES)} AS matched_role
FROM postings"""))
def matched_role(spark, folder):
    role = X.first_match([C("title"), C("description")], Q.ROLE_PHRASES)
    return postings(spark, folder).select("seq", role.alias("matched_role"))


_REMOTE_SQL = (f"CASE WHEN regexp_matches(location, '(?i){Q.REMOTE_SQL}') "
               f"OR regexp_matches(description, '(?i){Q.REMOTE_SQL}') THEN 'Yes' ELSE 'No' END")


@query("is_remote", _with(f"SELECT seq, {_REMOTE_SQL} AS is_remote FROM postings"))
def is_remote(spark, folder):
    return postings(spark, folder).select(
        "seq", R.remote_label(C("location"), C("description")).alias("is_remote"))


# ---- predicates ----------------------------------------------------------------

@query("negative_title", _with(
    f"SELECT seq, title FROM postings WHERE {Q.sql_any('title', Q.NEGATIVES)}"))
def negative_title(spark, folder):
    return postings(spark, folder).filter(
        R.has_negative_word(C("title"), Q.NEGATIVES)).select("seq", "title")


@query("title_match", _with(
    f"SELECT seq, title FROM postings WHERE {Q.sql_title_match('title')}"))
def title_match(spark, folder):
    return postings(spark, folder).filter(
        R.title_likely_match(C("title"), Q.ROLE_PHRASES, Q.NEGATIVES)).select("seq", "title")


@query("role_match", _with(f"""
SELECT seq, title FROM postings WHERE NOT {Q.sql_any('title', Q.NEGATIVES)}
  AND ({Q.sql_any('title', Q.ROLE_PHRASES)} OR {Q.sql_any('description', Q.ROLE_PHRASES)})"""))
def role_match(spark, folder):
    keep = R.role_matches(C("title"), C("description"), Q.ROLE_PHRASES, Q.NEGATIVES)
    return postings(spark, folder).filter(keep).select("seq", "title")


@query("place_quick", _with(
    f"SELECT seq, location FROM postings WHERE {Q.sql_quick_place('location', 'title')}"))
def place_quick(spark, folder):
    return postings(spark, folder).filter(
        R.place_or_remote_quick(C("location"), C("title"), Q.PLACES)).select("seq", "location")


@query("place_full", _with(f"""
SELECT seq, location FROM postings WHERE {Q.sql_quick_place('location', 'title')}
  OR regexp_matches(lower(description), '{Q.REMOTE_SQL}')"""))
def place_full(spark, folder):
    return postings(spark, folder).filter(
        R.place_or_remote(C("location"), C("title"), C("description"), Q.PLACES)
    ).select("seq", "location")


# the same text in both engines: a demand for years in one of nine spellings
_DEMAND = """concat(title, ' ', CASE seq % 9
  WHEN 0 THEN concat(CAST(seq % 23 AS VARCHAR(9)), ' years')
  WHEN 1 THEN concat(CAST(seq % 23 AS VARCHAR(9)), '+ yrs of work')
  WHEN 2 THEN concat('min ', CAST(seq % 23 AS VARCHAR(9)), ' years')
  WHEN 3 THEN concat(CAST(seq % 23 AS VARCHAR(9)), '-', CAST(seq % 29 AS VARCHAR(9)), ' years')
  WHEN 4 THEN concat('1 to ', CAST(seq % 23 AS VARCHAR(9)), ' yr')
  WHEN 5 THEN concat('Experience: ', CAST(seq % 23 AS VARCHAR(9)), ' yrs')
  WHEN 6 THEN concat('1-', CAST(seq % 23 AS VARCHAR(9)), 'years')
  WHEN 7 THEN concat(CAST(seq % 4 AS VARCHAR(9)), ' or more years')
  ELSE concat('fresher, ', CAST(seq % 23 AS VARCHAR(9)), ' months') END, ' ', description)"""


@query("experience_ok", _with(f"""
SELECT seq FROM (SELECT seq, {_DEMAND} AS words FROM postings) WHERE {Q.sql_experience('words')}"""))
def experience_ok(spark, folder):
    worded = postings(spark, folder).select("seq", F.expr(_DEMAND).alias("words"))
    return worded.filter(R.experience_allowed(C("words"))).select("seq")


# ---- search --------------------------------------------------------------------

_OPTIONS = """
  SELECT seq, CASE seq % 4 WHEN 0 THEN 'past Week' WHEN 1 THEN 'PAST MONTH' WHEN 2 THEN '24hr'
           ELSE 'yesterday' END AS date_since_posted,
    CASE experience WHEN '1' THEN 'Internship' WHEN '2' THEN 'entry level' WHEN '3' THEN 'Associate'
      WHEN '4' THEN 'SENIOR' ELSE 'guru' END AS experience_level,
    CASE job_type WHEN 'F' THEN 'Full-Time' WHEN 'P' THEN 'part time' ELSE 'Other' END AS job_type,
    CASE remote_code WHEN '2' THEN 'Remote' WHEN '3' THEN 'hybrid' ELSE 'On-Site' END AS remote_filter,
    CASE WHEN salary < 100000 THEN '60000' WHEN salary < 200000 THEN '100000' ELSE '99' END AS salary,
    CASE WHEN verified THEN 'recent' ELSE 'Recent' END AS sort_by,
    verified AS has_verification, applicants < 10 AS under_10_applicants,
    concat('  ', title, ' ') AS keyword, location,
    CASE WHEN seq % 3 = 0 THEN 'x' WHEN seq % 13 = 0 THEN '1e2' WHEN seq % 17 = 0 THEN ' 2.5 ' ELSE CAST(seq % 7 AS VARCHAR(9)) END AS page,
    CASE WHEN seq % 5 = 0 THEN '' ELSE CAST(seq % 11 AS VARCHAR(9)) END AS "limit"
  FROM postings"""


@query("criteria_codes", f"""
WITH {POSTINGS_SQL}, options AS ({_OPTIONS}),
coded AS (SELECT seq,
  CASE lower(date_since_posted) WHEN 'past month' THEN 'r2592000' WHEN 'past week' THEN 'r604800'
    WHEN '24hr' THEN 'r86400' ELSE '' END AS date_code,
  CASE lower(experience_level) WHEN 'internship' THEN '1' WHEN 'entry level' THEN '2'
    WHEN 'associate' THEN '3' WHEN 'senior' THEN '4' WHEN 'director' THEN '5'
    WHEN 'executive' THEN '6' ELSE '' END AS experience_code,
  CASE lower(job_type) WHEN 'full time' THEN 'F' WHEN 'full-time' THEN 'F' WHEN 'part time' THEN 'P'
    WHEN 'part-time' THEN 'P' WHEN 'contract' THEN 'C' ELSE '' END AS job_type_code,
  CASE lower(remote_filter) WHEN 'on-site' THEN '1' WHEN 'on site' THEN '1' WHEN 'remote' THEN '2'
    WHEN 'hybrid' THEN '3' ELSE '' END AS remote_code,
  CASE salary WHEN '40000' THEN '1' WHEN '60000' THEN '2' WHEN '80000' THEN '3'
    WHEN '100000' THEN '4' WHEN '120000' THEN '5' ELSE '' END AS salary_code,
  CASE sort_by WHEN 'recent' THEN 'DD' WHEN 'relevant' THEN 'R' ELSE '' END AS sort_code,
  CASE WHEN has_verification THEN 'true' ELSE 'false' END AS verified_code,
  CASE WHEN under_10_applicants THEN 'true' ELSE 'false' END AS few_applicants_code,
  regexp_replace(trim(keyword), ' +', '+', 'g') AS keyword_code,
  regexp_replace(trim(location), ' +', '+', 'g') AS location_code,
  CAST(floor(coalesce(TRY_CAST(page AS DOUBLE), 0) * 25) AS BIGINT) AS start,
  CAST(floor(coalesce(TRY_CAST("limit" AS DOUBLE), 0)) AS BIGINT) AS row_limit
FROM options)
SELECT *, concat_ws('|', keyword_code, location_code, date_code, salary_code, experience_code,
  remote_code, job_type_code, verified_code, few_applicants_code, start, sort_code, row_limit)
  AS snapshot_key FROM coded""")
def criteria_codes(spark, folder):
    options = spark.sql(_OPTIONS.replace('"limit"', "`limit`").replace(
        "FROM postings", "FROM {postings}"), postings=postings(spark, folder))
    coded = S.encode_criteria(options)
    return coded.select("seq", *[c for c in coded.columns if c.endswith("_code")],
                        "start", "row_limit", S.snapshot_key().alias("snapshot_key"))


def _as_of(spark, folder):
    return table(spark, folder, "orders").select(F.max("o_orderdate")).scalar()


_WANTED = Criteria(keyword="ring", location="Nation_1", date_since_posted="Past Month",
                   job_type="full time", salary="100000", has_verification=True)
_WANTED_SQL = """
  FROM postings WHERE (contains(lower(title), 'ring') OR contains(lower(description), 'ring'))
  AND contains(lower(location), 'nation_1')
  AND date_posted >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 2592000 SECOND
  AND job_type = 'F' AND salary >= 100000 AND verified"""


@query("search_postings", _with(f"SELECT seq, title, salary {_WANTED_SQL}"))
def search_postings(spark, folder):
    found = S.search_postings(postings(spark, folder), _WANTED, _as_of(spark, folder))
    return found.select("seq", "title", "salary")


_PAGED = Criteria(keyword="gear", remote_filter="Remote", experience_level="entry level",
                  under_10_applicants=True, sort_by="recent", limit="40", page="1")


@query("search_page", _with("""
SELECT seq, title FROM postings
WHERE (contains(lower(title), 'gear') OR contains(lower(description), 'gear'))
  AND remote_code = '2' AND experience = '2' AND applicants < 10
ORDER BY date_posted DESC, seq LIMIT 40 OFFSET 25"""))
def search_page(spark, folder):
    found = S.search_postings(postings(spark, folder), _PAGED, _as_of(spark, folder))
    return found.select("seq", "title")


@query("page_2", _with("SELECT seq, title FROM postings ORDER BY seq LIMIT 25 OFFSET 50"))
def page_2(spark, folder):
    return S.page(postings(spark, folder).select("seq", "title").orderBy("seq"), 2)


@query("deep_page", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 25 OFFSET 50000""")
def deep_page(spark, folder):
    """Page 2,000 of the order lines, the dearest first."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    order = [F.desc("l_extendedprice"), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]]
    return S.ranks(lines, order, 2_000 * 25, 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("sort_recent", _with(
    "SELECT seq, CAST(date_posted AS VARCHAR) AS date_posted FROM postings "
    "ORDER BY date_posted DESC, seq"))
def sort_recent(spark, folder):
    ordered = S.sort_postings(postings(spark, folder).select("seq", "date_posted"), "recent")
    return ordered.withColumn("date_posted", C("date_posted").cast("string"))


def _hits_sql(column: str) -> str:
    return f"CAST((length(lower({column})) - length(replace(lower({column}), 'ring', ''))) / 4 AS INTEGER)"


@query("most_relevant", _with(f"""
SELECT seq, {_hits_sql('title')} + {_hits_sql('description')} AS hits FROM postings
ORDER BY hits DESC, seq LIMIT 100"""))
def most_relevant(spark, folder):
    ordered = S.sort_postings(postings(spark, folder), "relevant", "ring")
    hits = X.occurrences(C("title"), "ring") + X.occurrences(C("description"), "ring")
    return S.limit_n(ordered, 100).select("seq", hits.alias("hits"))


@query("top_per_role", _with(f"""
SELECT seq, matched_role FROM (
  SELECT *, {Q.sql_first(['title'], Q.ROLE_PHRASES)} AS matched_role FROM postings)
QUALIFY row_number() OVER (PARTITION BY matched_role ORDER BY date_posted DESC, seq) <= 20"""))
def top_per_role(spark, folder):
    roles = postings(spark, folder).select(
        "seq", "date_posted", X.first_match([C("title")], Q.ROLE_PHRASES).alias("matched_role"))
    return S.top_per_group(roles, C("matched_role")).select("seq", "matched_role")


_LEVELS_SQL = "(VALUES ('internship', '1'), ('entry level', '2'), ('associate', '3'), ('any', NULL))"
_GRID_SQL = f"""
grid AS (
  SELECT t.title, l.experience, l.code, r.remote_only
  FROM titles t, {_LEVELS_SQL} l(experience, code), (VALUES (0), (1)) r(remote_only))"""


@query("criteria_grid", f"""
WITH titles AS (SELECT DISTINCT p_name AS title FROM part), {_GRID_SQL}
SELECT title, experience, remote_only FROM grid""")
def criteria_grid(spark, folder):
    titles = table(spark, folder, "part").select("p_name").distinct()
    return S.criteria_grid(titles, "p_name", Q.CONFIG.experiences)


@query("page_grid", """
SELECT p_name AS role, start FROM (SELECT DISTINCT p_name FROM part), (VALUES (1), (11)) v(start)""")
def page_grid(spark, folder):
    roles = table(spark, folder, "part").select("p_name").distinct()
    return S.page_grid(roles, "p_name", Q.CONFIG.pages_per_role)


_PHRASE_ROWS = ", ".join(f"({Q.quoted(p)})" for p in Q.ROLE_PHRASES)
_TAGGED_SQL = f"""
WITH {POSTINGS_SQL}, titles(title) AS (VALUES {_PHRASE_ROWS}), {_GRID_SQL},
tagged AS (
  SELECT p.seq, g.title, g.experience, g.remote_only FROM postings p JOIN grid g
  ON contains(lower(p.title), g.title) AND (g.code IS NULL OR g.code = p.experience)
  AND (g.remote_only = 0 OR p.remote_code = '2'))"""


@query("criteria_hits", f"{_TAGGED_SQL} SELECT seq, title, experience, remote_only FROM tagged")
def criteria_hits(spark, folder):
    return S.tag_by_criteria(postings(spark, folder), Q.CONFIG)


@query("rows_per_criteria", f"""{_TAGGED_SQL}
SELECT g.title, g.experience, g.remote_only, count(t.seq) AS rows FROM grid g
LEFT JOIN tagged t USING (title, experience, remote_only) GROUP BY ALL""")
def rows_per_criteria(spark, folder):
    titles = spark.createDataFrame([(p,) for p in Q.ROLE_PHRASES], "title string")
    grid = S.criteria_grid(titles, "title", Q.CONFIG.experiences)
    return S.rows_per_criteria(S.tag_by_criteria(postings(spark, folder), Q.CONFIG), grid)


# ---- dedupe and membership -------------------------------------------------------

UNIQUE_SQL = f"""
first_postings AS (
  SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) = 1)"""


@query("uniq_first", f"WITH {POSTINGS_SQL}, {UNIQUE_SQL} SELECT seq, title, company FROM first_postings")
def uniq_first(spark, folder):
    return unique_postings(spark, folder).select("seq", "title", "company")


@query("soft_dedupe", _with(f"""
SELECT seq, company, title FROM postings QUALIFY row_number() OVER (
  PARTITION BY {Q.sql_slug('company')} || '|' || {Q.sql_slug('title')} ORDER BY seq) = 1"""))
def soft(spark, folder):
    rows = postings(spark, folder).select("seq", "company", "title")
    return soft_dedupe(rows)


def feed_rows(spark, folder):
    """Postings as unified rows with a posting number."""
    return unify(postings(spark, folder).withColumn("li_job_id", U.job_id(C("job_url"))))


_FEED_SQL = f"feed AS MATERIALIZED (SELECT *, {_JOB_ID} AS li_job_id FROM postings)"


@query("greedy_dedupe", f"""
WITH RECURSIVE {POSTINGS_SQL}, {_FEED_SQL}, {Q.sql_walk('feed')}
SELECT seq, coalesce(li_job_id, '') AS li_job_id, company, title
FROM feed WHERE seq IN (SELECT seq FROM kept)""")
def greedy(spark, folder):
    kept = greedy_dedupe(feed_rows(spark, folder))
    return kept.select("seq", "li_job_id", "company", "title")


_NEW_SQL = f"""
seen AS (SELECT DISTINCT {_JOB_ID} AS key FROM postings
  WHERE date_posted < DATE '{Q.SEEN_BEFORE}' AND {_JOB_ID} IS NOT NULL),
later AS (
  SELECT * FROM postings WHERE date_posted >= DATE '{Q.SEEN_BEFORE}'
  QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) = 1)"""


def _seen(spark, folder):
    earlier = postings(spark, folder).filter(C("date_posted") < F.lit(Q.SEEN_BEFORE).cast("date"))
    key = U.job_id(C("job_url"))
    return earlier.filter(key.isNotNull()).select(key.alias("key")).distinct()


def _later(spark, folder):
    rows = postings(spark, folder).filter(C("date_posted") >= F.lit(Q.SEEN_BEFORE).cast("date"))
    first = uniq_by(rows, U.posting_key(C("job_url"), C("company"), C("title")))
    return first.withColumn("job_id", U.job_id(C("job_url")))


@query("incremental_new", f"""
WITH {POSTINGS_SQL}, {_NEW_SQL}
SELECT seq, {_JOB_ID} AS job_id FROM later
WHERE {_JOB_ID} IS NOT NULL AND {_JOB_ID} NOT IN (SELECT key FROM seen)""")
def incremental_new(spark, folder):
    fresh = only_new(_later(spark, folder), _seen(spark, folder), "job_id")
    return fresh.select("seq", "job_id")


@query("incremental_state", f"""
WITH {POSTINGS_SQL}, {_NEW_SQL}
SELECT seq, {_JOB_ID} AS job_id FROM later
WHERE {_JOB_ID} IS NOT NULL AND {_JOB_ID} NOT IN (SELECT key FROM seen)""")
def incremental_state(spark, folder):
    """New postings against keys that earlier runs left in a bucketed table, one run repeated."""
    state = SeenKeys(spark, scratch_path(spark, "seen-keys"), buckets=8)
    seen = _seen(spark, folder)
    for part in (0, 1, 1):
        state.remember(seen.filter(F.pmod(F.xxhash64("key"), F.lit(2)) == part), "key")
    return state.only_new(_later(spark, folder), "job_id").select("seq", "job_id")


@query("seen_after", f"""
WITH {POSTINGS_SQL}, {_NEW_SQL}
SELECT key FROM seen UNION SELECT {_JOB_ID} FROM later WHERE {_JOB_ID} IS NOT NULL""")
def seen_after(spark, folder):
    return advance_seen(_seen(spark, folder), _later(spark, folder), "job_id")


@query("enrich_detail", f"""
WITH {POSTINGS_SQL}, {DETAILS_SQL}
SELECT p.seq, {_JOB_ID} AS job_id, md5(coalesce(d.description, '')) AS description_md5
FROM postings p LEFT JOIN details d ON d.job_id = {_JOB_ID}""")
def enrich_detail(spark, folder):
    rows = postings(spark, folder).select("seq", U.job_id(C("job_url")).alias("job_id"))
    joined = with_descriptions(rows, details(spark, folder))
    return joined.select("seq", "job_id", F.md5("description").alias("description_md5"))


@query("funnel", f"""
WITH {POSTINGS_SQL}, {UNIQUE_SQL},
picked AS (SELECT * FROM first_postings WHERE {Q.sql_title_match('title')}
  AND {Q.sql_quick_place('location', 'title')}),
kept AS (SELECT * FROM picked WHERE {Q.sql_experience("title || ' ' || description")})
SELECT (SELECT count(*) FROM postings) AS collected,
  (SELECT count(*) FROM first_postings) AS unique_rows,
  (SELECT count(*) FROM picked) AS picked, (SELECT count(*) FROM kept) AS kept,
  (SELECT count(*) FROM kept WHERE date_posted >= DATE '{Q.SEEN_BEFORE}') AS recent""")
def funnel_counts(spark, folder):
    stages = {
        "picked": R.title_likely_match(C("title"), Q.ROLE_PHRASES, Q.NEGATIVES)
        & R.place_or_remote_quick(C("location"), C("title"), Q.PLACES),
        "kept": R.experience_allowed(F.concat(C("title"), F.lit(" "), C("description"))),
        "recent": C("date_posted") >= F.lit(Q.SEEN_BEFORE).cast("date"),
    }
    key = U.posting_key(C("job_url"), C("company"), C("title"))
    return funnel(postings(spark, folder), key, stages)


# ---- shaping ---------------------------------------------------------------------

@query("unify_schema", _with(f"""
SELECT seq, coalesce({_JOB_ID}, CAST(seq AS VARCHAR)) AS li_job_id,
  CASE WHEN seq % 3 = 0 THEN 'Org ' || company ELSE company END AS company,
  title, '' AS matched_role, location, '' AS is_remote,
  CAST(date_posted AS VARCHAR) AS date_posted, '' AS ago_time, '' AS salary,
  job_url, '' AS contact_emails, '' AS contact_phones, '' AS skills,
  md5({Q.sql_trim('description')}) AS description FROM postings"""))
def unify_schema(spark, folder):
    """A feed under other column names, with padded and blank cells."""
    feed = postings(spark, folder).select(
        "seq", U.job_id(C("job_url")).alias("job_id"), C("seq").cast("string").alias("id"),
        F.when(C("seq") % 3 == 0, "  ").otherwise(C("company")).alias("company_name"),
        F.concat(F.lit("Org "), C("company")).alias("employer"),
        F.concat(F.lit(" "), C("title"), F.lit("\t")).alias("job_title"),
        C("location").alias("city"), C("date_posted").cast("string").alias("posted_at"),
        F.lit(None).cast("string").alias("pay"), C("job_url").alias("href"),
        C("description").alias("summary"))
    return unify(feed).withColumn("description", F.md5("description"))


SHAPED_SQL = f"""
  seq, coalesce({Q.sql_job_id('"jobUrl"')}, split_part("jobUrl", '?', 1)) AS li_job_id,
  company, position AS title,
  {Q.sql_first(['position', 'description'], Q.ROLE_PHRASES)} AS matched_role, location,
  {_REMOTE_SQL} AS is_remote, date AS date_posted, "agoTime" AS ago_time, salary,
  split_part("jobUrl", '?', 1) AS job_url,
  {Q.sql_sorted(Q.sql_emails('description'))} AS contact_emails,
  {Q.sql_sorted(Q.sql_phones('description'))} AS contact_phones,
  {Q.sql_skills('description')} AS skills"""


def sorted_contacts(rows):
    """Contact cells in alphabetical order, the only order both engines share."""
    return rows.withColumns({
        name: F.array_join(F.array_sort(F.split(name, "; ")), "; ")
        for name in ("contact_emails", "contact_phones")})


@query("shape_postings", f"""
WITH {CARDS_SQL}, described AS (
  SELECT cards.*, postings.description FROM cards JOIN postings USING (seq))
SELECT {SHAPED_SQL}, md5(description) AS description FROM described""")
def shape_postings(spark, folder):
    rows = postings(spark, folder).select(
        "seq", C("title").alias("position"), "company", "location",
        C("date_posted").cast("string").alias("date"),
        C("salary").cast("decimal(18,2)").cast("string").alias("salary"),
        C("job_url").alias("jobUrl"),
        F.concat(C("applicants").cast("string"), F.lit(" days ago")).alias("agoTime"),
        "description")
    shaped = shape_board(rows, Q.CONFIG)
    return sorted_contacts(shaped).withColumn("description", F.md5("description"))


@query("ordered_union", _with("""
SELECT seq, rank AS source_rank, title FROM (
  SELECT 0 AS rank, seq, title FROM postings WHERE job_url LIKE 'https://ats.%'
  UNION ALL
  SELECT 1 AS rank, seq, title FROM postings WHERE NOT job_url LIKE 'https://ats.%')"""))
def union_in_order(spark, folder):
    rows = postings(spark, folder).select("seq", "title", "job_url")
    ats = C("job_url").startswith("https://ats.")
    both = ordered_union(rows.filter(ats).drop("job_url"), rows.filter(~ats).drop("job_url"))
    return both.orderBy("seq").select(F.col("seq.own").alias("seq"), "source_rank", "title")
