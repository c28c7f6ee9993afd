"""Registry of queries and the vocabularies they run with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.config import Config
from gleaner.functions import text as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Vocabularies that occur in the given tables
ROLE_PHRASES = ("widget", "red widget", "ring", "gear", "anvil")
NEGATIVES = ("old", "small")
PLACES = ("nation_1",)
SKILLS = ("rest", "license", "c", "c++", "the", "mit license")
INCLUDE, EXCLUDE = ("license", "the"), ("token", "rest")
BLOCKED = ("spam-farm.", "cheap-pills.", "blog.thth")
CAREER_SITES, CAREER_PATH = ("site:example.org/en",), r"/(fr|es)/"
SEEN_BEFORE = "1998-01-01"

CONFIG = Config(
    titles=ROLE_PHRASES, negative_words=NEGATIVES, skills=SKILLS, places=PLACES,
    blocked_domains=BLOCKED, career_sites=CAREER_SITES, career_path=CAREER_PATH,
    include_tokens=INCLUDE, exclude_tokens=EXCLUDE,
)


# ---- pieces of SQL shared by the counterparts --------------------------------

def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACES = quoted(X.SPACE_CHARS)
SPACE_RE = X.SPACE


def sql_trim(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACE_RE}+', ' ', 'g'))"


def sql_slug(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g'))"


def sql_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {quoted(w)})" for w in words) + ")"


def sql_first(exprs, phrases) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({e}), {quoted(p)})" for e in exprs)
        + f" THEN {quoted(p)}" for p in phrases)
    return f"CASE {whens} ELSE '' END"


def sql_skills(expr: str, skills=SKILLS) -> str:
    def one(term: str) -> str:
        literal = term.replace("+", r"\+")
        return rf"CASE WHEN regexp_matches(lower({expr}), '\b{literal}\b') THEN {quoted(term)} END"

    return "concat_ws('; ', " + ", ".join(one(s) for s in skills) + ")"


EMAIL_SQL = "(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}"
PHONE_SQL = (rf"(?:\+91[{X.SPACE_SET}-]?)?[6-9]\d{{4}}[-{X.SPACE_SET}]?\d{{5}}\b")


def sql_emails(expr: str) -> str:
    return f"list_distinct(regexp_extract_all({expr}, '{EMAIL_SQL}'))"


def sql_phones(expr: str) -> str:
    digits = r"regexp_replace(m, '[^0-9+]', '', 'g')"
    return (
        f"list_distinct([CASE WHEN length({digits}) = 10 THEN '+91' || {digits} ELSE {digits} END "
        f"FOR m IN regexp_extract_all({expr}, '{PHONE_SQL}')])")


def sql_sorted(list_expr: str) -> str:
    return f"array_to_string(list_sort({list_expr}), '; ')"


def sql_job_id(url: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({url}, '/view/[^/]*-([0-9]{{6,}})', 1), ''), "
        f"nullif(regexp_extract({url}, 'currentJobId=([0-9]{{6,}})', 1), ''))")


def sql_key(url: str, company: str, title: str) -> str:
    pair = f"{company} || '|' || {title}"
    return f"coalesce({sql_job_id(url)}, nullif(split_part({url}, '?', 1), ''), {sql_slug(pair)})"


def sql_host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^https?://([^/?#:]+)', 1))"


def sql_canonical(url: str) -> str:
    base = f"regexp_replace({sql_trim(url)}, '[?#].*$', '', 's')"
    return (
        f"CASE WHEN regexp_matches({url}, '^https?://[^/?#]+') THEN "
        f"regexp_extract({base}, '^https?://') || lower(regexp_extract({base}, '^https?://([^/]*)', 1)) || "
        f"regexp_replace(regexp_extract({base}, '^https?://[^/]*(/.*)$', 1, 's'), '/$', '') "
        f"ELSE {sql_trim(url)} END")


REMOTE_SQL = rf"remote|work{SPACE_RE}*from{SPACE_RE}*home|wfh"


def sql_quick_place(location: str, title: str) -> str:
    return f"({sql_any(location, (*PLACES, 'remote'))} OR contains(lower({title}), 'remote'))"


def sql_title_match(title: str) -> str:
    return f"(NOT {sql_any(title, NEGATIVES)} AND {sql_any(title, ROLE_PHRASES)})"


_YEARS = r"(?:year|yr|yrs|years)\b"
_S = f"{SPACE_RE}*"
_MORE = rf"(?:\+|plus|or{_S}more|and{_S}above|min(?:imum)?|at{_S}least)"
_BIG = "(?:[3-9]|1[0-9])"
EXPERIENCE_SQL = (
    rf"\b2{_S}{_MORE}{_S}{_YEARS}",
    rf"\b1{_S}[-–to]{_S}[3-9]{_S}{_YEARS}",
    rf"\b{_BIG}{_S}(?:\+|plus)?{_S}{_YEARS}",
    rf"\b(?:min|minimum|at{_S}least){_S}{_BIG}{_S}{_YEARS}",
    rf"\b{_BIG}{_S}-{_S}[0-9]+{_S}{_YEARS}",
    rf"\bexperience{_S}[:-]?{_S}{_BIG}{_S}{_YEARS}",
)


def sql_experience(expr: str) -> str:
    return "NOT (" + " OR ".join(
        f"regexp_matches(lower({expr}), '{p}')" for p in EXPERIENCE_SQL) + ")"


def sql_walk(source: str, post_id: str = "li_job_id") -> str:
    """CTEs ending in ``kept(seq)``: one row after the other, in order of ``seq``.

    To be used under WITH RECURSIVE, after a CTE ``source``.
    """
    return f"""
lined AS MATERIALIZED (
  SELECT seq, {sql_trim(f"coalesce({post_id}, '')")} AS k1, {sql_canonical('job_url')} AS k2,
    lower({sql_trim('company')}) || '|' || lower({sql_trim('title')}) AS k3,
    row_number() OVER (ORDER BY seq) AS place
  FROM {source}),
walk(place, seq, ok, ids, urls, pairs) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false,
    CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT place, seq, ok,
    CASE WHEN ok AND k1 <> '' THEN list_append(ids, k1) ELSE ids END,
    CASE WHEN ok AND k2 <> '' THEN list_append(urls, k2) ELSE urls END,
    CASE WHEN ok THEN list_append(pairs, k3) ELSE pairs END
  FROM (
    SELECT l.*, ids, urls, pairs, NOT (
      (k1 <> '' AND list_contains(ids, k1)) OR (k2 <> '' AND list_contains(urls, k2))
      OR list_contains(pairs, k3)) AS ok
    FROM walk JOIN lined l ON l.place = walk.place + 1)),
kept AS (SELECT seq FROM walk WHERE ok)"""
