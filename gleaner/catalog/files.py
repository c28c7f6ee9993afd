"""Readers, writers and stored state, on files written from the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleaner.catalog import registry as Q
from gleaner.catalog.feeds import _MERGE_SQL, _split_feeds
from gleaner.catalog.postings import _WANTED, _WANTED_SQL, _as_of, _with
from gleaner.catalog.registry import query, table
from gleaner.catalog.views import postings
from gleaner.operators.dedupe import uniq_by
from gleaner.operators.search import search_stored
from gleaner.plans.jobs import run_merge
from gleaner.session import materialize, scratch_path
from gleaner.sources.hits import read_hits
from gleaner.sources.state import Snapshots, append_seen, append_seen_runs, load_seen
from gleaner.sources.tables import BOARD_FILE_NAME, read_postings_csv, write_postings_csv


def _in_order(df, key):
    """Rows dealt to files so that files and rows within them follow ``key``."""
    return df.repartitionByRange(F.col(key)).sortWithinPartitions(key)


_FOLDER = "CASE WHEN doc_id % 7 = 0 THEN 'a' WHEN doc_id % 7 = 1 THEN 'b' ELSE 'c' END"


@query("multi_file_order", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5 FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY {_FOLDER}, doc_id) = 1""")
def multi_file_order(spark, folder):
    """First hit per text over response pages in folders of unequal size."""
    c, path = F.col, scratch_path(spark, "pages")
    docs = table(spark, folder, "documents")
    place = F.when(c("doc_id") % 7 == 0, "a").when(c("doc_id") % 7 == 1, "b").otherwise("c")
    for name in "cab":
        hit = F.struct(c("doc_id").cast("string").alias("link"), c("text").alias("snippet"))
        pages = docs.filter(place == name).select("doc_id", F.to_json(F.struct(F.array(hit).alias("items"))).alias("body"))
        _in_order(pages, "doc_id").select("body").write.text(f"{path}/{name}")
    hits = read_hits(spark, [f"{path}/{name}" for name in "abc"])
    first = uniq_by(hits, F.col("snippet"))
    return first.select(c("link").alias("doc_id"), F.md5("snippet").alias("text_md5"))


@query("csv_relaxed", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5({Q.sql_trim('text')}) AS text_md5 FROM documents""")
def csv_relaxed(spark, folder):
    """Documents through the CSV sink and the relaxed reader."""
    path = scratch_path(spark, "relaxed")
    write_postings_csv(table(spark, folder, "documents"), path, ("doc_id", "lang", "text"))
    return read_postings_csv(spark, path).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("merge_files", f"""
WITH RECURSIVE {_MERGE_SQL}
SELECT li_job_id, company, title, date_posted, {Q.sql_trim('job_url')} AS job_url FROM feed
WHERE seq IN (SELECT seq FROM kept)""")
def merge_files(spark, folder):
    """Both feeds as folders of CSV files, merged from there."""
    path = scratch_path(spark, "merge")
    names = {"google_jobs.csv": ("company", "title", "location", "posted_at", "job_url"),
             BOARD_FILE_NAME: ("li_job_id", "company", "title", "location", "date_posted", "job_url")}
    for feed, (name, fields) in zip(_split_feeds(spark, folder), names.items(), strict=True):
        # written once, since dealing the rows out in order reads them for the ranges and again for the rows
        rows = materialize(feed.select("seq", *fields))
        write_postings_csv(_in_order(rows, "seq"), f"{path}/{name}", fields)
    clean = run_merge(spark, path, f"{path}/out")
    return clean.select("li_job_id", "company", "title", "date_posted", "job_url")


@query("seen_state", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS run
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type <> ''""")
def seen_state(spark, folder):
    """Keys remembered by a run per day and event type of the whole table, one of the runs repeated."""
    return remembered(spark, folder, scratch_path(spark, "seen"))


def remembered(spark, folder, path):
    """The events' users by day and type, remembered under ``path`` and loaded; the first run is written twice."""
    events = table(spark, folder, "events").select(
        "user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("run"))
    append_seen_runs(events, path)
    first = events.filter("day IS NOT NULL AND run <> ''").agg(F.min(F.struct("day", "run")).alias("first")).first()["first"]
    if first:
        append_seen(events.filter((F.col("day") == first["day"]) & (F.col("run") == first["run"])), path, *first)
    return load_seen(spark, path)


@query("snapshot_reuse", _with(f"SELECT seq, title, salary {_WANTED_SQL}"))
def snapshot_reuse(spark, folder):
    """A search stored at noon answers at half past, when nothing is left to search."""
    store = Snapshots(spark, scratch_path(spark, "snapshots"))
    noon, rows = datetime(2024, 1, 1, 12), postings(spark, folder)
    search_stored(store, rows, _WANTED, noon, _as_of(spark, folder))
    again = search_stored(store, rows.limit(0), _WANTED, noon + timedelta(minutes=30), _as_of(spark, folder))
    return again.select("seq", "title", "salary")
