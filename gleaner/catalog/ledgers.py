"""Ledgers, snapshots and streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog.registry import query, table
from gleaner.operators.dedupe import uniq_by
from gleaner.operators.ledger import admit_daily, day_budget, fresh_snapshots, purge, utc_day
from gleaner.operators.skew import first_per_group
from gleaner.session import scratch_path
from gleaner.streaming.feeds import stream_dedupe_daily, stream_only_new
from gleaner.streaming.keyed import stream_first_of_keys

CAP = 90
TTL = 3600


def _events(spark, folder):
    return table(spark, folder, "events")


def _now(events):
    return events.select(F.max("ts")).scalar()


@query("json_field", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_field(spark, folder):
    parsed = F.from_json("props", "k int")
    return _events(spark, folder).select("event_id", parsed["k"].alias("k"))


@query("day_ledger", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used,
  greatest(0, {CAP} - count(*)) AS remaining FROM events GROUP BY 1""")
def day_ledger(spark, folder):
    return day_budget(_events(spark, folder), "ts", CAP)


@query("daily_admission", f"""
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= {CAP}""")
def daily_admission(spark, folder):
    admitted = admit_daily(_events(spark, folder), "ts", "event_id", CAP)
    return admitted.select("event_id", utc_day(F.col("ts")).alias("day"))


@query("fresh_snapshot", f"""
WITH stored AS (SELECT * FROM events WHERE props <> ''),
latest AS (
  SELECT user_id, event_id, ts, props FROM stored
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, props FROM latest
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {TTL} SECOND""")
def fresh_snapshot(spark, folder):
    events = _events(spark, folder)
    return fresh_snapshots(events, "user_id", "ts", "event_id", TTL, _now(events), "props").select(
        "user_id", "event_id", "props")


@query("purged", f"""
SELECT event_id, user_id FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {24 * TTL} SECOND""")
def purged(spark, folder):
    events = _events(spark, folder)
    return purge(events, "ts", 24 * TTL, _now(events)).select("event_id", "user_id")


@query("daily_first", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) = 1""")
def daily_first(spark, folder):
    first = first_per_group(_events(spark, folder), [utc_day(F.col("ts")), F.col("user_id")],
                            [F.col("ts"), F.col("event_id")])
    return first.select(utc_day(F.col("ts")).alias("day"), "user_id", "event_id")


def _stream(spark, folder):
    """The events table as a stream; the glob lets it be one file or a folder of files."""
    schema = _events(spark, folder).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")


def _finished(query):
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error


@query("stream_new_keys", """
SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def stream_new_keys(spark, folder):
    """First event per user over the whole feed, accepted batch by batch."""
    path = scratch_path(spark, "accepted")
    _finished(stream_only_new(_stream(spark, folder), "user_id", "event_id", path,
                              scratch_path(spark, "accepted-log")))
    return spark.read.parquet(path).select("user_id", "event_id")


@query("stream_daily_keys", """
SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id FROM events""")
def stream_daily_keys(spark, folder):
    """Each user once a day."""
    path = scratch_path(spark, "daily")
    _finished(stream_dedupe_daily(_stream(spark, folder), "user_id", "ts", "event_id", path,
                                  scratch_path(spark, "daily-log")))
    return spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "user_id")


def _arriving(spark, folder, order):
    """The events in three lots of files, each one batch; ``order`` tells the lot of a row.

    The stream is given out each time a lot has come, for the query to go on with from its checkpoint: however many files
    a large table makes of a lot, none is taken before the others of its lot.
    """
    events = _events(spark, folder)
    path = scratch_path(spark, "arriving")
    for k in range(3):
        events.filter(order == k).write.parquet(f"{path}/{k}")
        yield spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(path)


@query("stream_late_days", """
SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id FROM events""")
def stream_late_days(spark, folder):
    """Each user once a day over several batches, of which the first days come last."""
    path, log = scratch_path(spark, "late"), scratch_path(spark, "late-log")
    day = F.dayofmonth("ts")
    for late in _arriving(spark, folder, F.when(day > 20, 0).when(day > 10, 1).otherwise(2)):
        _finished(stream_dedupe_daily(late, "user_id", "ts", "event_id", path, log))
    return spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "user_id")


@query("stream_batches", """
SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) = 1""")
def stream_batches(spark, folder):
    """First event per user in order of arrival, over several batches."""
    path, log = scratch_path(spark, "batches"), scratch_path(spark, "batches-log")
    for stream in _arriving(spark, folder, F.col("event_id") % 3):
        _finished(stream_only_new(stream, "user_id", "event_id", path, log))
    return spark.read.parquet(path).select("user_id", "event_id")


@query("stream_state_keys", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id % 3, event_id) = 1""")
def stream_state_keys(spark, folder):
    """First event per user and day in order of arrival, with a state per key; each batch brings rows of all days."""
    path, log = scratch_path(spark, "keyed"), scratch_path(spark, "keyed-log")
    for stream in _arriving(spark, folder, F.col("event_id") % 3):
        _finished(stream_first_of_keys(stream, "user_id", "event_id", path, log, ts="ts"))
    return spark.read.parquet(path).select("day", "user_id", "event_id")


@query("uniq_users", """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def uniq_users(spark, folder):
    """First event per user as a batch; equals the streamed form."""
    return uniq_by(_events(spark, folder), F.col("user_id"), "event_id").select(
        "user_id", "event_id", "event_type")
