"""Counts, daily budgets and snapshots with a lifetime."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.operators.skew import first_per_group
from gleaner.session import materialize


def utc_day(ts: Column) -> Column:
    """Day string; the session zone is UTC."""
    return F.to_date(ts).cast("string")


def funnel(df: DataFrame, key: Column, stages: Mapping[str, Column],
           order: str = "seq") -> DataFrame:
    """How many rows survive each step, in one aggregation.

    ``collected`` counts rows, ``unique`` counts keys, and each stage counts
    the first rows per key that pass it and all stages before it.  A row's
    outcome is packed into one number, so no wide row is shuffled.
    """
    depth, passed = F.lit(0), F.lit(True)
    for test in stages.values():
        passed = passed & F.coalesce(test, F.lit(False))
        depth = depth + passed.cast("int")
    first = (
        df.select(key.alias("_key"), F.col(order).alias("_order"), depth.alias("_depth"))
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min_by("_depth", "_order").alias("_depth"))
    )
    return first.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("collected"),
        F.count(F.lit(1)).alias("unique_rows"),
        *[F.count_if(F.col("_depth") >= i).alias(name) for i, name in enumerate(stages, 1)],
    )


def merge_counts(combined: DataFrame, dedupe: Callable[[DataFrame], DataFrame], sources: Mapping[str, int]) -> DataFrame:
    """Rows per source, rows together, and rows left by the merge's ``dedupe``.

    The combined rows are counted while they are written, so the feeds are read once.
    """
    seen, rank = Observation("merge"), F.col("source_rank")
    rows = materialize(combined.observe(
        seen, *[F.count_if(rank == r).alias(name) for name, r in sources.items()], F.count(F.lit(1)).alias("combined")))
    counts = seen.get
    return dedupe(rows).agg(
        *[F.lit(counts.get(name, 0)).cast("long").alias(name) for name in (*sources, "combined")],
        F.count(F.lit(1)).alias("kept"))


def day_budget(units: DataFrame, ts: str, cap: int) -> DataFrame:
    """Units used and left per UTC day."""
    return (
        units.groupBy(utc_day(F.col(ts)).alias("day"))
        .agg(F.count(F.lit(1)).alias("used"))
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(cap) - F.col("used")))
    )


def admit_daily(units: DataFrame, ts: str, tie: str, cap: int) -> DataFrame:
    """The first ``cap`` units of each UTC day."""
    return first_per_group(units, [utc_day(F.col(ts))], [F.col(ts), F.col(tie)], cap,
                           spread=F.col(tie))


def _oldest(as_of: Column, ttl_seconds: int) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(ttl_seconds))


def fresh_snapshots(snapshots: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int,
                    as_of: Column, payload: str) -> DataFrame:
    """Latest non-empty result per key, where it has not outlived its time.

    The age test goes first: a key's latest result is fresh exactly when its
    latest fresh result is.
    """
    alive = snapshots.filter(F.col(ts) >= _oldest(as_of, ttl_seconds)).filter(
        F.coalesce(F.col(payload), F.lit("")) != "")
    return first_per_group(alive, [F.col(key)], [F.desc(ts), F.desc(tie)])


def purge(snapshots: DataFrame, ts: str, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Snapshots that have not expired."""
    return snapshots.filter(F.col(ts) >= _oldest(as_of, ttl_seconds))
