"""Dedupe on growing feeds.

What was accepted is a Parquet table, and that table is the state: a batch reads
the keys it needs, leaves out what they hold, and adds its own folder.  Nothing
is dropped behind a watermark, so a row that arrives late is judged like any
other, by the keys of its own day.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.ledger import utc_day
from gleaner.operators.skew import first_per_group

RUN, BATCH, DAY = "run", "batch", "day"


def _earlier(spark: SparkSession, path: str, run: str, batch_id: int, columns: list[str]) -> DataFrame | None:
    """What other runs and earlier batches of this one accepted; only the named columns are read."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    mine = (F.col(RUN).cast("string") == run) & (F.col(BATCH) >= batch_id)
    return table.filter(~mine).select(*columns)


def accept_batch(key: str, order: str, path: str, run: str = "feed",
                 ts: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function that appends the rows whose key no earlier batch had.

    With ``ts`` a key counts once a UTC day, and of the earlier batches only the
    days that occur in the batch are read.  A batch owns the folder named after
    its run and number and overwrites it, so running a batch again gives the
    same table, and a run with a new checkpoint leaves the folders of the old
    one alone.
    """
    keys = [DAY, key] if ts else [key]

    def accept(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).cast("string") != "")
        if ts:
            rows = rows.withColumn(DAY, utc_day(F.col(ts)))
        first = first_per_group(rows, [F.col(k) for k in keys], [F.col(order)])
        seen = _earlier(spark, path, run, batch_id, keys)
        if seen is not None:
            if ts:
                days = [r[DAY] for r in rows.select(DAY).distinct().collect()]  # a batch spans few days
                seen = seen.withColumn(DAY, F.col(DAY).cast("string")).filter(F.col(DAY).isin(days))
            first = first.join(seen.distinct(), keys, "left_anti")
        writer = first.write.mode("overwrite")
        (writer.partitionBy(DAY) if ts else writer).parquet(f"{path}/{RUN}={run}/{BATCH}={batch_id}")

    return accept


def _run_name(checkpoint: str) -> str:
    """A run is known by its checkpoint: going on with it goes on with the run."""
    return "c" + hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def stream_only_new(stream: DataFrame, key: str, order: str, path: str, checkpoint: str,
                    ts: str | None = None) -> StreamingQuery:
    """First row per key over the whole life of the feed, as a Parquet table; with ``ts``, per key and UTC day."""
    return (
        stream.writeStream.foreachBatch(accept_batch(key, order, path, _run_name(checkpoint), ts))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe_daily(stream: DataFrame, key: str, ts: str, order: str, path: str,
                        checkpoint: str) -> StreamingQuery:
    """One row per key and UTC day; late rows count for their own day."""
    return stream_only_new(stream, key, order, path, checkpoint, ts)
