"""Dedupe on growing feeds with a state per key.

Each key that was accepted is an entry of Spark's state store (RocksDB, checkpointed with the
query), so a batch looks up its own keys and reads nothing of what came before.  An entry may have a
lifetime, after which its key is accepted anew.  There is no watermark: late rows are judged like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gleaner.operators.ledger import utc_day

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY, PLACE = "day", "__place"
BUCKETS = 2048


class FirstOfKey(StatefulProcessor):
    """Passes on a key's rows, in order of ``ts`` and ``order``, that are ``lifetime`` seconds later than the one passed on last."""

    def __init__(self, order: str, ts: str, lifetime: int):
        self.order, self.ts, self.lifetime = order, ts, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp_ntz")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted((r for r in rows if r[self.ts] is not None), key=lambda r: (r[self.ts], r[self.order])):
            if last is None or (row[self.ts] - last).total_seconds() >= self.lifetime:
                last = row[self.ts]
                self.last.update((last,))
                yield row


def _first(rows: pa.Table, keys: Sequence[str], order: str) -> pa.Table:
    """The first row per key of an Arrow table; rows without an order come last."""
    places = pc.sort_indices(rows, sort_keys=[(order, "ascending")], null_placement="at_end")
    sorted_keys = rows.select(list(keys)).take(places).append_column(PLACE, places)
    first = sorted_keys.group_by(list(keys), use_threads=False).aggregate([(PLACE, "first")])
    return rows.take(first[f"{PLACE}_first"])


def _thinned(keys: Sequence[str], order: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first row per key of every Arrow batch, so that a hot key sends few rows to its bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _first(pa.Table.from_batches([batch]), keys, order).to_batches()
    return run


def first_of_keys(stream: DataFrame, keys: Sequence[str], order: str, ts: str | None = None, lifetime: int | None = None) -> DataFrame:
    """A stream of the rows whose keys no earlier batch had, the first by ``order`` of those in one batch.

    Rows of which a key is null or empty are left out.  With ``lifetime``, in seconds of the timestamps ``ts``, a key is
    accepted again that long after its last row that was; rows from before that one count as seen, and rows without a
    time are left out.  Needs the RocksDB state store, see :func:`stream_first_of_keys`.

    Without a lifetime the rows of a batch are dealt into buckets of keys and cut to one a key, a bucket at a time, and Spark's
    own deduplication holds the entries, so that no key costs a call to Python.
    """
    rows, keys = stream, list(keys)
    for key in keys:
        rows = rows.filter(F.col(key).cast("string") != "")
    if lifetime is not None:
        return rows.groupBy(*keys).transformWithState(FirstOfKey(order, ts, lifetime), rows.schema, "Append", "None")
    bucket = F.pmod(F.hash(*keys), F.lit(BUCKETS)).alias("bucket")
    thin = rows.mapInArrow(_thinned(keys, order), rows.schema)
    first = thin.groupBy(bucket).applyInArrow(lambda table: _first(table, keys, order), rows.schema)
    return first.dropDuplicates(keys)


def stream_first_of_keys(stream: DataFrame, key: str, order: str, path: str, checkpoint: str,
                         ts: str | None = None, lifetime: int | None = None) -> StreamingQuery:
    """First row per key over the life of the feed, as a Parquet table; with ``ts``, per key and UTC day.

    With ``ts`` and ``lifetime`` a key is accepted again after so many seconds, whatever the day.  Started again with its
    checkpoint, the query goes on where it stopped: the table and the keys' entries are committed batch by batch.
    The session's state store is switched to RocksDB.
    """
    spark = stream.sparkSession
    spark.conf.set(STORE, ROCKS)
    keys = [key]
    if ts and lifetime is None:
        stream, keys = stream.withColumn(DAY, utc_day(F.col(ts))), [DAY, key]
    return (
        first_of_keys(stream, keys, order, ts, lifetime).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
