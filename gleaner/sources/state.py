"""Cross-run state as append-only Parquet tables.

A run writes its own ``day``/``run`` partition with overwrite, so a repeated
run replaces what it wrote before and touches nothing else.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEN = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("day", T.StringType()),
    T.StructField("run", T.StringType()),
])


def load_seen(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Remembered keys, of one day or of all; empty when there is no table yet."""
    try:
        table = spark.read.schema(SEEN).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SEEN)
        raise
    return table if day is None else table.filter(F.col("day") == day)


def append_seen(keys: DataFrame, path: str, day: str, run: str) -> None:
    """Remember the non-empty keys of one run."""
    (
        keys.select(F.col(keys.columns[0]).cast("string").alias("key"))
        .filter(F.col("key") != "").distinct()
        .write.mode("overwrite").parquet(f"{path}/day={day}/run={run}")
    )


def append_seen_runs(keys: DataFrame, path: str) -> None:
    """Remember the non-empty keys of many runs in one write; the first column has the keys, ``day`` and ``run`` the runs.

    Each run that has keys replaces what it wrote before; other runs stay as they are.
    """
    rows = keys.select(F.col(keys.columns[0]).cast("string").alias("key"), "day", "run")
    (
        rows.filter(F.col("key") != "").distinct()
        .hint("rebalance", F.col("day"), F.col("run"))  # few files a run, and a large run in several tasks
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(path)
    )


class Snapshots:
    """Stored search results by key, each good for ``ttl_seconds`` after it was stored.

    A result is a folder ``key=<hash>/at=<microseconds>`` under ``path``; storing the same
    key at the same time again replaces it.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 3600):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl_seconds
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._store = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def _micros(at: datetime) -> int:
        return int(at.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)

    def _folder(self, key: str) -> str:
        return f"{self.path}/key={hashlib.sha256(key.encode()).hexdigest()}"

    def _stored(self, folder: str) -> list[int]:
        """Times of the finished results in a key's folder."""
        path = self._root if folder == self.path else type(self)._path(self.spark, folder)
        if not self._store.exists(path):
            return []
        names = [f.getPath() for f in self._store.listStatus(path)]
        return [int(p.getName()[3:]) for p in names if p.getName().startswith("at=") and self._store.exists(
            type(self)._path(self.spark, f"{p.toString()}/_SUCCESS"))]

    @staticmethod
    def _path(spark: SparkSession, name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(name)

    def put(self, key: str, rows: DataFrame, at: datetime) -> bool:
        """Store a result; an empty one is not stored."""
        if rows.isEmpty():
            return False
        rows.write.mode("overwrite").parquet(f"{self._folder(key)}/at={self._micros(at)}")
        return True

    def get(self, key: str, as_of: datetime) -> DataFrame | None:
        """The latest stored result that is still good, or None."""
        now = self._micros(as_of)
        good = [t for t in self._stored(self._folder(key)) if now - self.ttl * 1_000_000 <= t <= now]
        return self.spark.read.parquet(f"{self._folder(key)}/at={max(good)}") if good else None

    def _keys(self) -> list[str]:
        if not self._store.exists(self._root):
            return []
        return [f.getPath().toString() for f in self._store.listStatus(self._root)]

    def purge(self, as_of: datetime) -> int:
        """Delete results that are no longer good; returns how many."""
        oldest, gone = self._micros(as_of) - self.ttl * 1_000_000, 0
        for folder in self._keys():
            times = self._stored(folder)
            for t in times:
                if t < oldest:
                    gone += 1
                    self._store.delete(self._path(self.spark, f"{folder}/at={t}"), True)
            if all(t < oldest for t in times):
                self._store.delete(self._path(self.spark, folder), True)
        return gone

    def clear(self) -> None:
        self._store.delete(self._root, True)

    def size(self) -> int:
        """How many keys have a result, good or not."""
        return sum(bool(self._stored(folder)) for folder in self._keys())
