"""Keys of all earlier runs as a bucketed table.

The table is dealt to buckets by the hash of the key when it is written, so a join on the key reads it
bucket by bucket and shuffles the run's keys alone.  Spark builds a Bloom filter of the run's keys where the
table is large (``spark.sql.optimizer.runtime.bloomFilter``) and applies it in the scan; the joins are
written so that it may.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as X


class SeenKeys:
    """Keys under a path that all executors can reach; the number of buckets belongs to the table for good."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.name = "seen_keys_" + hashlib.sha1(f"{path.rstrip('/')} {buckets}".encode()).hexdigest()[:16]
        place = f"{path.rstrip('/')}/buckets-{buckets}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING) USING parquet "
                  f"CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'")

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def _known(self, keys: DataFrame) -> DataFrame:
        """Those of the given keys that the table holds."""
        return self.keys().join(keys, "key", "left_semi")

    def only_new(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key isn't empty and not in the table."""
        rows = df.filter(X.text(F.col(key)) != "")
        own = F.col(key).cast("string")
        known = self._known(rows.select(own.alias("key"))).withColumnRenamed("key", "_known")
        return rows.join(known, own == F.col("_known"), "left_anti")

    def remember(self, df: DataFrame, key: str) -> None:
        """Add the rows' keys that are not empty; keys that are there stay as they are, so a repeated run adds none."""
        keys = df.select(F.col(key).cast("string").alias("key")).filter(X.text(F.col("key")) != "").distinct()
        self.only_new(keys, "key").write.insertInto(self.name)

    def drop(self) -> None:
        """Forget the table's name; its files stay where they are."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
