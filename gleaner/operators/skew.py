"""Joins and groups whose keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 64
GROUP_LIMIT = 1000  # Spark trims groups before the shuffle up to this many rows


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left join to a table that is unique on ``key``.

    Rows without a key match nothing, so a hash of the column ``spread`` deals
    them out instead of letting them meet in the null partition.  Rows of a hot
    key are split by the adaptive skew join: both sides are shuffled for this
    join alone, which is what it needs.
    """
    bucket = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(F.col(key).isNull(), bucket).otherwise(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.lit(0)), [key, "_salt"], "left").drop("_salt")


def first_per_group(df: DataFrame, group: list[Column], order: list[Column], n: int = 1,
                    spread: Column | None = None, salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of every group.

    Spark trims each task's rows to ``n`` per group before the shuffle, up to
    GROUP_LIMIT.  Beyond that ``spread`` is used: the groups are first cut to
    ``n`` within ``salts`` slices, which loses no row of the answer and keeps a
    hot group out of a single sort.
    """
    names = [f"_g{i}" for i in range(len(group))]
    out = df.withColumns(dict(zip(names, group)))
    if spread is not None and n > GROUP_LIMIT:
        out = out.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(salts)))
        inner = Window.partitionBy(*names, "_slice").orderBy(*order)
        out = out.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= n).drop("_rn")
    window = Window.partitionBy(*names).orderBy(*order)
    out = out.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    return out.drop("_rn", "_slice", *names)
