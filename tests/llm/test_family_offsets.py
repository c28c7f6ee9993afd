"""Where the roots of a large family lie among its blocks."""

import re

from pyspark.sql import functions as F

from gleaner.llm.near_dedup import _offsets
from gleaner.session import Steps


def test_roots_lie_end_to_end(spark):
    room = spark.range(3000).select((F.col("id") % 2).alias("family"), F.col("id").alias("root"), (1 + F.col("id") % 7 * (F.col("id") % 11)).alias("holds"), F.lit(40).cast("long").alias("blocks"))
    with Steps(spark, "test") as steps:
        out = _offsets(room, steps)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        rows = out.collect()
    assert len(rows) == 3000
    for family in (0, 1):
        at = 0
        for r in sorted((r for r in rows if r["family"] == family), key=lambda r: r["before"]):
            assert r["before"] == at
            at += r["holds"]
    # one task a family sees sums of buckets, not roots
    assert not re.search(r"sum\(holds#\d+L?\) windowspecdefinition\(family#\d+L?, (?!power)", plan) and "windowspecdefinition" in plan
