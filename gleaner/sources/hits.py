"""Web-search hits from landed response pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema as S
from gleaner.functions import text as X


def place() -> Column:
    """Where a row of a file scan stands.

    Spark deals splits out by size, but reads each from its start on, so file,
    start of the split and the running number within the task tell the order.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("pos"), F.lit(0).cast("long").alias("item"))


def explode_hits(pages: DataFrame, items: Column, *keep: str) -> DataFrame:
    """One row per hit that has a link; a page without items gives none."""
    return (
        pages.select(*keep, F.posexplode(items).alias("hit_pos", "hit"))
        .filter(X.text(F.col("hit.link")) != "")
        .select(*keep, "hit_pos", "hit.*")
    )


def hits_from_json(body: Column) -> Column:
    """The ``items`` array of one response body."""
    return F.from_json(body, S.HITS_PAGE)["items"]


def read_hits(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Hits of all response pages under a path; ``seq`` is their place: file name, page and item.

    ``multi_line`` is for pretty-printed bodies, one per file; the default is
    one body per line, which splits.
    """
    pages = spark.read.schema(S.HITS_PAGE).option("multiLine", multi_line).json(path)
    hits = explode_hits(pages.withColumn("seq", place()), F.col("items"), "seq")
    return hits.withColumn("seq", F.col("seq").withField("item", F.col("hit_pos").cast("long")))
