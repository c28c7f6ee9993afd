"""CSV sources and sinks of the posting feeds."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schema as S
from gleaner.functions import text as X
from gleaner.sources.hits import place

# Names the web feed is looked up by, and the fallback pattern
WEB_FILE_NAMES = ("google_jobs.csv", "google_results.csv", "google.csv")
WEB_FILE_PATTERN = r"(?i)^google.*\.csv$"
BOARD_FILE_NAME = "results.csv"

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema.add("seq", S.PLACE))


def read_postings_csv(spark: SparkSession, path: str | None,
                      schema: T.StructType = S.UNIFIED, multi_line: bool = True) -> DataFrame:
    """Relaxed CSV read: every cell a trimmed string, columns named by the header of its own file.

    Files may have their columns in any order; a column that a file lacks is null there.  A header is one line.
    A missing or blank file gives no rows of ``schema``.  ``seq`` is the row's
    place: files by name, then their rows.  ``multi_line`` allows line breaks inside quotes and reads a
    file in one task; feeds whose cells hold none can turn it off so that large
    files split.
    """
    fallback = T.StructType(list(schema.fields))
    if not path:
        return _empty(spark, fallback)
    reader = spark.read.options(**CSV_OPTIONS).options(
        mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
        multiLine=multi_line, encoding="UTF-8")
    try:
        raw = reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return _empty(spark, fallback)
        raise
    if not raw.columns:
        return _empty(spark, fallback)
    parts = []
    for names, files in _by_header(spark, path).items():
        rows = reader.schema(", ".join(f"`{i}` string" for i in range(len(names)))).csv(files)
        # of columns with one name the last counts; columns without a name are left out
        last = {n: i for i, n in enumerate(names) if n}
        parts.append(rows.select(*[X.trimmed(F.col(f"`{i}`")).alias(n) for n, i in last.items()], place().alias("seq")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under a path that are not blank, by the names in their first record; names are few, files listed."""
    text = spark.read.option("wholetext", False).text(path).select(F.col("_metadata.file_path").alias("file"), "value",
                                                                  F.col("_metadata.file_block_start").alias("at"))
    head = text.filter((F.col("at") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.first("value").alias("head"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in head.orderBy("file").collect():
        names = next(csv.reader([r["head"].lstrip("\ufeff")], skipinitialspace=True))
        found.setdefault(tuple(n.strip(X.SPACE_CHARS) for n in names), []).append(r["file"])
    return found


def latest_file(spark: SparkSession, folder: str, preferred: Sequence[str] = WEB_FILE_NAMES,
                pattern: str = WEB_FILE_PATTERN) -> str | None:
    """Newest non-empty file among the preferred names, else among the pattern.

    A folder of part files, as Spark writes, counts as one file of its name.
    """
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = store.makeQualified(root).toString().rstrip("/")
    below = F.split(F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path")), "/")
    best = (
        listing.select("path", "length", "modificationTime", F.element_at(below, 1).alias("name"))
        .groupBy("name").agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
        .filter(F.col("length") > 0)
        .withColumn("rank", F.when(F.col("name").isin(*preferred), 0)
                    .when(F.col("name").rlike(pattern), 1))
        .filter(F.col("rank").isNotNull())
        .orderBy("rank", F.desc("modificationTime"))
        .limit(1)
        .collect()
    )
    return f"{base}/{best[0]['name']}" if best else None


def read_latest(spark: SparkSession, folder: str, preferred: Sequence[str] = WEB_FILE_NAMES,
                pattern: str = WEB_FILE_PATTERN, schema: T.StructType = S.WEB_ROW) -> DataFrame:
    return read_postings_csv(spark, latest_file(spark, folder, preferred, pattern), schema)


def write_postings_csv(df: DataFrame, path: str, fields: Sequence[str] = S.UNIFIED_COLUMNS,
                       single_file: bool = False) -> None:
    """Quoted CSV with a header; ``single_file`` is for small hand-over files only."""
    out = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**CSV_OPTIONS).option("quoteAll", True).csv(path)


def write_if_any(df: DataFrame, path: str, fields: Sequence[str] = S.UNIFIED_COLUMNS,
                 single_file: bool = False) -> bool:
    """Write unless there is nothing to write, which leaves the old file alone.

    Pass a table that is already written; the emptiness test reads one row.
    """
    if df.isEmpty():
        return False
    write_postings_csv(df, path, fields, single_file)
    return True
