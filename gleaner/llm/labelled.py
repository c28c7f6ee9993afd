"""Bounded labelled samples and folds for the classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> pa.Table:
    """At most `rows` labelled texts outside the held-out fold, as a table (doc_id, y, text) in a fixed order.

    The ids of least hash are taken, so the sample doesn't depend on the order of rows.  A
    document whose labels disagree takes the larger; rows without id or label don't count.  A
    repeated doc_id brings its least text, once.
    """
    spread = F.xxhash64(F.col("doc_id"), F.lit(17))
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold("doc_id", folds, held))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(spread, "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return found.toArrow().sort_by("doc_id")
