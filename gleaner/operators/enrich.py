"""Joins: what was seen before, page details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators.skew import lookup


def only_new(df: DataFrame, seen: DataFrame, key: str, seen_key: str = "key") -> DataFrame:
    """Rows with a non-empty key that was not seen before.

    Meant for rows already unique on the key, where neither side can be skewed.
    """
    known = seen.select(F.col(seen_key).alias(key)).distinct()
    return df.filter(X.text(F.col(key)) != "").join(known, key, "left_anti")


def advance_seen(seen: DataFrame, accepted: DataFrame, key: str,
                 seen_key: str = "key") -> DataFrame:
    """Seen keys plus the non-empty keys of accepted rows."""
    added = accepted.filter(X.text(F.col(key)) != "").select(F.col(key).alias(seen_key))
    return seen.select(seen_key).union(added).distinct()


def with_descriptions(cards: DataFrame, details: DataFrame, row_id: str = "seq",
                      key: str = "job_id") -> DataFrame:
    """Description by posting number; empty where there is none.

    ``details`` holds one row per number.
    """
    joined = lookup(cards, details.select(key, "description"), key, row_id)
    return joined.withColumn("description", X.text(F.col("description")))


def with_found(hits: DataFrame, found: DataFrame, link: str = "link",
               found_key: str = "url") -> DataFrame:
    """Adds the posting data found on the hit's page as the struct ``found``.

    Both sides hold one row per link.
    """
    fields = [c for c in found.columns if c != found_key]
    right = found.select(F.col(found_key).alias(link), F.struct(*fields).alias("found"))
    return hits.join(right, link, "left")
