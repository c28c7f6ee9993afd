"""Duplicate removal with deterministic first-wins meaning."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as X
from gleaner.functions import urls as U
from gleaner.operators.groups import EDGES_AT_ONCE, connected
from gleaner.operators.skew import first_per_group
from gleaner.session import Steps, materialize

SCANNED_AT_ONCE = 1_000_000  # rows of a component that one task scans, holding the keys of those it keeps


def uniq_by(df: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """First row per key in ``order``; an empty key is a key like any other.

    The key may be any column expression, a pandas UDF included.  Each task
    keeps one row per key before the shuffle, so a hot key sends one row per
    task.
    """
    return first_per_group(df, [key], [F.col(order)])


def soft_dedupe(df: DataFrame, company: str = "company", title: str = "title",
                order: str = "seq") -> DataFrame:
    """First row per company and title, ignoring case and punctuation."""
    return uniq_by(df, U.company_title_slug(F.col(company), F.col(title)), order)


def posting_keys(post_id: str = "li_job_id", url: str = "job_url", company: str = "company",
                 title: str = "title") -> dict[str, Column]:
    """The three keys two feeds are matched on."""
    return {
        "id": X.trimmed(F.col(post_id)),
        "url": U.canonical(F.col(url)),
        "pair": U.company_title_pair(F.col(company), F.col(title)),
    }


def _numbered(keyed: DataFrame, steps: Steps) -> DataFrame:
    """``keyed`` with a long ``rid`` in the order of ``seq``; another order than whole numbers is sorted once."""
    if isinstance(keyed.schema["seq"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return keyed.withColumn("rid", F.col("seq").cast("long"))
    ranged = keyed.repartitionByRange("seq").sortWithinPartitions("seq")
    return steps.keep(ranged.withColumn("rid", F.monotonically_increasing_id()))


def _chained(single: DataFrame, steps: Steps) -> DataFrame:
    """(rid, last, odd): where the pointers of rows with one rival lead, and whether by an odd number of steps.

    Doubling: every round halves the number of steps left, so a chain of n rows takes log2(n).
    """
    chain = single.select("rid", F.col("rival").alias("last"), F.lit(True).alias("odd"))
    while True:
        ahead = chain.select(F.col("rid").alias("last"), F.col("last").alias("next"), F.col("odd").alias("more"))
        moved = steps.keep(chain.join(ahead, "last", "left").select(
            "rid", F.coalesce("next", "last").alias("last"),
            (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")))
        chain = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return chain


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that a scan keeps, from (root, rid, keys) in order: the keys kept so far are one component's."""
    root, taken = None, set()
    for batch in batches:
        kept = []
        for now, rid, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now != root:
                root, taken = now, set()
            if taken.isdisjoint(keys):
                taken.update(keys)
                kept.append(rid)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["rid"])


def _first_two(left: DataFrame, chains: bool, steps: Steps) -> DataFrame:
    """``rid`` of rows that are kept, as the first two undecided rows of every key tell.

    A row that is first on all its keys is kept.  With ``chains``, a row whose only rival is one
    earlier row is kept exactly when that one is not, and chains of such rows are resolved by
    pointer doubling.
    """
    if not chains:
        heads = left.groupBy("key").agg(F.min("rid").alias("rid"), F.min_by("width", "rid").alias("width"))
        return steps.keep(heads.groupBy("rid", "width").count().filter("count = width").select("rid"))
    by_key = Window.partitionBy("key").orderBy("rid")
    heads = left.withColumn("nth", F.row_number().over(by_key)).filter("nth <= 2").withColumn(
        "rival", F.when(F.col("nth") == 2, F.lag("rid").over(by_key)))
    state = steps.keep(heads.groupBy("rid", "width").agg(
        F.count("*").alias("heads"), F.min("rival").alias("rival"), F.max("rival").alias("other"),
        F.count("rival").alias("seconds")).filter("heads = width"))
    first = state.filter("seconds = 0").select("rid")
    single = state.filter("seconds > 0 and rival = other")
    # an even number of steps behind a kept row; the row one step behind it is dropped
    return steps.keep(first.union(_chained(single, steps).filter("not odd").join(
        first.withColumnRenamed("rid", "last"), "last", "left_semi").select("rid")))


def greedy_keep(df: DataFrame, keys: Mapping[str, Column], seq: str = "seq") -> DataFrame:
    """``seq`` of the rows a scan in ``seq`` order would keep.

    The scan drops a row when any of its non-blank keys belongs to an earlier
    *kept* row; a dropped row's keys block nobody.  A null key is a blank one.

    * Rows with the same set of keys are folded to their first before anything
      else, so a mass of identical copies costs one row per task.
    * Rows that are first on all their keys are kept, and rows that share a key with them are not.
      That settles most rows, and all but one of those around a hot key.  While many rows are left
      and a round settles half of them or more, another round follows: together they cost two of the first.
    * The others fall into components of rows that share keys, directly or by way of others.  The
      scan's verdict on a row depends on its own component alone, so components are dealt out
      by their smallest row and each is scanned in order, with the keys it has kept so far.
    * A component of more than SCANNED_AT_ONCE rows doesn't go to one task.  Its rows are settled by
      further rounds over the first two rows of every key, which break it up, and what is left falls into components anew.

    Unless such a component is there, the number of jobs doesn't depend on the length of the rows' chains, and
    on the rows by the logarithm of their number at most.
    """
    spark, names = df.sparkSession, list(keys)
    with Steps(spark, "greedy") as steps:
        keyed = steps.keep(df.select(F.col(seq).alias("seq"), *[X.text(keys[n]).alias(n) for n in names]))
        keyed = _numbered(keyed, steps)
        blank = F.concat(*[F.col(n) for n in names]) == ""
        kept = [keyed.filter(blank).select("rid")]
        tags = {f"_k{i}": F.when(F.col(n) != "", F.concat(F.lit(f"{i}:"), F.col(n))) for i, n in enumerate(names)}
        rows = steps.keep(keyed.filter(~blank).groupBy(*names).agg(F.min("rid").alias("rid")).select(
            "rid", *[tag.alias(k) for k, tag in tags.items()]))
        held = F.array_compact(F.array(*tags))
        count, chains = rows.count(), False
        while True:
            winners = _first_two(rows.select("rid", F.size(held).alias("width"), F.explode(held).alias("key")), chains, steps)
            kept.append(winners)
            won = steps.keep(rows.join(winners, "rid", "left_semi"))
            for k in tags:
                rows = rows.join(won.select(k), k, "left_anti")
            rows = steps.keep(rows)
            before, count = count, rows.count()
            if count * len(names) > EDGES_AT_ONCE and 2 * count <= before:
                continue
            left = rows.select("rid", F.explode(held).alias("key"))
            # A key's rows hang on its first; the aggregate is written, so that a hot key's rows can be split in the join.
            hubs = steps.keep(left.groupBy("key").agg(F.min("rid").alias("b"), F.count("*").alias("n")).filter("n > 1").select("key", "b"))
            roots = connected(left.join(hubs, "key").select(F.col("rid").alias("a"), "b"), steps)
            # rows whose rivals all went have no edge
            kept.append(steps.keep(rows.select("rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left_anti")))
            large = steps.keep(roots.groupBy("root").count().filter(F.col("count") > SCANNED_AT_ONCE).select("root"))
            small = rows.join(roots.join(large, "root", "left_anti"), F.col("rid") == F.col("node"))
            kept.append(steps.keep(small.select("root", "rid", held.alias("keys")).repartition("root").sortWithinPartitions(
                "root", "rid").mapInArrow(_scanned, "rid long")))
            if large.isEmpty():
                break
            rows = steps.keep(rows.join(roots.join(large, "root").select(F.col("node").alias("rid")), "rid", "left_semi"))
            count, chains = rows.count(), True
        return materialize(reduce(DataFrame.union, kept).join(keyed.select("rid", "seq"), "rid").select("seq"))


def greedy_dedupe(df: DataFrame, keys: Mapping[str, Column] | None = None, seq: str = "seq") -> DataFrame:
    """Rows of ``df`` left by :func:`greedy_keep`."""
    kept = greedy_keep(df, keys or posting_keys(), seq)
    return df.join(kept.withColumnRenamed("seq", seq), seq, "left_semi")
