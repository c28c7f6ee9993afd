"""Dedupe operators against plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import dedupe, groups, skew
from gleaner.operators.dedupe import greedy_dedupe, greedy_keep, soft_dedupe, uniq_by
from gleaner.operators.skew import first_per_group, lookup
from gleaner.session import Steps

SCHEMA = "seq long, a string, b string, c string"


def scan(rows):
    taken, kept = [set(), set(), set()], []
    for seq, *keys in sorted(rows):
        if any(k and k in taken[i] for i, k in enumerate(keys)):
            continue
        kept.append(seq)
        for i, k in enumerate(keys):
            if k:
                taken[i].add(k)
    return kept


def kept_by_spark(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(r["seq"] for r in greedy_keep(frame, {n: F.col(n) for n in "abc"}).collect())


def random_rows(seed, n, spread, hot=0.0):
    rng = random.Random(seed)

    def key(prefix):
        if rng.random() < 0.1:
            return ""
        if rng.random() < hot:
            return prefix + "hot"
        return f"{prefix}{rng.randrange(spread)}"

    order = rng.sample(range(10 * n), n)
    return [(s, key("a"), key("b"), key("c")) for s in order]


@pytest.mark.parametrize("seed,n,spread,hot", [
    (1, 60, 40, 0.0), (2, 300, 150, 0.0), (3, 300, 150, 0.35), (4, 300, 60, 0.35), (5, 200, 120, 0.0), (6, 200, 30, 0.1)])
def test_greedy_equals_scan(spark, seed, n, spread, hot):
    rows = random_rows(seed, n, spread, hot)
    assert kept_by_spark(spark, rows) == scan(rows)


def test_long_chain(spark):
    """Each row shares a key with the next, so that every decision hangs on the one before."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("k"), F.col("id") / 2 - F.col("id") % 2 / 2).alias("a"),
                                  F.concat(F.lit("m"), (F.col("id") + 1) / 2 - (F.col("id") + 1) % 2 / 2).alias("b"), F.lit("").alias("c"))
    kept = greedy_keep(chain, {k: F.col(k) for k in "abc"})
    assert kept.agg(F.count("*"), F.sum(F.col("seq") % 2)).first()[:] == (n // 2, 0)


def test_chains_that_meet(spark):
    """Chains of which one row has two rivals wait for both."""
    rows = [(i, f"k{i // 2}", f"m{(i + 1) // 2}", "z" if i in (11, 30) else "") for i in range(60)]
    assert kept_by_spark(spark, rows) == scan(rows)


def braid(n):
    """Rows that share keys with the one before, the one after and the third from them: chains of two rivals each."""
    return [(i, f"k{i // 2}", f"m{(i + 1) // 2}", f"z{i // 6}.{i % 3}") for i in range(n)]


def test_chains_of_two_rivals(spark):
    """Every verdict hangs on those before; the number of jobs doesn't grow with the rows."""
    jobs, tracker = [], spark.sparkContext.statusTracker()
    for n in (2_000, 100_000):
        spark.sparkContext.setJobGroup(f"braid {n}", "")
        rows = spark.range(n).select(F.col("id").alias("seq"), *[F.expr(e).alias(k) for k, e in (
            ("a", "concat('k', id div 2)"), ("b", "concat('m', (id + 1) div 2)"), ("c", "concat('z', id div 6, '.', id % 3)"))])
        kept = greedy_keep(rows, {k: F.col(k) for k in "abc"})
        assert sorted(r["seq"] for r in kept.collect()) == scan(braid(n))
        jobs.append(len(tracker.getJobIdsForGroup(f"braid {n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] < 1.5 * jobs[0]


def test_components_too_large_for_one_task(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "SCANNED_AT_ONCE", 20)
    rows = braid(50) + [(100 + s, *keys) for s, *keys in random_rows(11, 60, 40)]
    assert kept_by_spark(spark, rows) == scan(rows)


def test_rounds_while_they_settle_half(spark, monkeypatch):
    """Many rows left after a round that settled most are not yet joined up to components."""
    monkeypatch.setattr(dedupe, "EDGES_AT_ONCE", 150)
    edges = []
    monkeypatch.setattr(dedupe, "connected", lambda e, steps: (edges.append(e.count()), groups.connected(e, steps))[1])
    rows = random_rows(12, 3000, 150)
    assert kept_by_spark(spark, rows) == scan(rows)
    assert edges and max(edges) <= 150


def test_rounds_that_settle_little_end_in_components(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "EDGES_AT_ONCE", 3)
    rows = braid(30) + [(100 + s, *keys) for s, *keys in random_rows(13, 60, 40)]
    assert kept_by_spark(spark, rows) == scan(rows)


@pytest.mark.parametrize("at_once", [2_000_000, 10])
def test_connected_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(groups, "EDGES_AT_ONCE", at_once)
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(50)] + [
        (2000, 2001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    with Steps(spark, "test") as steps:
        rows = groups.connected(spark.createDataFrame(edges, "a long, b long"), steps).collect()
        assert groups.connected(spark.createDataFrame([], "a long, b long"), steps).count() == 0
    assert sorted(map(tuple, rows)) == sorted((x, find(x)) for x in list(root))


def test_null_keys_are_blank(spark):
    rows = [(1, None, None, None), (2, "k", None, ""), (3, None, None, None), (4, "k", None, None)]
    assert kept_by_spark(spark, rows) == [1, 2, 3]


def test_other_orders_than_numbers(spark):
    rows = [(f"r{s:05}", *keys) for s, *keys in random_rows(8, 80, 40)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("long", "string"))
    got = sorted(r["seq"] for r in greedy_keep(frame, {n: F.col(n) for n in "abc"}).collect())
    assert got == scan(rows)
    pair = frame.withColumn("seq", F.struct(F.lit(1).alias("rank"), F.col("seq").alias("own")))
    assert sorted(r["seq"]["own"] for r in greedy_dedupe(pair, {n: F.col(n) for n in "abc"}).collect()) == scan(rows)


def test_steps_are_deleted(spark):
    from pathlib import Path

    from gleaner.session import scratch_path

    root = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = {p.name for p in root.iterdir()}
    kept_by_spark(spark, random_rows(9, 60, 30))
    assert not any(p.name.startswith("greedy") for p in root.iterdir() if p.name not in before)


def test_documented_case(spark):
    u = "https://h/"
    rows = [
        (1, "1", u + "u1", "a", "t1"), (2, "1", u + "u2", "b", "t2"), (3, "3", u + "u2", "c", "t3"),
        (4, "", "", "d", "t4"), (5, "", "", "d", "T4"), (6, "", "", "", ""),
        (7, "7", u + "u7", "", ""), (8, "8", u + "u1/?x=1#f", "e", "t8"), (9, "7", u + "u9", "f", "t9"),
    ]
    frame = spark.createDataFrame(
        rows, "seq long, li_job_id string, job_url string, company string, title string")
    once = greedy_dedupe(frame)
    assert sorted(r["seq"] for r in once.collect()) == [1, 3, 4, 6, 9]
    assert once.count() == greedy_dedupe(once).count()


def test_rows_without_keys_are_kept(spark):
    rows = [(1, "", "", ""), (2, "", "", ""), (3, "x", "", ""), (4, "x", "", "")]
    assert kept_by_spark(spark, rows) == [1, 2, 3]


def test_no_rows(spark):
    assert kept_by_spark(spark, []) == []


def test_uniq_by_keeps_first_and_is_idempotent(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "", None, f"k{rng.randrange(20)}"])) for i in range(500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "seq long, k string")
    once = uniq_by(frame, F.col("k"))
    first = {}
    for seq, key in sorted(rows):
        first.setdefault(key, seq)
    assert sorted(r["seq"] for r in once.collect()) == sorted(first.values())
    assert uniq_by(once, F.col("k")).count() == once.count()


def test_uniq_by_pandas_udf_key(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def initial(s: pd.Series) -> pd.Series:
        return s.str[0]

    frame = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "b")], "seq long, v string")
    assert sorted(r["seq"] for r in uniq_by(frame, initial("v")).collect()) == [1, 3]


def test_soft_dedupe(spark):
    frame = spark.createDataFrame(
        [(1, "Acme Inc.", "Dev"), (2, "acme-inc", "DEV!"), (3, "Acme", "Dev")],
        "seq long, company string, title string")
    assert sorted(r["seq"] for r in soft_dedupe(frame).collect()) == [1, 3]


def test_first_per_group_beyond_the_group_limit(spark, monkeypatch):
    monkeypatch.setattr(skew, "GROUP_LIMIT", 3)
    rows = [(i, "hot" if i % 3 else f"g{i % 4}") for i in range(200)]
    frame = spark.createDataFrame(rows, "i long, g string")
    got = first_per_group(frame, [F.col("g")], [F.desc("i")], 10, spread=F.col("i"))
    want = []
    for g in {r[1] for r in rows}:
        want += sorted((i for i, name in rows if name == g), reverse=True)[:10]
    assert sorted(r["i"] for r in got.collect()) == sorted(want)
    assert set(got.columns) == {"i", "g"}


def test_lookup(spark):
    left = [(i, "hot" if i % 3 == 0 else (f"k{i % 7}" if i % 5 else None)) for i in range(300)]
    details = {"hot": "H", "k1": "one", "k2": "two", "k9": "nine"}
    got = lookup(spark.createDataFrame(left, "seq long, k string"),
                 spark.createDataFrame(list(details.items()), "k string, d string"),
                 "k", "seq", salts=4).collect()
    assert sorted((r["seq"], r["k"] or "", r["d"] or "") for r in got) == sorted(
        (i, k or "", details.get(k, "")) for i, k in left)
