"""Versioned tables, journals of runs, bucketed keys, and CSV files with different headers."""

import pytest
from pyspark.sql import functions as F

from gleaner.sources.seen_keys import SeenKeys
from gleaner.sources.tables import read_postings_csv
from gleaner.sources.versions import Journal, Versions


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_readers_see_whole_versions(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.read() is None
    first = table.write(numbers(spark, 1, 2))
    broken = numbers(spark, 3, 0).select(F.expr("1 div v").cast("int").alias("v"))
    with pytest.raises(Exception, match="(?i)zero"):
        table.write(broken)
    assert sorted(r["v"] for r in table.read().collect()) == [1, 2]
    table.write(numbers(spark, 5))
    assert [r["v"] for r in Versions(spark, str(tmp_path / "t/")).read().collect()] == [5]
    assert first.count() == 2  # a reader under way keeps the version before
    table.write(table.read().union(numbers(spark, 6)))
    assert sorted(r["v"] for r in table.read().collect()) == [5, 6]
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 2


def test_a_run_goes_on_after_any_stage(spark, tmp_path):
    made = []

    def job(fail_after=None):
        journal, rows = Journal(spark, str(tmp_path), "board", "2024-01-01", "run/1"), None
        for k, stage in enumerate(("cards", "rows", "fresh")):
            def build(k=k, rows=rows):
                made.append(k)
                return numbers(spark, 1) if rows is None else rows.select((F.col("v") * 10).alias("v"))
            rows = journal.keep(stage, build)
            if fail_after == k:
                raise RuntimeError("lost")
        out = Versions(spark, str(tmp_path / "table")).write(rows)
        journal.finish()
        return [r["v"] for r in out.collect()]

    for k in range(3):
        with pytest.raises(RuntimeError):
            job(k)
    assert made == [0, 1, 2] and Versions(spark, str(tmp_path / "table")).read() is None
    assert job() == [100] and made == [0, 1, 2]
    assert job() == [100] and made == [0, 1, 2, 0, 1, 2]


def test_seen_keys(spark, tmp_path):
    state = SeenKeys(spark, str(tmp_path / "keys"), buckets=4)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "b", "", None, "c", "c"])], "seq int, id string")
    state.remember(spark.createDataFrame([("b",), ("x",), ("b",), (None,), ("",)], "k string"), "k")
    assert sorted(r["seq"] for r in state.only_new(rows, "id").collect()) == [0, 4, 5]
    for _ in range(2):
        state.remember(rows, "id")
    assert sorted(r["key"] for r in state.keys().collect()) == ["a", "b", "c", "x"]
    state.drop()
    again = SeenKeys(spark, str(tmp_path / "keys"), buckets=4)
    assert again.only_new(rows, "id").count() == 0 and again.keys().count() == 4
    again.drop()


def test_the_state_is_not_shuffled(spark, tmp_path):
    state = SeenKeys(spark, str(tmp_path / "keys"), buckets=4)
    state.remember(spark.range(3000).select(F.col("id").cast("string").alias("k")), "k")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
               "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame([("17", 1), ("99999", 2)], "id string, n int").filter("n > 0")
        plan = state.only_new(rows, "id")._jdf.queryExecution().executedPlan().toString()
        assert [r["id"] for r in state.only_new(rows, "id").collect()] == ["99999"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and state.name in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:scan]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            above.append(line)
            depth = indent
        if "Join" in line and line in above:
            break
    assert "Bucketed: true" in lines[scan] and "SortMergeJoin" in above[-1]
    assert not any("Exchange" in line for line in above)
    state.drop()


def test_columns_by_name_in_every_file(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("﻿a,b\n1,2\n")
    (folder / "2.csv").write_text('b, "a" ,c\n"2\n2",1,3\n')
    (folder / "3.csv").write_text("")
    (folder / "4.csv").write_text("a,b\n5,6\n")
    rows = read_postings_csv(spark, str(folder))
    assert set(rows.columns) == {"a", "b", "c", "seq"}
    assert [(r["a"], r["b"], r["c"]) for r in rows.orderBy("seq").collect()] == [("1", "2", None), ("1", "2\n2", "3"), ("5", "6", None)]
