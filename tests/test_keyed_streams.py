"""Streams whose state is kept by key."""

import pytest
from pyspark.sql import functions as F

from gleaner.catalog import QUERIES
from gleaner.streaming.keyed import first_of_keys, stream_first_of_keys

FIELDS = "seq long, k string, ts timestamp_ntz, other string"


def arrive(spark, path, number, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], FIELDS.replace("timestamp_ntz", "string"))
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{path}/{number}")


def feed(spark, path):
    return spark.readStream.schema(FIELDS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, tmp_path, **how):
    query = stream_first_of_keys(feed(spark, str(tmp_path / "in")), "k", "seq", str(tmp_path / "out"), str(tmp_path / "log"), **how)
    query.awaitTermination()
    assert query.exception() is None
    return query


def accepted(spark, tmp_path):
    return sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect())


@pytest.fixture(autouse=True)
def store(spark):
    from gleaner.streaming.keyed import STORE

    was = spark.conf.get(STORE)
    yield
    spark.conf.set(STORE, was)


def test_late_files_and_a_restart(spark, tmp_path):
    """A day's first row may come after later days, and after the query was stopped and started again."""
    day = "2024-01-{:02} 08:00:00".format
    arrive(spark, tmp_path / "in", 0, [(5, "a", day(10)), (4, "a", day(10)), (6, "b", day(10)), (7, None, day(10)), (8, "", day(10))])
    arrive(spark, tmp_path / "in", 1, [(9, "a", day(10)), (3, "a", day(1)), (10, "c", day(11))])
    run(spark, tmp_path, ts="ts")
    assert accepted(spark, tmp_path) == [3, 4, 6, 10]
    arrive(spark, tmp_path / "in", 2, [(1, "a", day(10)), (2, "b", day(1)), (11, "c", day(11)), (12, "c", day(2))])
    query = run(spark, tmp_path, ts="ts")
    assert accepted(spark, tmp_path) == [2, 3, 4, 6, 10, 12]
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [4]


def test_batches_read_no_history(spark, tmp_path):
    for number in range(4):
        arrive(spark, tmp_path / "in", number, [(100 * number + i, f"k{(number * 30 + i) % 90}", None) for i in range(50)])
    query = run(spark, tmp_path)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [50] * 4
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress] == [50, 80, 90, 90]
    assert len(accepted(spark, tmp_path)) == 90


def test_keys_count_again_after_their_lifetime(spark, tmp_path):
    at = "2024-01-01 {:02}:00:00".format
    arrive(spark, tmp_path / "in", 0, [(1, "a", at(8)), (2, "a", at(9)), (3, "a", at(10)), (4, "b", at(9)), (5, "a", None)])
    arrive(spark, tmp_path / "in", 1, [(6, "a", at(11)), (7, "b", at(8)), (8, "a", at(12)), (9, "a", at(12)), (10, "b", at(20))])
    run(spark, tmp_path, ts="ts", lifetime=2 * 3600)
    assert accepted(spark, tmp_path) == [1, 3, 4, 8, 10]


def test_keys_cost_no_calls_to_python(spark, tmp_path):
    """The entries are held by Spark's own deduplication; Python sees batches and buckets of rows."""
    text = first_of_keys(feed(spark, str(tmp_path)), ["k"], "seq")._jdf.queryExecution().analyzed().toString()
    assert text.lstrip("~").startswith("Deduplicate") and "MapInArrow" in text and "TransformWithState" not in text


def test_first_of_a_batch_of_many_files(spark, tmp_path):
    """The first by order of all files of a batch; orders that a double cannot tell apart, or none, are told apart."""
    large = 2**53
    rows = [(large + 1, "a", "x"), (large, "a", "x"), (None, "a", "x"), (None, "b", "x"), (7, "c", "x"), (None, "d", "x"), (9, "d", "x")]
    frame = spark.createDataFrame(rows, "seq long, k string, other string").coalesce(1)
    frame.write.parquet(str(tmp_path / "in" / "0"))
    spark.range(30000).selectExpr("id + 1 seq", "'hot' k", "'x' other").repartition(3, "seq").write.parquet(str(tmp_path / "in" / "1"))
    spark.range(400).selectExpr("400 - id seq", "concat('k', id % 100) k", "'x' other").repartition(8, "seq").write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream_first_of_keys(stream, "k", "seq", str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r["k"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 105 and spark.read.parquet(str(tmp_path / "out")).count() == 105
    assert got["a"] == large and got["b"] is None and (got["c"], got["d"], got["hot"]) == (7, 9, 1)
    assert all(got[f"k{i}"] == 100 - i for i in range(100))


@pytest.mark.parametrize("name", ["stream_state_keys", "stream_batches"])
def test_a_lot_of_several_files_is_one_batch(spark, tmp_path, name):
    """Whichever file of a lot is taken first, some user's first event is in another."""
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    for file in range(16):
        rows = spark.range(48).selectExpr(
            f"id * 48 + (({file} + id) % 16) * 3 event_id", "timestamp_ntz'2024-01-05 10:00:00' ts", "id user_id",
            "'view' event_type", "0D value", "'{}' props")
        rows.select([F.col(f.name).cast(f.dataType) for f in schema]).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "events.parquet"))
    got = {r["user_id"]: r["event_id"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {i: i * 48 for i in range(48)}
