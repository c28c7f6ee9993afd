"""State of many runs at once."""

from gleaner.catalog.files import remembered
from gleaner.sources.state import append_seen_runs, load_seen


def test_every_day_and_type_is_remembered(spark, folder, tmp_path):
    want = spark.sql(f"""SELECT DISTINCT CAST(user_id AS STRING) AS key, CAST(CAST(ts AS DATE) AS STRING) AS day, event_type AS run
        FROM parquet.`{folder}/events.parquet`""")
    got = sorted(map(tuple, remembered(spark, folder, str(tmp_path / "seen")).select("key", "day", "run").collect()))
    assert len({r[1:] for r in got}) > 100 and got == sorted(map(tuple, want.collect()))


def test_runs_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "seen")
    append_seen_runs(spark.createDataFrame(
        [("a", "d1", "x"), ("a", "d1", "x"), ("", "d1", "x"), (None, "d1", "y"), ("b", "d1", "y"), ("c", "d2", None)], "k string, day string, run string"), path)
    append_seen_runs(spark.createDataFrame([("z", "d1", "x")], "k string, day string, run string"), path)
    assert {tuple(r) for r in load_seen(spark, path).collect()} == {("z", "d1", "x"), ("b", "d1", "y"), ("c", "d2", None)}
