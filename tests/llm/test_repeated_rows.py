"""Repeated rows in the substring dedupe."""

import pyarrow as pa

from gleaner.llm import substring
from gleaner.session import Steps


def test_stretches_of_repeated_rows_come_once(spark, frame, monkeypatch):
    text = " ".join(f"w{i}" for i in range(120))
    counts = {}
    for k in (2, 40):
        def count(_):
            def run(batches):
                for batch in batches:
                    sizes = pa.array([len(r or ()) for r in batch.column(1).to_pylist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), sizes, sizes, pa.array([""] * len(sizes), pa.string())],
                                                     names=["doc", "n_words", "n_removed", "kept_text"])
            return run

        with monkeypatch.context() as patch, Steps(spark, "test") as steps:
            patch.setattr(substring, "_cut", count)
            rows = substring.remove_repeats(frame([(1, text)] * k + [(None, text)] * k + [(3, "other words")]), steps).collect()
        counts[k] = {r["n_words"] for r in rows}
    assert counts[2] == counts[40] and max(counts[2]) > 0


def test_repeated_rows_lose_all_words(spark, frame):
    text = " ".join(f"w{i}" for i in range(120))
    with Steps(spark, "test") as steps:
        rows = substring.remove_repeats(frame([(1, text)] * 30 + [(None, text)] * 30 + [(3, "a b")]), steps).collect()
    assert sorted(r["n_removed"] for r in rows) == [0] + [120] * 60


def test_texts_can_be_split_by_the_join(spark, frame):
    """Only rows dealt for a join alone are split where a key has many."""
    with Steps(spark, "test") as steps:
        plan = substring.remove_repeats(frame([(1, "a b")]), steps)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY" not in plan
