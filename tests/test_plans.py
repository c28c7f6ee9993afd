"""What the optimizer makes of the queries."""

import pytest
from pyspark.sql import functions as F

from gleaner.catalog import QUERIES
from gleaner.operators.dedupe import uniq_by

PARSING = {"html_text", "detail_text", "card_extract", "jsonld_extract", "enrich_fallback",
           "shape_web_rows", "web_feed"}
WRITING = {"multi_file_order", "csv_relaxed", "merge_files", "seen_state", "snapshot_reuse", "stream_late_days", "stream_batches",
           "greedy_dedupe", "merged_feed", "merge_funnel", "full_feed", "csv_round_trip", "stream_new_keys",
           "stream_daily_keys", "stream_state_keys", "skill_counts", "part_mentions", "incremental_state", "deep_page"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in PARSING | WRITING])
def test_no_python_and_no_cross_join(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for bad in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


@pytest.mark.parametrize("name", ["uniq_first", "soft_dedupe", "top_per_role", "daily_first",
                                  "daily_admission"])
def test_groups_are_trimmed_before_the_shuffle(spark, folder, name):
    assert "Partial" in plan(QUERIES[name](spark, folder)).split("WindowGroupLimit", 1)[1]


def test_unique_needs_one_shuffle(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert plan(uniq_by(events, F.col("user_id"), "event_id")).count("Exchange hashpartitioning") == 1


def test_counts_are_combined_before_the_shuffle(spark, folder):
    for name in ("contacts", "day_ledger"):
        assert plan(QUERIES[name](spark, folder)).count("partial_count") >= 1


def test_filters_reach_the_scan(spark, folder):
    text = plan(QUERIES["incremental_new"](spark, folder))
    assert "PushedFilters: [" in text and "o_orderdate" in text.split("PushedFilters: [", 1)[1]


def test_unused_columns_are_not_read(spark, folder):
    text = plan(QUERIES["title_match"](spark, folder))
    assert "text:string" not in text and "o_totalprice" not in text


def test_merges_carry_no_texts(spark, folder):
    """Texts are looked up for the kept rows only."""
    lines = QUERIES["merged_feed"](spark, folder)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
    texts = [i for i, line in enumerate(lines) if "Join Inner" in line and "strategy=merge" in line]
    assert len(semi) == len(texts) == 2 and all(t < s for t, s in zip(texts, semi))


def test_merge_counts_carry_no_texts(spark, folder, monkeypatch):
    from gleaner.catalog import feeds

    seen = []
    monkeypatch.setattr(feeds, "merge_counts", lambda rows, *rest: seen.append(rows.columns))
    feeds.merge_funnel(spark, folder)
    assert "description" not in seen[0]


def test_files_are_dealt_out_from_written_rows(spark, folder, monkeypatch):
    from gleaner.catalog import files

    plans = []
    monkeypatch.setattr(files, "_in_order", lambda rows, key: (plans.append(plan(rows)), rows.orderBy(key))[1])
    QUERIES["merge_files"](spark, folder)
    assert len(plans) == 2 and not any("Join" in p for p in plans)
