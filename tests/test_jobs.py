"""Feeds run on files, feed identities, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.catalog import registry as Q
from gleaner.catalog.views import cards, details
from gleaner.config import Config
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.functions import urls as U
from gleaner.operators.dedupe import uniq_by
from gleaner.operators.shape import shape_board
from gleaner.plans import jobs
from gleaner.plans.feeds import board_feed, unique_cards
from gleaner.sources.state import load_seen
from gleaner.sources.tables import read_postings_csv
from gleaner.streaming.feeds import accept_batch, stream_dedupe_daily, stream_only_new


def card(position, company, place, url):
    return (f'<li><h3 class="base-search-card__title">{position}</h3>'
            f'<h4 class="base-search-card__subtitle">{company}</h4>'
            f'<span class="job-search-card__location">{place}</span>'
            f'<a class="base-card__full-link" href="{url}"></a></li>')


BASE = "https://b.example/jobs/view/"


@pytest.fixture
def board_pages(spark):
    page = "<ul>" + "".join([
        card("Java Developer", "Acme", "Pune, India", BASE + "dev-1000001?position=1"),
        card("Java Developer", "Acme", "Pune, India", BASE + "dev-1000001?position=9"),
        card("Senior Java Developer", "Acme", "Pune, India", BASE + "dev-1000002"),
        card("Python Developer", "Beta", "Rome", BASE + "dev-1000003"),
        card("Python Developer", "Beta", "Remote", BASE + "dev-1000004"),
        card("QA Engineer", "Gamma", "Delhi, India", BASE + "dev-1000005"),
    ]) + "</ul>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    text = '<div class="show-more-less-html__markup">{}</div>'
    landed = spark.createDataFrame([
        ("1000001", text.format("0-2 years. Mail hr@x.com or 98765 43210. Java, Spring Boot.")),
        ("1000004", text.format("work from home")),
        ("1000005", text.format("5 years")),
    ], "job_id string, html string")
    return pages, landed


def test_board_job(spark, tmp_path, board_pages):
    out = str(tmp_path)
    assert jobs.run_board(spark, *board_pages, out, "2024-01-01", "r1")
    rows = {r["li_job_id"]: r for r in read_postings_csv(spark, f"{out}/results.csv").collect()}
    assert sorted(rows) == ["1000001", "1000004"]
    first = rows["1000001"]
    assert (first["job_url"], first["contact_emails"], first["contact_phones"], first["skills"],
            first["matched_role"], first["is_remote"], first["salary"]) == (
        BASE + "dev-1000001", "hr@x.com", "+919876543210", "java; spring; spring boot",
        "java developer", "No", "Not specified")
    assert rows["1000004"]["is_remote"] == "Yes"
    seen = sorted(r["key"] for r in load_seen(spark, f"{out}/board_seen").collect())
    assert seen == ["1000001", "1000004"]


def test_incremental_board_job(spark, tmp_path, board_pages):
    out, config = str(tmp_path), Config(incremental=True)
    assert jobs.run_board(spark, *board_pages, out, "2024-01-01", "r1", config)
    # the same run again writes the same rows; the next run has nothing new and leaves them
    assert jobs.run_board(spark, *board_pages, out, "2024-01-01", "r1", config)
    assert not jobs.run_board(spark, *board_pages, out, "2024-01-02", "r2", config)
    assert read_postings_csv(spark, f"{out}/results.csv").count() == 2
    empty = board_pages[0].limit(0)
    assert not jobs.run_board(spark, empty, board_pages[1], out, "2024-01-03", "r3", config)


@pytest.fixture
def web_inputs(spark, tmp_path):
    items = [
        {"link": "https://www.acme.com/careers/1", "title": "Junior Dev", "snippet": "first",
         "displayLink": "www.acme.com"},
        {"link": "https://www.acme.com/careers/1", "title": "Junior Dev again", "snippet": "x",
         "displayLink": "www.acme.com"},
        {"link": "https://in.indeed.com/jobs/2", "title": "Junior Dev", "snippet": "x"},
        {"link": "https://beta.com/about", "title": "Junior Dev", "snippet": "x"},
        {"link": "https://beta.com/jobs/3", "title": "Senior Dev", "snippet": "fresher"},
        {"link": "https://beta.com/jobs/3", "title": "Trainee", "snippet": "late accept",
         "displayLink": "beta.com"},
    ]
    (tmp_path / "hits").mkdir()
    (tmp_path / "hits" / "page.json").write_text(json.dumps({"items": items}) + "\n")
    body = json.dumps({"@type": "JobPosting", "hiringOrganization": {"name": "Acme Ltd"},
                       "title": "Other title", "datePosted": "2025-09-16",
                       "description": "<p>Senior text</p>"})
    landed = spark.createDataFrame(
        [("https://www.acme.com/careers/1", f'<script type="application/ld+json">{body}</script>')],
        "url string, html string")
    return str(tmp_path / "hits"), landed


def test_web_job(spark, tmp_path, web_inputs):
    out = str(tmp_path / "out")
    jobs.run_web(spark, *web_inputs, out, "2024-01-01", "r1")

    def rows():
        return {r["job_url"]: r for r in read_postings_csv(spark, f"{out}/google_jobs.csv").collect()}

    first = rows()
    assert sorted(first) == ["https://beta.com/jobs/3", "https://www.acme.com/careers/1"]
    acme, beta = first["https://www.acme.com/careers/1"], first["https://beta.com/jobs/3"]
    # the title stays the hit's; the rules look at the snippet, not the enriched text
    assert (acme["title"], acme["company"], acme["description"], acme["via"], acme["source"]) == (
        "Junior Dev", "Acme Ltd", "Senior text", "www.acme.com", "google_jobs")
    # a link turned away once may still be accepted later
    assert (beta["title"], beta["company"], beta["posted_at"]) == ("Trainee", "beta.com", "")
    # the same day remembers its links, the next day does not
    jobs.run_web(spark, *web_inputs, out, "2024-01-01", "r2")
    assert rows() == {}
    jobs.run_web(spark, *web_inputs, out, "2024-01-02", "r3")
    assert len(rows()) == 2


def test_all_jobs_and_merge(spark, tmp_path, board_pages, web_inputs):
    out = str(tmp_path / "out")
    clean = jobs.run_all(spark, *board_pages, *web_inputs, out, "2024-01-01", "r1")
    assert clean.count() == 4
    audit = read_postings_csv(spark, f"{out}/combined_results_all.csv")
    assert audit.count() == 4 and "source" not in audit.columns


def test_merge_files(spark, tmp_path):
    (tmp_path / "google_jobs.csv").write_text(
        '﻿"source","g_job_id","company","title","location","posted_at","via","job_url","description"\n'
        '"google_jobs","t1","Acme","Dev","","2025-09-16","a","https://h/1/","web wins"\n'
        '"google_jobs","t2","Beta","Dev","","","b","https://h/2?x=1","second"\n', encoding="utf-8")
    (tmp_path / "results.csv").write_text(
        "li_job_id,company,title,job_url,description\n"
        "11,Other,Role,https://h/1,same url\n"
        "12,ACME,dev ,https://h/9,same pair\n"
        "13,New,Role,https://h/3,kept\n"
        "13,New,Role2,https://h/4,same id\n", encoding="utf-8")
    clean = jobs.run_merge(spark, str(tmp_path), str(tmp_path / "out"))
    assert [r["description"] for r in clean.orderBy("seq").collect()] == [
        "web wins", "second", "kept"]
    assert read_postings_csv(spark, str(tmp_path / "out" / "combined_results_all.csv")).count() == 6
    assert read_postings_csv(spark, str(tmp_path / "out" / "combined_results.csv")).count() == 3


def test_merge_without_web_file(spark, tmp_path):
    (tmp_path / "results.csv").write_text("id,company,title\n1,A,T\n")
    assert jobs.run_merge(spark, str(tmp_path), str(tmp_path / "out")).count() == 1


def test_redundant_steps_change_nothing(spark, folder):
    """The full place and role tests and a second key pass after the join drop no row."""
    c, config = F.col, Q.CONFIG
    short = board_feed(cards(spark, folder), details(spark, folder), config)
    picked = unique_cards(cards(spark, folder)).filter(
        R.title_likely_match(c("position"), config.role_phrases, config.negative_words)
        & R.place_or_remote_quick(c("location"), c("position"), config.places))
    joined = picked.withColumn("job_id", U.job_id(c("jobUrl"))).join(
        details(spark, folder), "job_id", "left").fillna("", ["description"])
    strict = joined.filter(
        R.place_or_remote(c("location"), c("position"), c("description"), config.places)
        & R.role_matches(c("position"), c("description"), config.role_phrases, config.negative_words)
        & R.experience_allowed(F.concat_ws(" ", "position", "description")))
    again = uniq_by(strict, U.posting_key(c("jobUrl"), c("company"), c("position")))
    long = shape_board(again, config)
    assert short.exceptAll(long).count() == 0 and long.exceptAll(short).count() == 0


def test_soft_dedupe_option(spark, folder):
    from dataclasses import replace

    rows = board_feed(cards(spark, folder), details(spark, folder),
                      replace(Q.CONFIG, soft_dedupe=True))
    pairs = rows.select(X.slug(F.col("company")), X.slug(F.col("title")))
    assert pairs.count() == pairs.distinct().count()


# ---- streams ---------------------------------------------------------------------

def event_files(spark, folder, path, parts):
    """The events table as several files that arrive one per batch."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    total = events.count()
    for i in range(parts):
        part = events.filter((F.col("event_id") >= total * i // parts)
                             & (F.col("event_id") < total * (i + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_over_several_batches(spark, folder, tmp_path):
    feed = event_files(spark, folder, str(tmp_path / "in"), 4)
    out = str(tmp_path / "out")
    query = stream_only_new(feed, "props", "event_id", out, str(tmp_path / "log"))
    query.awaitTermination()
    accepted = spark.read.parquet(out)
    assert accepted.select("batch").distinct().count() > 1
    keys = spark.read.parquet(f"{folder}/events.parquet").select("props").distinct()
    assert accepted.count() == keys.count()
    assert accepted.select("props").distinct().count() == keys.count()


def test_batch_can_run_again(spark, tmp_path):
    path = str(tmp_path / "out")
    run = accept_batch("k", "seq", path)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "seq long, k string")
    second = spark.createDataFrame([(5, "a"), (6, "b")], "seq long, k string")
    run(first, 0)
    run(second, 1)
    run(second, 1)
    run(first, 0)
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == [1, 6]


def test_stream_goes_on_after_a_failure(spark, folder, tmp_path):
    """What was accepted before the failure stays, and the failed batch is taken up again."""
    feed = event_files(spark, folder, str(tmp_path / "in"), 4)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    accept = accept_batch("props", "event_id", out)

    def failing(batch, batch_id):
        accept(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("lost after the write")

    broken = (feed.writeStream.foreachBatch(failing).option("checkpointLocation", log)
              .trigger(availableNow=True).start())
    with pytest.raises(Exception, match="lost after the write"):
        broken.awaitTermination()
    assert spark.read.parquet(out).count() > 0
    stream_only_new(feed, "props", "event_id", out, log).awaitTermination()
    accepted = spark.read.parquet(out)
    keys = spark.read.parquet(f"{folder}/events.parquet").select("props").distinct()
    assert accepted.count() == keys.count() == accepted.select("props").distinct().count()


def test_daily_stream_equals_batch(spark, folder, tmp_path):
    feed = event_files(spark, folder, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    stream_dedupe_daily(feed, "user_id", "ts", "event_id", out,
                        str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(out).select("day", "user_id")
    want = spark.read.parquet(f"{folder}/events.parquet").select(
        F.to_date("ts").cast("string").alias("day"), "user_id").distinct()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_rows_are_not_lost(spark, tmp_path):
    """A day's first row may come long after later days."""
    path, run = str(tmp_path / "out"), accept_batch("k", "seq", str(tmp_path / "out"), "r", ts="ts")
    rows = [(1, "a", "2024-01-10 08:00:00"), (2, "a", "2024-01-01 08:00:00"), (3, "a", "2024-01-10 23:00:00"), (4, "b", "2024-01-01 09:00:00"),
            (5, "b", "2024-01-01 23:59:59"), (6, None, "2024-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "seq long, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for number, seqs in enumerate([(1,), (2, 3), (4, 5, 6)]):
        run(frame.filter(F.col("seq").isin(*seqs)), number)
    run(frame.filter(F.col("seq").isin(2, 3)), 1)
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == [1, 2, 4]


def test_a_new_checkpoint_keeps_what_the_old_one_accepted(spark, folder, tmp_path):
    feed, out = event_files(spark, folder, str(tmp_path / "in"), 3), str(tmp_path / "out")
    stream_only_new(feed, "user_id", "event_id", out, str(tmp_path / "log1")).awaitTermination()
    first = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    stream_only_new(feed, "user_id", "event_id", out, str(tmp_path / "log2")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == first


# ---- what the jobs leave alone ----------------------------------------------------

def test_a_blank_detail_page_does_not_hide_a_full_one(spark, tmp_path, board_pages):
    pages, landed = board_pages
    blank = spark.createDataFrame([("1000001", "<p></p>", 0), ("1000001", None, 1)], "job_id string, html string, landed_at int")
    both = blank.union(landed.withColumn("landed_at", F.lit(5))).union(
        spark.createDataFrame([("1000001", '<div class="show-more-less-html__markup">later</div>', 9)], blank.schema))
    jobs.run_board(spark, pages, both, str(tmp_path), "2024-01-01", "r1")
    rows = {r["li_job_id"]: r["description"] for r in read_postings_csv(spark, f"{tmp_path}/results.csv").collect()}
    assert rows["1000001"].startswith("0-2 years")


def test_incremental_run_merges_new_rows_only(spark, tmp_path, board_pages, web_inputs):
    out, config = str(tmp_path / "out"), Config(incremental=True)
    pages, landed = board_pages
    jobs.run_all(spark, pages, landed, *web_inputs, out, "2024-01-01", "r1", config)
    more = spark.createDataFrame([(2, "<ul>" + card("QA Engineer", "Delta", "Pune, India", BASE + "qa-1000009") + card(
        "Java Developer", "Acme", "Pune, India", BASE + "dev-1000001") + "</ul>")], "page_id long, html string")
    clean = jobs.run_all(spark, more, landed, *web_inputs, out, "2024-01-02", "r2", config)
    assert sorted(r["li_job_id"] for r in clean.collect() if r["li_job_id"]) == ["1000009"]
    # a run without any row leaves the rows of the run before, and they are merged as the file's would be
    clean = jobs.run_all(spark, more.limit(0), landed, *web_inputs, out, "2024-01-03", "r3", config)
    assert sorted(r["li_job_id"] for r in clean.collect() if r["li_job_id"]) == ["1000009"]


def test_merge_of_a_folder_that_jobs_wrote(spark, tmp_path, board_pages, web_inputs):
    out = str(tmp_path / "out")
    jobs.run_web(spark, *web_inputs, out, "2024-01-01", "r1")
    jobs.run_board(spark, *board_pages, out, "2024-01-01", "r1")
    assert jobs.run_merge(spark, out, str(tmp_path / "merged")).count() == 4


def test_only_wanted_pages_are_parsed(spark, tmp_path, board_pages, monkeypatch):
    """Detail pages of cards that fail the title or place test never reach the parser."""
    from gleaner.sources import pages as P

    seen = []
    parse = P._parse
    monkeypatch.setattr(P, "_parse", lambda pages, key, *a: (seen.append(pages), parse(pages, key, *a))[1])
    jobs.run_board(spark, *board_pages, str(tmp_path), "2024-01-01", "r1")
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "job_id" in plan


def test_page_ids_of_any_kind(spark):
    cards_ = spark.createDataFrame([(2**60, 1), (2**60, 0), (5, 3_000_000)], "page_id long, item_pos int")
    assert [tuple(r["seq"])[2:] for r in jobs.numbered(cards_).orderBy("seq").collect()] == [(5, 3_000_000), (2**60, 0), (2**60, 1)]
    named = spark.createDataFrame([("b", 0), ("a", 7)], "page_id string, item_pos int")
    assert [r["seq"]["file"] for r in jobs.numbered(named).orderBy("seq").collect()] == ["a", "b"]
