"""Criteria, search, order, pages, grid, budgets and snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.catalog.views import postings
from gleaner.config import Config, Criteria
from gleaner.functions import text as X
from gleaner.operators import search as S
from gleaner.operators.dictionary import match_vocab
from gleaner.operators.enrich import advance_seen, only_new, with_descriptions
from gleaner.operators.ledger import admit_daily, day_budget, fresh_snapshots, funnel, purge


def test_criteria_of_the_documented_call():
    wanted = Criteria(location="India", date_since_posted="past Week", job_type="full time",
                      remote_filter="remote", salary="100000", experience_level="entry level",
                      limit="1", page="1", sort_by="recent")
    assert (wanted.window_seconds, wanted.salary_floor, wanted.experience_code,
            wanted.remote_code, wanted.job_type_code) == (604800, 100000, "2", "2", "F")
    assert (wanted.row_limit, wanted.row_offset) == (1, 25)
    odd = Criteria(limit="x", page=None, salary="5", date_since_posted="ever")
    assert (odd.row_limit, odd.row_offset, odd.salary_floor, odd.window_seconds) == (0, 0, None, None)


def test_encode_criteria(spark):
    options = spark.createDataFrame(
        [("past Week", "entry level", "full time", "remote", "100000", "recent", "a  b", "1", "1",
          False, False),
         ("", "x", "Full-Time", "On-Site", " 40000", "Recent", "", "", "z", True, True)],
        "date_since_posted string, experience_level string, job_type string, remote_filter string,"
        "salary string, sort_by string, keyword string, page string, limit string,"
        "has_verification boolean, under_10_applicants boolean").withColumn(
        "location", F.lit(" New  Delhi "))
    a, b = S.encode_criteria(options).collect()
    assert (a["date_code"], a["salary_code"], a["experience_code"], a["remote_code"],
            a["job_type_code"], a["sort_code"], a["verified_code"], a["start"],
            a["keyword_code"]) == ("r604800", "4", "2", "2", "F", "DD", "false", 25, "a+b")
    assert (b["date_code"], b["salary_code"], b["experience_code"], b["remote_code"],
            b["job_type_code"], b["sort_code"], b["few_applicants_code"], b["row_limit"]) == (
        "", "", "", "1", "F", "", "true", 0)
    key = S.encode_criteria(options).select(S.snapshot_key()).first()[0]
    assert key == "a+b|New+Delhi|r604800|4|2|2|F|false|false|25|DD|1"


@pytest.fixture
def shelf(spark):
    day = dt.date(2024, 1, 1)
    rows = [(i, f"Dev {i}", "Pune, India" if i % 2 else "Rome", day + dt.timedelta(days=i),
             1000.0 * i, "F", "2", "2" if i % 3 else "1", i % 4 == 0, i, "text dev" * (i % 5))
            for i in range(60)]
    return spark.createDataFrame(
        rows, "seq long, title string, location string, date_posted date, salary double,"
              "job_type string, experience string, remote_code string, verified boolean,"
              "applicants int, description string")


AS_OF = "2024-02-29 00:00:00"


def test_search(shelf):
    def seqs(**options):
        found = S.search_postings(shelf, Criteria(**options), F.lit(AS_OF).cast("timestamp"))
        return [r["seq"] for r in found.collect()]

    assert seqs() == list(range(60))
    assert seqs(limit="3", page="1") == [25, 26, 27]
    assert seqs(page="2") == list(range(50, 60))
    assert seqs(sort_by="recent", limit=2) == [59, 58]
    assert seqs(sort_by="Recent", limit=2) == [0, 1]
    assert seqs(location="INDIA", under_10_applicants=True) == [1, 3, 5, 7, 9]
    assert seqs(date_since_posted="PAST WEEK") == list(range(52, 60))
    assert seqs(salary="40000", has_verification=True) == [40, 44, 48, 52, 56]
    assert seqs(keyword="DEV 5", job_type="full time", remote_filter="Remote") == [
        5, 50, 52, 53, 55, 56, 58, 59]
    assert seqs(experience_level="senior") == []
    assert seqs(keyword="dev", sort_by="relevant", limit=3) == [4, 9, 14]


def test_pages_and_groups(shelf):
    page = S.page(shelf.orderBy("seq"), 1, 10)
    assert [r["seq"] for r in page.collect()] == list(range(10, 20))
    top = S.top_per_group(shelf, F.col("location"), pages=1, page_rows=3)
    assert sorted(r["seq"] for r in top.collect()) == [54, 55, 56, 57, 58, 59]


def test_default_grid_size(spark):
    config = Config()
    titles = spark.createDataFrame([(t,) for t in config.titles], "t string")
    assert S.criteria_grid(titles, "t", config.experiences).distinct().count() == 152


def test_default_page_grid(spark):
    roles = spark.createDataFrame([(r,) for r in Config().roles], "r string")
    got = [(r["role"], r["start"]) for r in S.page_grid(roles, "r").collect()]
    assert len(got) == 22 and {s for _, s in got} == {1, 11}


def test_only_new_and_seen(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None)], "seq long, id string")
    seen = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r["seq"] for r in only_new(rows, seen, "id").collect()] == [2]
    after = advance_seen(seen, rows, "id")
    assert sorted(r["key"] for r in after.collect()) == ["a", "b", "z"]


def test_descriptions(spark):
    cards = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "seq long, job_id string")
    details = spark.createDataFrame([("x", "dx"), ("q", "dq")], "job_id string, description string")
    got = with_descriptions(cards, details).collect()
    assert sorted((r["seq"], r["description"]) for r in got) == [(1, "dx"), (2, ""), (3, "")]


def test_match_vocab_equals_expression(spark, folder):
    from gleaner.functions import text as X

    terms = ("java", "c", "c++", "rest", "rest api", "node", ".net", "a b c", "the", "of the")
    texts = ["C++ and Java", "c++11", "C# dev", "Node.js, REST API", "éc", "x.net y", ".net",
             "a b c d", "a  b c", "c++", "", None, "rest", "api rest api", "a b cd", "++c++x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        (F.col("doc_id") + 1000).cast("int").alias("i"), F.col("text").alias("body"))
    frame = frame.union(docs)
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    got = match_vocab(frame, "i", "body", vocab)
    want = frame.select("i", F.explode(X.vocabulary_hits(F.col("body"), terms)).alias("term"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_budget(spark):
    t = dt.datetime
    rows = spark.createDataFrame(
        [(1, t(2024, 1, 1, 0, 1)), (2, t(2024, 1, 1, 23, 59)), (3, t(2024, 1, 1, 5)),
         (4, t(2024, 1, 2, 0, 0))], "id long, ts timestamp_ntz")
    ledger = {r["day"]: (r["used"], r["remaining"]) for r in day_budget(rows, "ts", 2).collect()}
    assert ledger == {"2024-01-01": (3, 0), "2024-01-02": (1, 1)}
    assert sorted(r["id"] for r in admit_daily(rows, "ts", "id", 2).collect()) == [1, 3, 4]


def test_snapshots(spark):
    t = dt.datetime
    rows = spark.createDataFrame([
        ("a", 1, t(2024, 1, 1, 9, 30), "old"), ("a", 2, t(2024, 1, 1, 9, 50), "new"),
        ("a", 3, t(2024, 1, 1, 9, 55), ""), ("b", 4, t(2024, 1, 1, 9, 0), "edge"),
        ("c", 5, t(2024, 1, 1, 8, 59), "expired")], "k string, id long, ts timestamp_ntz, body string")
    now = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    fresh = fresh_snapshots(rows, "k", "ts", "id", 3600, now, "body")
    assert sorted((r["k"], r["body"]) for r in fresh.collect()) == [("a", "new"), ("b", "edge")]
    assert sorted(r["id"] for r in purge(rows, "ts", 3600, now).collect()) == [1, 2, 3, 4]


def test_funnel(spark):
    rows = spark.createDataFrame(
        [(1, "a", True, True), (2, "a", False, True), (3, "b", False, True), (4, "c", True, None)],
        "seq long, k string, one boolean, two boolean")
    got = funnel(rows, F.col("k"), {"first": F.col("one"), "second": F.col("two")}).first()
    assert got.asDict() == {"collected": 4, "unique_rows": 3, "first": 2, "second": 1}


def test_config_overrides():
    config = Config.from_mapping({"ROLES": "A, ,B ", "OUT_CSV": "", "MAX_PAGES_PER_ROLE": "3", "OTHER": "x"})
    assert (config.roles, config.pages_per_role, config.out_csv) == (("A", "B"), 3, "google_jobs.csv")


@pytest.mark.parametrize(("written", "value"), [
    ("1e2", 100), (" 5 ", 5), ("2.5", 2.5), ("", 0), (None, 0), ("x", 0), ("inf", 0), ("nan", 0), ("1_0", 0), ("-3", 0), ("+4", 4),
    (".5", 0.5), ("7.", 7), ("1e400", 1e18), ("12d", 0), ("99999999999", 99999999999)])
def test_number_options_follow_one_rule(column, written, value):
    from gleaner.config import number

    assert number(written) == value and column(X.as_count, [written]) == [value]


@pytest.mark.parametrize("offset,limit", [(0, 0), (0, 7), (93, 0), (450, 25), (490, 100), (500, 5), (10**12, 5), (3, 10**12), (120, 200)])
def test_ranks(spark, monkeypatch, offset, limit):
    monkeypatch.setattr(S, "TOP_ROWS", 10)
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 31).alias("v")).repartition(5)
    want = sorted(((i, i * 7919 % 31) for i in range(500)), key=lambda r: (-r[1], r[0]))
    got = S.ranks(rows, [F.desc("v"), F.col("id").asc()], offset, limit).collect()
    assert [tuple(r) for r in got] == want[offset:offset + limit if limit else None]


def test_large_numbers_stay_what_they_are(spark):
    far = Criteria(page="99999999999", limit="3000000000")
    assert far.row_offset == 2499999999975 and far.row_limit == 3_000_000_000
    assert Criteria(page="1e400").row_offset == 10**18


def test_fractional_pages_and_limits():
    assert Criteria(page="2.5", limit="1e1").row_offset == 62 and Criteria(limit="1e1").row_limit == 10
    assert Criteria(limit="inf").row_limit == 0


def test_offset_without_limit(spark, folder):
    rows = postings(spark, folder).select("seq", "title", "date_posted", "description")
    for sort_by in ("", "recent"):
        ordered = S.search_postings(rows, Criteria(sort_by=sort_by), F.lit(None).cast("date"))
        paged = S.search_postings(rows, Criteria(page="2", sort_by=sort_by), F.lit(None).cast("date"))
        assert "CollectLimit -1" not in paged._jdf.queryExecution().executedPlan().toString()
        assert [r["seq"] for r in paged.collect()] == [r["seq"] for r in ordered.collect()][50:]
