"""Extraction from HTML, with board markup and JSON-LD oddities."""

import json

import pyarrow as pa
import pytest

from gleaner.catalog import QUERIES
from gleaner.sources import pages as P
from gleaner.sources.markup import Field, collect
from gleaner.sources.pages import extract_cards, extract_detail, extract_jsonld, html_text

CARD = """
<li><div class="base-card">
  <a class="base-card__full-link x" href="https://b/view/dev-1234567?position=1"></a>
  <img class="artdeco-entity-image" data-delayed-url="https://logo/1">
  <h3 class="base-search-card__title">  Dev &amp; Ops </h3>
  <h4 class="base-search-card__subtitle"><a>Acme</a></h4>
  <span class="job-search-card__location">Pune</span>
  <span class="job-search-card__salary-info"> 1
     -  2 </span>
  <time class="job-search-card__listdate" datetime="2025-09-16"> 2 days ago </time>
</div></li>"""


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page_id int, html string")


def test_cards(spark):
    plain = ('<li><h3 class="base-search-card__title">T</h3>'
             '<h4 class="base-search-card__subtitle">C</h4></li>')
    lacking = '<li><h3 class="base-search-card__title">No company</h3></li>'
    rows = extract_cards(pages(spark, f"<ul>{CARD}{lacking}{plain}</ul>", None, "<p>none</p>"))
    first, second = rows.orderBy("page_id", "item_pos").collect()
    assert first.asDict() == {
        "page_id": 0, "item_pos": 0, "position": "Dev & Ops", "company": "Acme",
        "location": "Pune", "date": "2025-09-16", "salary": "1 - 2",
        "jobUrl": "https://b/view/dev-1234567?position=1", "companyLogo": "https://logo/1",
        "agoTime": "2 days ago"}
    assert (second["item_pos"], second["salary"], second["jobUrl"], second["date"]) == (
        2, "Not specified", "", None)


def test_items_without_end_tags_and_nested_lists():
    fields = (Field("t", "b"), Field("all"))
    flat = collect("<ul><li><b>1</b><li><b>2</b></ul>", fields, "li")
    assert [r["t"] for r in flat] == ["1", "2"]
    nested = collect("<ul><li><b>1</b><ul><li><b>2</b></li></ul></li></ul>", fields, "li")
    assert [r["t"] for r in nested] == ["12", "2"]


def test_nested_matches_repeat_their_text():
    fields = (Field("t", "div"),)
    assert collect("<div>a<div>b</div></div>", fields)[0]["t"] == "abb"


def test_selectors():
    html = '<p id="x" class="k m">1</p><div class="m">2</div>'
    fields = (Field("a", "#x"), Field("b", "div.m"), Field("c", ".m"), Field("d", "p#x"))
    assert collect(html, fields)[0] == {"a": "1", "b": "2", "c": "12", "d": "1"}


def test_detail_takes_first_non_empty_container(spark):
    rows = extract_detail(pages(
        spark,
        '<div id="job-details">second</div><div class="show-more-less-html__markup"> a<br>\n b </div>',
        '<div class="show-more-less-html__markup"></div><div id="job-details">second</div>',
        '<section class="description">third</section><div class="description">fourth</div>',
        "<p>nothing</p>"))
    assert [r["description"] for r in rows.orderBy("page_id").collect()] == [
        "a b", "second", "third", ""]


def test_html_text(column):
    got = column(html_text, ["<p>a &lt; b&nbsp;</p><!-- c --><script>x<y</script>", None])
    assert got == ["a < b\u00a0x<y", ""]


def block(value):
    body = value if isinstance(value, str) else json.dumps(value)
    return f'<script type="application/ld+json">{body}</script>'


def posting(**changes):
    return {"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "C"},
            "datePosted": "2025-09-16", "description": "<p>d &amp; e</p> ",
            "jobLocation": {"address": {"addressLocality": "Pune"}}, **changes}


CASES = [
    (block("{broken") + block(posting()), ("C", "Pune", "d & e")),
    (block([posting(), posting(title="other")]), ("C", "Pune", "d & e")),
    (block([{"@type": "Thing"}, posting()]), None),
    (block(posting(**{"@type": ["Thing", "JobPosting"]})), ("C", "Pune", "d & e")),
    (block(posting(**{"@type": "Article"})), None),
    (block({"@graph": [posting()]}), None),
    (block(posting(jobLocation=[{"address": {"addressLocality": "Pune"}}, {"address": None}, {},
                                {"address": {"addressLocality": "Delhi"}}])),
     ("C", "Pune, Delhi", "d & e")),
    (block(posting(jobLocation=[{}], hiringOrganization=None, description=None)), (None, "", None)),
    (block(posting(jobLocation=None)), ("C", None, "d & e")),
    (block([]) + block("null") + block("3"), None),
    (block({"@type": "Thing"}) + block(posting(title="2")) + block(posting(title="3")),
     ("C", "Pune", "d & e")),
    ("<p>none</p>", None),
    (None, None),
]


def test_jsonld(spark):
    frame = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES)],
                                  "url int, html string")
    rows = {r["url"]: r for r in extract_jsonld(frame).collect()}
    for i, (_, want) in enumerate(CASES):
        if want is None:
            assert i not in rows, i
        else:
            assert (rows[i]["company"], rows[i]["location"], rows[i]["description"]) == want, i
    assert rows[10]["title"] == "2"


@pytest.mark.parametrize("quotes", ["'", ""])
def test_jsonld_script_spelling(spark, quotes):
    html = (f"<SCRIPT id=x type={quotes}application/ld+json{quotes}>\n"
            f"{json.dumps(posting())}\n</SCRIPT >")
    assert extract_jsonld(spark.createDataFrame([(1, html)], "url int, html string")).count() == 1


def test_jsonld_blocks_by_their_exact_type(spark):
    body = json.dumps({"@type": "JobPosting", "title": "T", "description": "a <!-- b --> c"})
    rows = [
        (1, f'<script type="application/ld+json">{body}</script>', True),
        (2, f'<script type="application/ld+json; charset=utf-8">{body}</script>', False),
        (3, f'<script data-type="application/ld+json">{body}</script>', False),
        (4, f'<!-- <script type="application/ld+json">{body}</script> -->', False),
        (5, f"<!-- x --><script id='a>b' type='application/ld+json' >{body}</script >", True),
        (6, f"<SCRIPT TYPE=application/ld+json>{body}</SCRIPT>", True),
        (7, f'<script type="APPLICATION/LD+JSON">{body}</script>', False),
        (8, f'<script>var a = "<!--";</script><script type="application/ld+json">{body}</script>', True),
        (9, f"<script title='type=\"application/ld+json\"'>{body}</script>", False),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "url long, html string")
    assert sorted(r["url"] for r in extract_jsonld(pages).collect()) == [k for k, _, good in rows if good]


def test_few_pages_at_once_in_python(spark, folder, monkeypatch):
    """Batches that go to Python hold few pages, and few of a batch are strings at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query in ("html_text", "detail_text", "jsonld_extract"):
            spark.conf.set(name, "10000")
            QUERIES[query](spark, folder)
            assert spark.conf.get(name) == "1000", query
    finally:
        spark.conf.set(name, before)
    monkeypatch.setattr(P, "PAGES_AT_ONCE", 2)
    bodies = ["<b>a</b>", None, "&lt;", "", "x<!-- y -->z"]
    assert P._texts(pa.array(bodies)).to_pylist() == ["a", None, "<", "", "xz"]
    assert P._texts(pa.array([], pa.string())).to_pylist() == []
