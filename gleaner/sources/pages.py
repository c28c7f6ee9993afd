"""Rows out of landed HTML pages.

Only the page key and the markup travel to Python; everything after parsing is
built-in expressions again.  Filter and prune pages before calling these, since
the optimizer does not look inside the parsing step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import config as C
from gleaner.functions import text as X
from gleaner.llm.memory import give_back
from gleaner.session import small_batches
from gleaner.sources.markup import Field, collect

# ---------------------------------------------------------------------------
# Where the boards keep their fields
# ---------------------------------------------------------------------------

BOARD_CARD_FIELDS = (
    Field("position", ".base-search-card__title"),
    Field("company", ".base-search-card__subtitle"),
    Field("location", ".job-search-card__location"),
    Field("date", "time", attr="datetime"),
    Field("salary", ".job-search-card__salary-info"),
    Field("jobUrl", ".base-card__full-link", attr="href"),
    Field("companyLogo", ".artdeco-entity-image", attr="data-delayed-url"),
    Field("agoTime", ".job-search-card__listdate"),
)

DETAIL_CONTAINERS = (
    ".show-more-less-html__markup", "#job-details", "section.description", "div.description",
)

JSONLD_TYPE = r"application/ld\+json"

PAGES_AT_ONCE = 100  # so many pages of a batch are held as Python strings
GIVEN_BACK_AFTER = 16 << 20  # bytes of markup, after which a worker hands freed memory back

# ---------------------------------------------------------------------------


# Whole scripts and whole comments in page order, so that a script inside a comment is part of
# the comment and a comment inside a script part of the script.
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')"""
SCRIPT_OR_COMMENT = rf"(?is)<!--.*?-->|<script(?=[\s/>]){_ATTRS}*+>.*?</script\s*>"
# The attribute type, by its whole name, with exactly this value.
JSONLD_SCRIPT = (
    rf"(?s)^<(?i:script)(?=[\s/]){_ATTRS}*?[\s/](?i:type)\s*=\s*"
    rf"(?:\"{JSONLD_TYPE}\"|'{JSONLD_TYPE}'|{JSONLD_TYPE}(?=[\s>]))")
SCRIPT_BODY = rf"(?is)^<script{_ATTRS}*+>(.*)</script\s*>$"


def _parse(pages: DataFrame, key: str, html: str, fields: Sequence[Field],
           item_tag: str | None) -> DataFrame:
    fields = tuple(fields)
    key_field = pages.schema[key]
    schema = T.StructType(
        [key_field, T.StructField("item_pos", T.IntegerType())]
        + [T.StructField(f.name, T.StringType()) for f in fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), PAGES_AT_ONCE):
                part = batch.iloc[low:low + PAGES_AT_ONCE]
                rows = [
                    {key: page_key, "item_pos": pos, **item}
                    for page_key, markup in zip(part[key], part[html])
                    for pos, item in enumerate(collect(markup, fields, item_tag))
                ]
                yield pd.DataFrame(rows, columns=names)
        give_back()

    small_batches(pages.sparkSession)
    return pages.select(key, html).mapInPandas(run, schema)


def with_card_defaults(cards: DataFrame) -> DataFrame:
    """Missing salary, link, logo and age get their default text."""
    return cards.withColumns({
        "salary": X.first_non_blank(F.col("salary"), F.lit(C.NO_SALARY)),
        "jobUrl": X.text(F.col("jobUrl")),
        "companyLogo": X.text(F.col("companyLogo")),
        "agoTime": X.text(F.col("agoTime")),
    })


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns are all non-empty."""
    for name in columns:
        df = df.filter(X.text(F.col(name)) != "")
    return df


def extract_cards(pages: DataFrame, key: str = "page_id", html: str = "html",
                  fields: Sequence[Field] = BOARD_CARD_FIELDS,
                  item_tag: str = "li") -> DataFrame:
    """One row per list item that has a position and a company.

    ``item_pos`` is the item's place on its page.
    """
    fields = tuple(fields)
    cards = _parse(pages, key, html, fields, item_tag)
    tidy = {f.name: X.trimmed(F.col(f.name)) for f in fields if f.attr is None}
    absent = set(n for n in ("salary", "jobUrl", "companyLogo", "agoTime", "location", "date")
                 if n not in cards.columns)
    tidy.update({n: F.lit(None).cast("string") for n in absent})
    cards = cards.withColumns(tidy).withColumn("salary", X.collapsed(F.col("salary")))
    return require(with_card_defaults(cards), "position", "company")


def extract_detail(pages: DataFrame, key: str = "page_id", html: str = "html",
                   containers: Sequence[str] = DETAIL_CONTAINERS) -> DataFrame:
    """Text of the first non-empty container, whitespace collapsed."""
    fields = tuple(Field(f"part_{i}", selector) for i, selector in enumerate(containers))
    parsed = _parse(pages, key, html, fields, None)
    raw = X.first_non_blank(*[F.col(f.name) for f in fields])
    return parsed.select(key, X.collapsed(raw).alias("description"))


def _texts(markup: pa.Array) -> pa.Array:
    """The text of every page of a batch; a few pages at a time are Python strings."""
    field = (Field("text"),)
    done = [pa.array([None if page is None else "".join(row["text"] for row in collect(page, field))
                      for page in markup.slice(low, PAGES_AT_ONCE).to_pylist()], pa.string())
            for low in range(0, len(markup), PAGES_AT_ONCE)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def html_text(col: Column) -> Column:
    """All text of a markup fragment, entities decoded, ends trimmed; null costs nothing and gives an empty text."""

    @F.arrow_udf(T.StringType())
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = 0
        for markup in batches:
            yield _texts(markup)
            seen += markup.nbytes
            if seen > GIVEN_BACK_AFTER:
                seen = 0
                give_back()
        give_back()

    return X.trimmed(whole(col))


def first_jsonld(html: Column, kind: str = "JobPosting") -> Column:
    """The first JSON-LD block of the wanted type as a variant, else null.

    Blocks that do not parse are skipped; of an array only the first element
    counts.  Everything stays in the row, so no shuffle is needed.
    """
    scripts = F.filter(F.regexp_extract_all(X.text(html), F.lit(SCRIPT_OR_COMMENT), F.lit(0)),
                       lambda s: s.rlike(JSONLD_SCRIPT))
    blocks = F.transform(scripts, lambda s: F.regexp_extract(s, SCRIPT_BODY, 1))

    def head(block: Column) -> Column:
        value = F.try_parse_json(block)
        return F.coalesce(F.try_variant_get(value, "$[0]", "variant"), value)

    def wanted(value: Column) -> Column:
        one = F.try_variant_get(value, '$["@type"]', "string")
        many = F.try_variant_get(value, '$["@type"]', "array<string>")
        return F.coalesce(one == kind, F.lit(False)) | F.coalesce(
            F.array_contains(many, kind), F.lit(False))

    return F.try_element_at(F.filter(F.transform(blocks, head), wanted), F.lit(1))


def posting_fields(posting: Column) -> dict[str, Column]:
    """Columns read from a posting block; absent and empty values are null."""
    def field(path: str) -> Column:
        return X.non_blank(F.try_variant_get(posting, path, "string"))

    places = F.transform(
        F.try_variant_get(posting, "$.jobLocation", "array<variant>"),
        lambda place: F.try_variant_get(place, "$.address.addressLocality", "string"))
    named = F.array_join(F.filter(places, lambda name: X.text(name) != ""), ", ")
    return {
        "company": field("$.hiringOrganization.name"),
        "title": field("$.title"),
        "posted_at": field("$.datePosted"),
        "location": F.coalesce(named, field("$.jobLocation.address.addressLocality")),
        "description": field("$.description"),
    }


def extract_jsonld(pages: DataFrame, key: str = "url", html: str = "html",
                   kind: str = "JobPosting") -> DataFrame:
    """One row per page that carries a posting block; description as plain text."""
    found = (
        pages.filter(X.contains_any(F.col(html), ("ld+json",)))
        .select(key, first_jsonld(F.col(html), kind).alias("posting"))
        .filter(F.col("posting").isNotNull())
        .select(key, *[c.alias(n) for n, c in posting_fields(F.col("posting")).items()])
    )
    small_batches(pages.sparkSession)
    body = F.col("description")
    # the parsing step runs for every row whatever condition stands around it, so it is given nulls
    marked = body.rlike("[<&]")
    parsed = html_text(F.when(marked, body))
    return found.withColumn("description", F.when(marked, parsed).otherwise(F.btrim(body, F.lit(X.SPACE_CHARS))))
