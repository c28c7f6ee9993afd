"""Row shapes shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# ---------------------------------------------------------------------------
# Column names and their order, and the accepted spellings
# ---------------------------------------------------------------------------

CARD_COLUMNS = (
    "position", "company", "location", "date", "salary", "jobUrl", "companyLogo", "agoTime",
)

UNIFIED_COLUMNS = (
    "li_job_id", "company", "title", "matched_role", "location", "is_remote",
    "date_posted", "ago_time", "salary", "job_url",
    "contact_emails", "contact_phones", "skills", "description",
)

WEB_COLUMNS = (
    "source", "g_job_id", "company", "title", "location", "posted_at", "via", "job_url",
    "description",
)

COLUMN_ALIASES = {
    "li_job_id": ("li_job_id", "job_id", "id"),
    "company": ("company", "company_name", "org", "employer"),
    "title": ("title", "job_title", "position"),
    "matched_role": ("matched_role", "role", "standard_title"),
    "location": ("location", "job_location", "city"),
    "is_remote": ("is_remote", "remote", "remote_friendly"),
    "date_posted": ("date_posted", "posted_at", "date"),
    "ago_time": ("ago_time", "posted_ago"),
    "salary": ("salary", "compensation", "pay"),
    "job_url": ("job_url", "url", "link", "href"),
    "contact_emails": ("contact_emails", "emails"),
    "contact_phones": ("contact_phones", "phones"),
    "skills": ("skills", "skills_hint"),
    "description": ("description", "desc", "snippet", "summary"),
}

# ---------------------------------------------------------------------------

CARD = _strings(*CARD_COLUMNS)
UNIFIED = _strings(*UNIFIED_COLUMNS)
WEB_ROW = _strings(*WEB_COLUMNS)

HIT = _strings("link", "title", "snippet", "displayLink")

HITS_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(HIT)),
    T.StructField("searchInformation", _strings("totalResults")),
])

# Where a row stands in landed files: file, start of the split, place in the scan, item on the page.
PLACE = T.StructType([
    T.StructField("file", T.StringType(), False), T.StructField("start", T.LongType(), False),
    T.StructField("pos", T.LongType(), False), T.StructField("item", T.LongType(), False),
])
