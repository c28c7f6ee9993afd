"""URL and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as X

# Where a posting number stands in a URL
VIEW_ID_PATTERN = r"/view/[^/]*-(\d{6,})"
CURRENT_ID_PATTERN = r"currentJobId=(\d{6,})"

# scheme, user info, host, port, path; query and fragment fall off the end
WEB_URL_PATTERN = (
    r"^(?i:(https?|ftp|wss?))://([^/?#\\]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#\\@:\[\]<>^|% \t\r\n]+)"
    r"(?::(\d*))?(/[^?#]*)?(?:[?#].*)?$"
)
OTHER_URL_PATTERN = r"^(?!(?i:https?|ftp|wss?):)([A-Za-z][A-Za-z0-9+.-]*:)([^?#]*)(?:[?#].*)?$"
# Web URLs that only lose query, fragment and one slash: a plain host, no port, and a path without
# percent signs, dot segments and characters to escape.
PLAIN_URL_PATTERN = (
    r"^https?://[a-z0-9.-]++(?:/(?!\.{1,2}(?:[/?#]|\z))[!$&-.0-;=@-\[\]_a-z|~]*+)*+(?:[?#]|\z)"
)
DEFAULT_PORTS = ("http:80", "https:443", "ftp:21", "ws:80", "wss:443")
DOTALL = "(?s)"


def job_id(url: Column) -> Column:
    """Posting number in the URL, or null."""
    u = X.text(url)
    return F.coalesce(
        X.non_blank(F.regexp_extract(u, VIEW_ID_PATTERN, 1)),
        X.non_blank(F.regexp_extract(u, CURRENT_ID_PATTERN, 1)),
    )


def without_query(url: Column) -> Column:
    """Everything before the first question mark; a fragment stays."""
    return F.substring_index(X.text(url), "?", 1)


def host(url: Column) -> Column:
    """Lower-case host name, empty when the URL cannot be read."""
    return F.lower(F.regexp_extract(X.trimmed(url), DOTALL + WEB_URL_PATTERN, 3))


DOT_SEGMENT = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"
UNSAFE_IN_PATH = r"""[^!#-;=?-\[\]_a-z|~]"""  # what a path may only hold as percent escapes


def _path(path: Column) -> Column:
    """Dot segments worked off and unsafe characters escaped, on the few paths that have any."""
    def step(done: Column, part: Column) -> Column:
        name = F.regexp_replace(part, r"(?i)%2e", ".")
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(name == "..", up).when(name == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    short = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a path that ends in a dot segment ends in a slash
    ends = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}$"), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(short, "/"), F.when(F.size(short) > 0, ends).otherwise(""))
    plain = F.when(path.rlike(DOT_SEGMENT), joined).otherwise(path)
    escaped = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(
        c.rlike(UNSAFE_IN_PATH), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(plain.rlike(UNSAFE_IN_PATH), escaped).otherwise(plain)


def canonical(url: Column) -> Column:
    """URL without query, fragment, default port and one trailing slash.

    Scheme and host are lower-cased.  Text that is no URL is only trimmed.
    Dot segments and percent escapes are left as they are.
    """
    u = X.trimmed(url)
    pattern = DOTALL + WEB_URL_PATTERN

    def part(n: int) -> Column:
        return F.regexp_extract(u, pattern, n)

    scheme = F.lower(part(1))
    port = part(4)
    default = F.concat(scheme, F.lit(":"), port).isin(*DEFAULT_PORTS)
    web = F.concat(
        scheme, F.lit("://"), part(2), F.lower(part(3)),
        F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.regexp_replace(_path(part(5)), "/$", ""),
    )
    other_pattern = DOTALL + OTHER_URL_PATTERN
    other = F.concat(
        F.lower(F.regexp_extract(u, other_pattern, 1)),
        F.regexp_replace(F.regexp_extract(u, other_pattern, 2), "/$", ""),
    )
    cut = F.substring_index(F.substring_index(u, "?", 1), "#", 1)
    return (F.when(u.rlike(PLAIN_URL_PATTERN), F.regexp_replace(cut, "/$", ""))
            .when(u.rlike(pattern), web).when(u.rlike(other_pattern), other).otherwise(u))


def without_www(name: Column) -> Column:
    return F.regexp_replace(X.text(name), r"^www\.", "")


def posting_key(url: Column, company: Column, title: Column) -> Column:
    """Identity of a posting: its number, else its URL, else company and title."""
    pair = X.slug(F.concat(X.text(company), F.lit("|"), X.text(title)))
    return F.coalesce(job_id(url), X.non_blank(without_query(url)), pair)


def company_title_slug(company: Column, title: Column) -> Column:
    return F.concat(X.slug(company), F.lit("|"), X.slug(title))


def company_title_pair(company: Column, title: Column) -> Column:
    return F.concat(
        F.btrim(F.lower(X.text(company)), F.lit(X.SPACE_CHARS)), F.lit("|"),
        F.btrim(F.lower(X.text(title)), F.lit(X.SPACE_CHARS)),
    )


def posting_token(title: Column, company: Column, url: Column) -> Column:
    """Base64 of a compact JSON object; one line, whatever the session's chunking."""
    body = F.to_json(F.struct(
        X.text(title).alias("job_title"), X.text(company).alias("company_name"),
        X.text(url).alias("url"),
    ))
    return F.translate(F.base64(F.encode(body, "UTF-8")), "\r\n", "")
