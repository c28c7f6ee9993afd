"""Edge cases of the text, URL and rule expressions."""

from pyspark.sql import functions as F

from gleaner import config as C
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.functions import urls as U

ALLOWED = [
    "0-2 years", "0 to 2 years", "2 years minimum", "min 2 years", "20 years", "20+ years",
    "at least 20 years", "3 to 20 years", "1to3 years", "3months", "6 months", "five years", "",
    "x3 years", "3 yearsx",
]
REJECTED = [
    "5 years", "15 yrs", "2+ years", "3+years", "min3 years", "1 to 3 years", "1-3 years",
    "3-20 years", "1t5 years", "1o3 years", "fresher, 4 years", "5 YEARS", "5\u00a0years",
    "2 or more yr", "experience: 7 yrs", "é5 years",
]


def test_experience(column):
    assert column(R.experience_allowed, ALLOWED) == [True] * len(ALLOWED)
    # "1 to 3 years" is turned away for its "3 years", not for the range
    assert column(R.experience_allowed, REJECTED) == [False] * len(REJECTED)


def test_experience_prefilter_changes_nothing(column):
    texts = ALLOWED + REJECTED
    plain = column(lambda c: R.experience_allowed(c, list(C.EXPERIENCE_REJECT_PATTERNS)), texts)
    assert plain == column(R.experience_allowed, texts)


SKILL_SUBSET = ("java", "c", "c++", "spring", "spring boot", "node", "rest", "rest api", "git",
                "github", "javascript", "html", "sql", "mysql", "testing")
SKILL_CASES = {
    "C++ and Java": ["java", "c"],
    "c++11": ["c", "c++"],
    "C# dev": ["c"],
    "Node.js, REST API": ["node", "rest", "rest api"],
    "take a rest": ["rest"],
    "JavaScript/HTML5": ["javascript"],
    "spring boot": ["spring", "spring boot"],
    "éc": ["c"],
    "github": ["github"],
    "c++": ["c"],
    "rest  api": ["rest"],
    "": [],
}


def test_skills(column):
    got = column(lambda c: X.vocabulary_hits(c, SKILL_SUBSET), SKILL_CASES)
    assert got == list(SKILL_CASES.values())


def test_phones(column):
    cases = {
        "98765 43210": ["+919876543210"],
        "+91-98765-43210": ["+919876543210"],
        "919876543210": ["+919876543210"],
        "+91 9876543210 / 9876543210": ["+919876543210"],
        "+1 9876543210": ["+919876543210"],
        "4994226020900891": ["+916020900891"],
        "98765432101": ["+918765432101"],
        "1234567890": [],
        "9876543210x": [],
        "98765\u00a043210": ["+919876543210"],
    }
    assert column(X.phones, cases) == list(cases.values())


def test_emails(column):
    cases = {
        "A@b.co, a@b.co A@b.co": ["A@b.co", "a@b.co"],
        "hr@x.com.": ["hr@x.com"],
        "x@y": [], "a@b.c1": [], "": [],
    }
    assert column(X.emails, cases) == list(cases.values())


def test_job_id(column):
    cases = {
        "https://x/jobs/view/java-dev-at-acme-3912345678?position=1": "3912345678",
        "https://x/jobs/view/3912345678": None,
        "https://x/jobs/view/dev-3912345678?ref=abc-7654321": "7654321",
        "https://x/jobs/search?currentJobId=555555": "555555",
        "https://x/view/dev-12345": None,
        "https://x/view/dev-123456/apply": "123456",
        "": None,
    }
    assert column(U.job_id, cases) == list(cases.values())


def test_canonical(column):
    cases = {
        "HTTPS://Jobs.Example.COM:443/A/b/?q=1#x": "https://jobs.example.com/A/b",
        "http://h:80": "http://h",
        "http://h:8080/a//": "http://h:8080/a/",
        "https://h": "https://h",
        "https://h/": "https://h",
        " https://h/a?b ": "https://h/a",
        "https://User@H/a": "https://User@h/a",
        "not a url?x#y": "not a url?x#y",
        "mailto:A@b.c?subject=x": "mailto:A@b.c",
        "https://": "https://",
        "FTP://Files.x:21/a/?q": "ftp://files.x/a",
        "wss://h:443/s": "wss://h/s",
        "App://Open/Here/?q=1": "app://Open/Here",
        "": "",
    }
    assert column(U.canonical, cases) == list(cases.values())


def test_host(column):
    cases = {
        "https://WWW.Example.com:8080/x": "www.example.com", "https://a_b.c/x y|z": "a_b.c",
        "ex.com/x": "", "": "", "https://u:p@h.io?x": "h.io", "http://h#f": "h",
        "ftp://F.x/a": "f.x",
    }
    assert column(U.host, cases) == list(cases.values())


def test_urls_and_slug(column):
    assert column(U.without_query, ["a?b?c", "a#f", ""]) == ["a", "a#f", ""]
    assert column(U.without_www, ["www.a.b", "awww.a", "www.www.a"]) == ["a.b", "awww.a", "www.a"]
    assert column(X.slug, [" A--b! C ", "", "é"]) == ["a b c", "", ""]
    assert column(lambda c: U.posting_key(F.lit(None), c, F.lit("T x")), ["Acme|"]) == ["acme t x"]


def test_whitespace(column):
    assert column(X.collapsed, ["\u00a0a \t\n b\ufeff", "\u2003x"]) == ["a b", "x"]
    assert column(X.trimmed, ["\u00a0 a b \u3000"]) == ["a b"]


def test_cleaned_length(column):
    exact, longer = "x" * 1500, "y" * 1501
    got = column(X.cleaned, [exact, longer, None])
    assert got == [exact, "y" * 1499 + "…", ""]


def test_token_is_one_line(column):
    import base64
    import json

    title = "Dév \"x\" / " + "long " * 40
    token = column(lambda c: U.posting_token(c, F.lit("Acme"), F.lit("https://h/a")), [title])[0]
    assert "\n" not in token and "\r" not in token
    body = base64.b64decode(token).decode()
    assert body == json.dumps({"job_title": title, "company_name": "Acme", "url": "https://h/a"},
                              ensure_ascii=False, separators=(",", ":"))


def test_title_rules(column):
    titles = ["Software Engineer", "Senior Software Engineer", "Leadership software developer",
              "Chef", "", None, "QA ENGINEER II"]
    assert column(R.title_likely_match, titles) == [True, False, False, False, False, False, True]


def test_role_is_first_in_list_order(column):
    got = column(lambda c: X.first_match([c], [t.lower() for t in C.BOARD_TITLES]),
                 ["Junior Software Engineer", "nothing"])
    assert got == ["software engineer", ""]


def test_role_matches_description(spark):
    rows = spark.createDataFrame(
        [("Chef", "wanted: java developer"), ("Senior Chef", "java developer")], "t string, d string")
    got = [r[0] for r in rows.select(R.role_matches(F.col("t"), F.col("d"))).collect()]
    assert got == [True, False]


def test_places(spark):
    rows = spark.createDataFrame([
        (1, "Pune, India", "x", None), (2, "REMOTE", "x", ""), (3, "Rome", "Remote dev", ""),
        (4, "Rome", "dev", "Work  from\u00a0home"), (5, None, None, None),
        (6, "Rome", "dev", "WFH ok"), (7, "Rome", "dev", "work at the office"),
    ], "i int, l string, t string, d string")
    c = F.col
    got = rows.select(
        R.place_or_remote_quick(c("l"), c("t")).alias("q"),
        R.place_or_remote(c("l"), c("t"), c("d")).alias("f"),
        R.remote_label(c("l"), c("d")).alias("r")).collect()
    assert [r["q"] for r in got] == [True, True, True, False, False, False, False]
    assert [r["f"] for r in got] == [True, True, True, True, False, True, False]
    # the title does not make a posting remote
    assert [r["r"] for r in got] == ["No", "Yes", "No", "Yes", "No", "Yes", "No"]


def test_blocked_and_career(column):
    urls = ["https://in.indeed.com/jobs/x", "https://sunshine.org/a", "https://ok.com/a", "junk"]
    assert column(R.is_blocked, urls) == [True, True, False, False]
    urls = ["https://boards.greenhouse.io/a", "https://x.com/Careers/1", "https://x.com/job/1",
            "https://x.com/careers", "https://a.myworkdayjobs.com/x", None]
    assert column(R.is_career_url, urls) == [True, True, True, False, False, False]


def test_tokens(spark):
    rows = spark.createDataFrame([
        ("International desk", ""), ("Intern", "go ahead"), ("Chef", "junior"),
        ("Trainee sr. dev", ""), (None, None)], "t string, s string")
    got = [r[0] for r in rows.select(R.tokens_ok(F.col("t"), F.col("s"))).collect()]
    assert got == [True, False, True, False, False]


def test_count_coercion(column):
    assert column(X.as_count, ["12", "x", "", None]) == [12, 0, 0, 0]
    assert column(X.plus_joined, ["  a  b c "]) == ["a+b+c"]


def test_occurrences(column):
    assert column(lambda c: X.occurrences(c, "aa"), ["aaaa A aa", "", None]) == [3, 0, 0]


def test_emails_that_touch(column):
    """The quick scan finds what the plain pattern finds, also where one match follows another directly."""
    import random
    import re

    plain = re.compile(X.EMAIL_PATTERN)
    r = random.Random(1)
    texts = ["a@b.co1x@y.zz", "a@b.coc@d.ef", "@a@b.cd", "a@b@c.de", "x.y+z@h-1.example.comfoo@bar.de,"] + [
        "".join(r.choice("ab1.@- ") for _ in range(60)) + "@c.de" for _ in range(300)]
    assert column(X.emails, texts) == [list(dict.fromkeys(plain.findall(t))) for t in texts]


def test_emails_in_linear_time(column):
    import time

    column(X.emails, ["warm@up.de"])
    started = time.time()
    assert column(X.emails, ["a" * 1_000_000 + " x@y", "z@" + "b" * 1_000_000, "@" + "a." * 300_000]) == [[], [], []]
    assert time.time() - started < 5


def test_paths_in_canonical_urls(column):
    pairs = {
        "https://h/a/../b/": "https://h/b", "https://h/a/./b": "https://h/a/b", "https://h/../..": "https://h",
        "https://h/a/b/..": "https://h/a", "https://h/a/%2E%2e/c?x": "https://h/c", "https://h/a b": "https://h/a%20b",
        "https://h/caf\u00e9": "https://h/caf%C3%A9", "https://h/a%20b": "https://h/a%20b", "https://h/a..b/.c": "https://h/a..b/.c",
        "https://h/a//b": "https://h/a//b", "https://h/x/.": "https://h/x", "https://h/\"q\"": "https://h/%22q%22"}
    assert column(U.canonical, list(pairs)) == list(pairs.values())


def test_plain_urls_keep_their_canonical_form(column, monkeypatch):
    """The short way for plain URLs gives what the general one gives, on plain and on odd ones."""
    heads = ("https://h.example-1.org", "http://H.org", "https://h:443", "ftp://h", "https://u@h", "https:/h", "h.org", "https://h_h", "")
    tails = ("", "/", "//", "/a//", "/a/b/?q=1#f", "/a/#f?q", "?q", "#f", "/./a", "/a/..", "/a/..?x", "/.a/..b", "/a%20b", "/a b",
             "/a;b=c,d:e@f!$&'()*+", "/[x]|~", "/a\\b", "/a^b", "/\u00e9", "/a\nb", "/a\u0085", "/...", "/a/.", "\\a")
    urls = [h + t for h in heads for t in tails]
    short = column(U.canonical, urls)
    plain = column(lambda c: c.rlike(U.PLAIN_URL_PATTERN), urls)
    assert 10 < sum(plain) < len(urls) / 2
    monkeypatch.setattr(U, "PLAIN_URL_PATTERN", "(?!)")
    assert short == column(U.canonical, urls)
