"""Vocabularies and settings.

Every operator takes its vocabulary as an argument; the tuples below are the
defaults.  Order is part of the meaning: the first match in list order wins
wherever one value is picked.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

BOARD_TITLES = (
    "Software Engineer", "Software Developer",
    "Junior Software Engineer", "Junior Software Developer",
    "Associate Software Engineer", "Associate Software Developer",
    "Java Developer", "Junior Java Developer",
    "Python Developer", "Graduate Engineer Trainee", "Software Trainee", "Junior Developer",
    "Software Development Intern",
    "Backend Engineer", "Frontend Engineer", "Full Stack Engineer",
    "Software Testing", "QA Engineer", "Trainee Engineer",
)

NEGATIVE_TITLE_WORDS = ("senior", "lead", "staff", "principal", "architect", "manager", "sr.")

SKILLS = (
    "java", "python", "golang", "c", "c++", "javascript", "typescript",
    "spring", "spring boot", "hibernate",
    "html", "css", "react", "angular", "node", "express",
    "sql", "mysql", "postgres", "mongodb",
    "git", "github", "rest", "rest api", "microservices",
    "docker", "kubernetes", "aws", "gcp", "azure",
    "testing", "selenium", "jest", "pytest",
)

WEB_ROLES = (
    "Junior Java Developer", "Junior Software Developer", "Junior Developer",
    "Graduate Engineer Trainee", "Software Trainee", "QA Engineer", "QA Tester",
    "Frontend Engineer", "Backend Engineer", "Full Stack Engineer", "Python Developer",
)

BLOCKED_DOMAINS = (
    "linkedin.", "indeed.", "naukri.", "glassdoor.", "shine.", "bayt.", "adzuna.", "apna.",
    "prosple.", "instahyre.", "cutshort.", "angel.co", "wellfound", "timesjobs.", "foundit.",
    "monster.", "ziprecruiter.", "remoterocketship.",
)

CAREER_SITES = (
    "site:boards.greenhouse.io", "site:jobs.lever.co", "site:*.myworkdayjobs.com",
    "site:jobs.ashbyhq.com", "site:smartrecruiters.com", "site:jobs.icims.com",
    "site:*.taleo.net", "site:*.successfactors.com", "site:*.oraclecloud.com",
    "site:apply.workable.com", "site:*.bamboohr.com", "site:*.recruitee.com",
    "site:jobs.jobvite.com", "site:*.pinpoint.xyz", "site:*.teamtailor.com",
    "site:*.breezy.hr", "site:*.eightfold.ai",
    "inurl:/careers/", "inurl:/career/", "inurl:/jobs/", "inurl:/job/",
)

CAREER_PATH_PATTERN = r"/careers?/|/jobs?/"

INCLUDE_TOKENS = (
    "fresher", "freshers", "graduate", "trainee", "entry level", "entry-level",
    "0-1 year", "0 to 1 year", "0–1 year", "0 — 1 year",
    "0-2 year", "0 to 2 year", "0–2 year", "0 — 2 year",
    "junior", "intern",
)

EXCLUDE_TOKENS = (
    "senior", "sr.", "sr ", "lead", "principal", "architect", "manager", "head", "director",
    " engineer ii", " engineer iii", " engineer iv", " ii -", " iii -", " iv -",
    " mid level", "mid-level", "staff",
)

REMOTE_WORDS = ("remote", "wfh")
HOME_PATTERN = r"work\s*from\s*home"

# A posting is turned away when any of these matches its lower-cased text.
# `[-–to]` is one character out of four, not the word "to".
EXPERIENCE_REJECT_PATTERNS = (
    r"\b2\s*(\+|plus|or\s*more|and\s*above|min(imum)?|at\s*least)\s*(year|yr|yrs|years)\b",
    r"\b1\s*[-–to]\s*[3-9]\s*(year|yr|yrs|years)\b",
    r"\b([3-9]|1[0-9])\s*(\+|plus)?\s*(year|yr|yrs|years)\b",
    r"\b(min|minimum|at\s*least)\s*([3-9]|1[0-9])\s*(year|yr|yrs|years)\b",
    r"\b([3-9]|1[0-9])\s*-\s*\d+\s*(year|yr|yrs|years)\b",
    r"\bexperience\s*[:\-]?\s*([3-9]|1[0-9])\s*(year|yr|yrs|years)\b",
)

YEAR_UNITS = ("year", "yr")  # every pattern above asks for one of these

DATE_WINDOW_CODES = {"past month": "r2592000", "past week": "r604800", "24hr": "r86400"}
EXPERIENCE_CODES = {
    "internship": "1", "entry level": "2", "associate": "3",
    "senior": "4", "director": "5", "executive": "6",
}
JOB_TYPE_CODES = {
    "full time": "F", "full-time": "F", "part time": "P", "part-time": "P",
    "contract": "C", "temporary": "T", "volunteer": "V", "internship": "I",
}
REMOTE_CODES = {"on-site": "1", "on site": "1", "remote": "2", "hybrid": "3"}
SALARY_CODES = {"40000": "1", "60000": "2", "80000": "3", "100000": "4", "120000": "5"}
SORT_CODES = {"recent": "DD", "relevant": "R"}

BOARD_PAGE_ROWS = 25
WEB_PAGE_ROWS = 10
DESCRIPTION_CHARS = 1500
WEB_SOURCE = "google_jobs"
NO_SALARY = "Not specified"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Settings of one curation run."""

    titles: tuple[str, ...] = BOARD_TITLES
    negative_words: tuple[str, ...] = NEGATIVE_TITLE_WORDS
    skills: tuple[str, ...] = SKILLS
    places: tuple[str, ...] = ("india",)
    experiences: tuple[str, ...] = ("internship", "entry level", "associate")
    soft_dedupe: bool = False
    incremental: bool = False

    roles: tuple[str, ...] = WEB_ROLES
    blocked_domains: tuple[str, ...] = BLOCKED_DOMAINS
    career_sites: tuple[str, ...] = CAREER_SITES
    career_path: str = CAREER_PATH_PATTERN
    include_tokens: tuple[str, ...] = INCLUDE_TOKENS
    exclude_tokens: tuple[str, ...] = EXCLUDE_TOKENS
    pages_per_role: int = 2
    out_csv: str = "google_jobs.csv"

    @property
    def role_phrases(self) -> tuple[str, ...]:
        return tuple(t.lower() for t in self.titles)

    @classmethod
    def from_mapping(cls, settings: Mapping[str, str]) -> Config:
        """Overrides by name, e.g. from ``os.environ``; blank values are ignored."""
        found = {k: v for k, v in settings.items() if v}
        changes: dict = {}
        if "ROLES" in found:
            changes["roles"] = tuple(r.strip() for r in found["ROLES"].split(",") if r.strip())
        if "MAX_PAGES_PER_ROLE" in found:
            changes["pages_per_role"] = int(found["MAX_PAGES_PER_ROLE"])
        if "OUT_CSV" in found:
            changes["out_csv"] = found["OUT_CSV"]
        return replace(cls(), **changes)


BEYOND = 1e18  # read for larger numbers; no table has so many rows


def number(value) -> float:
    """Numeric reading of an option; anything unreadable, and anything below 0, counts as 0."""
    try:
        found = float(value or 0)
    except (TypeError, ValueError):
        return 0.0
    written = not isinstance(value, str) or set(value.strip()) <= set("0123456789+-.eE")
    return min(max(found, 0.0), BEYOND) if written and found == found else 0.0


@dataclass(frozen=True)
class Criteria:
    """Options of one postings search; a blank option does not filter."""

    keyword: str = ""
    location: str = ""
    date_since_posted: str = ""
    job_type: str = ""
    remote_filter: str = ""
    salary: str = ""
    experience_level: str = ""
    sort_by: str = ""
    limit: str | int = 0
    page: str | int = 0
    has_verification: bool = False
    under_10_applicants: bool = False

    @property
    def row_limit(self) -> int:
        return int(number(self.limit))

    @property
    def row_offset(self) -> int:
        return int(min(number(self.page) * BOARD_PAGE_ROWS, BEYOND))

    @property
    def snapshot_key(self) -> str:
        """Name under which a result is kept: all codes, the offset and the limit."""
        def plus(text: str) -> str:
            return "+".join(text.split())

        return "|".join(map(str, (
            plus(self.keyword), plus(self.location), DATE_WINDOW_CODES.get(self.date_since_posted.lower(), ""),
            SALARY_CODES.get(str(self.salary), ""), self.experience_code, self.remote_code, self.job_type_code,
            str(bool(self.has_verification)).lower(), str(bool(self.under_10_applicants)).lower(),
            self.row_offset, SORT_CODES.get(self.sort_by, ""), self.row_limit)))

    @property
    def window_seconds(self) -> int | None:
        code = DATE_WINDOW_CODES.get(self.date_since_posted.lower())
        return int(code[1:]) if code else None

    @property
    def salary_floor(self) -> int | None:
        return int(self.salary) if str(self.salary) in SALARY_CODES else None

    @property
    def experience_code(self) -> str:
        return EXPERIENCE_CODES.get(self.experience_level.lower(), "")

    @property
    def job_type_code(self) -> str:
        return JOB_TYPE_CODES.get(self.job_type.lower(), "")

    @property
    def remote_code(self) -> str:
        return REMOTE_CODES.get(self.remote_filter.lower(), "")
