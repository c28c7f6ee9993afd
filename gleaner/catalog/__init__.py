"""Named queries over the given tables, each with its SQL counterpart."""

from gleaner.catalog import feeds, files, ledgers, postings, texts, webpages  # noqa: F401
from gleaner.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
