"""Every registered query against its SQL counterpart."""

import subprocess
import sys
from pathlib import Path

import pytest

from gleaner.catalog import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import canonical, connect  # noqa: E402


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, folder, database, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = database.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = canonical(got), canonical(want)
    assert left.equals(right)


def test_order_of_sorted_queries(spark, folder, database):
    got = [r["seq"] for r in QUERIES["sort_recent"](spark, folder).collect()]
    assert got == [r[0] for r in database.execute(SQL["sort_recent"]).fetchall()]
    both = [(r["source_rank"], r["seq"]) for r in QUERIES["ordered_union"](spark, folder).collect()]
    assert both == sorted(both) and len({rank for rank, _ in both}) == 2


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry_file

    rows = entry_file.entry(spark).collect()
    assert rows and set(entry_file.oracle_sql()) <= set(entry_file.queries())


def test_tasks_need_no_copy_of_the_package(folder, tmp_path):
    """Python workers started elsewhere cannot import the package and must not have to."""
    tool = Path(__file__).resolve().parents[1] / "tools" / "compare.py"
    done = subprocess.run([sys.executable, str(tool), folder, "card_extract", "jsonld_extract"],
                          cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:]
