import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleaner.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", shuffle_partitions=4, memory="6g",
                            **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def column(spark):
    """Evaluates a column builder over a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(build, values):
        rows = [(i, v) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, "i int, v string")
        return [r["out"] for r in frame.select("i", build(F.col("v")).alias("out"))
                .orderBy("i").collect()]

    return run
