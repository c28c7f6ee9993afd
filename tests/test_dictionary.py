"""Dictionary terms in texts against plain substring search."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import dictionary
from gleaner.operators.dictionary import match_substrings

TERMS = ["java", "c", "c++", "ok", "xyz", "rest api", "größe", "GRÖSSE", "日本", "ring", "a\\E b", "", None, "java", "not there at all"]
TEXTS = ["JavaScript and C++", "ok", "oK then", "o k", "spring", "strings ring", "REST API's", "übergröße", "in 日本語", "日", "", None,
         "ja va", "jav", "a\\e b", "xy", "xyzxyz", "grösse"]


def plain(rows, terms):
    return sorted((i, t) for i, text in rows for t in {t for t in terms if t} if text and t.lower() in text.lower())


@pytest.mark.parametrize("slice_bytes", [4 << 20, 1])
def test_equals_plain_search(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(dictionary, "SLICE_BYTES", slice_bytes)
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "i int, body string, term string, gram int").repartition(2)
    vocab = spark.createDataFrame([(t, 1) for t in TERMS], "term string, n int")
    assert sorted(map(tuple, match_substrings(frame, "i", "body", vocab).collect())) == plain(rows, TERMS)


def test_random_terms(spark):
    draw = random.Random(5)
    rows = [(f"r{i}", "".join(draw.choice("abc ") for _ in range(draw.randint(0, 60)))) for i in range(200)]
    terms = ["".join(draw.choice("abc ") for _ in range(draw.randint(1, 7))) for _ in range(150)]
    frame = spark.createDataFrame(rows, "i string, body string").repartition(3)
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    assert sorted(map(tuple, match_substrings(frame, "i", "body", vocab).collect())) == plain(rows, terms)


def test_nothing_to_look_for(spark):
    frame = spark.createDataFrame([(1, "text")], "i int, body string")
    vocab = spark.createDataFrame([("", ), (None,)], "term string")
    assert match_substrings(frame, "i", "body", vocab).count() == 0
    assert match_substrings(frame.limit(0), "i", "body", spark.createDataFrame([("text",)], "term string")).count() == 0


def test_no_cross_join(spark):
    frame = spark.createDataFrame([(1, "some text")], "i int, body string")
    found = match_substrings(frame, "i", "body", spark.createDataFrame([("text",), ("ome",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(r["term"] for r in found.select(F.col("term")).collect()) == ["ome", "text"]
