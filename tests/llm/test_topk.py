"""Exact search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import topk
from gleaner.llm.vectors import whole_vectors
from gleaner.session import Steps

FIELDS = "vec_id long, embedding array<float>, label int, x string, query int, rank int, score string"


def brute(rows, scale, k, every):
    """Best (score, id) lists by query row, in the order of the rows."""
    whole = [(i, [math.floor(scale * float(np.float32(e))) for e in v]) for i, v in rows
             if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for q, x in whole:
        if q is None or q % every:
            continue
        found = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c is None, c or 0)
                       for c, y in whole if c != q)
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(found[:k])]
    return out


def search(spark, rows, k=5, every=4):
    frame = spark.createDataFrame([(i, v, 1, "x", 2, 3, "s") for i, v in rows], FIELDS).repartition(5)
    with Steps(spark, "test") as steps:
        vectors = whole_vectors(frame, 64)
        return [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % every == 0, k, steps).collect()]


def vectors(n, dims, seed, groups=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dims))
    return [[float(np.float32(e)) for e in centres[i % groups] + 0.4 * draw.normal(size=dims)] for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 48])
def test_equals_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_TILE", 16)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rows = list(enumerate(vectors(260, dims, dims)))
    assert sorted(search(spark, rows)) == sorted(brute(rows, 64, 5, 4))


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "PASS_ROWS", 20)
    rows = list(enumerate(vectors(300, 16, 1)))
    assert sorted(search(spark, rows)) == sorted(brute(rows, 64, 5, 4))


def test_odd_vectors(spark):
    good = vectors(40, 8, 2)
    rows = [*enumerate(good), (None, good[3]), (100, None), (104, [1.0, None]), (108, [float("nan")] * 8),
            (112, [float("inf")] + [0.0] * 7), (116, []), (120, good[0][:3]), (124, [3e38] * 8), (125, [-3e38] * 8),
            (126, [2.5e9, 1.0, 0.0]), (128, [2.5e9, -1.0, 2.0])]
    rows += [(i, good[5]) for i in range(200, 230)]  # ties
    assert sorted(search(spark, rows), key=repr) == sorted(brute(rows, 64, 5, 4), key=repr)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [*enumerate(vectors(20, 4, 3)), (4, [1.0, 2.0, 0.5, 0.0]), (7, [1.0, 2.0, 0.5, 0.0]), (7, [1.0, 2.0, 0.5, 0.0])]
    assert sorted(search(spark, rows)) == sorted(brute(rows, 64, 5, 4))


def test_few_or_no_rows(spark):
    assert search(spark, []) == [] and search(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert search(spark, [(0, [1.0]), (2, [2.0])]) == [(0, 1, 2, 64 * 128)]


def test_bounds_hold_and_tighten():
    draw = np.random.default_rng(5)
    a, b = np.floor(64 * draw.normal(size=(50, 40))), np.floor(64 * draw.normal(size=(60, 40)))
    product, last = a @ b.T, np.inf
    for s in topk.SEGMENTS:
        bound = topk.features(a, s) @ topk.features(b, s).T
        assert (bound >= product - 1e-6).all()
        assert bound.sum() < last
        last = bound.sum()
