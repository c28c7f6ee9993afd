"""Whitening against the eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from gleaner.llm import whitening
from gleaner.llm.vectors import whole_vectors
from gleaner.session import Steps

FIELDS = "vec_id long, embedding array<float>, label int, component string, n int, x string"


def white(spark, rows, components=8):
    frame = spark.createDataFrame([(i, v, 1, "c", 2, "x") for i, v in rows], FIELDS).repartition(3)
    with Steps(spark, "test") as steps:
        return [tuple(r) for r in whitening.whiten(whole_vectors(frame, 1024), components, steps).collect()]


def whole(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    dims = max(len(v) for _, v in kept)
    padded = [list(v) + [0.0] * (dims - len(v)) for _, v in kept]
    return [i for i, _ in kept], [[math.floor(1024 * float(np.float32(e))) + 100_000 for e in v] for v in padded]


def compare(got, rows, components=8):
    ids, x = whole(rows)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > values[0] * 1e-12).sum()))
    want = centred @ vectors[:, :count] / np.sqrt(values[:count])
    deviations = [min(2**63 - 1, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    assert len(got) == n * count
    got = sorted(got, key=lambda r: (r[1], r[3], repr(r[0]), r[4]))
    for k in range(count):
        mine = [r for r in got if r[1] == k + 1]
        signed = min((1, -1), key=lambda s: np.abs(np.sort([r[4] for r in mine]) - np.sort(s * want[:, k])).sum())
        plain = sorted(zip([k + 1] * n, deviations, map(repr, ids), signed * want[:, k]), key=lambda r: (r[0], r[1], r[2], r[3]))
        assert [(r[1], r[3], repr(r[0])) for r in mine] == [r[:3] for r in plain]
        assert np.allclose([r[4] for r in mine], [r[3] for r in plain], rtol=0, atol=1e-8)
        assert all(r[2] == n and abs(r[5] / (values[k] / values.sum()) - 1) < 1e-9 and 0 <= r[6] < 1e-9 for r in mine)


@pytest.mark.parametrize("dims", [1, 5, 12])
def test_equals_the_eigenvectors(spark, dims):
    draw = np.random.default_rng(dims)
    x = draw.normal(size=(200, dims)) * np.linspace(2, 0.5, dims) + draw.normal(size=dims)
    rows = list(enumerate(x.tolist()))
    compare(white(spark, rows), rows)


def test_close_and_far_values(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 12)) * np.array([50, 50, 20, 1, 1, 1, 1, 1, 1, 0.05, 0.01, 0.01])
    rows = list(enumerate(x.tolist()))
    compare(white(spark, rows, 12), rows, 12)


def test_odd_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(60, 6)).tolist())]
    rows += [(None, [1.0] * 6), (5, rows[5][1]), (5, rows[5][1]), (70, None), (71, [1.0, None]), (72, [float("nan")] * 6),
             (73, [float("inf")] * 6), (74, [1.0, 2.0]), (75, [])]
    compare(white(spark, rows), rows)


def test_deviations_beyond_a_long(spark):
    draw = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((draw.normal(size=(40, 3)) * [3e8, 1, 1]).tolist())]
    got = white(spark, rows, 1)
    ids, x = whole(rows)
    sums = [sum(c) for c in zip(*x)]
    want = {i: min(2**63 - 1, sum((40 * a - s) ** 2 for a, s in zip(r, sums))) for i, r in zip(ids, x)}
    assert {r[0]: r[3] for r in got} == want


def test_fewer_values_than_dimensions(spark):
    base = np.random.default_rng(5).normal(size=(40, 2))
    rows = list(enumerate(np.column_stack([base, base.sum(1) * 0, np.zeros((40, 3))]).tolist()))
    compare(white(spark, rows), rows)
    few = list(enumerate(np.random.default_rng(7).normal(size=(3, 10)).tolist()))
    compare(white(spark, few), few)


def test_equal_eigenvalues(spark):
    rows = [(2 * i + k, [s if j == i else 0.0 for j in range(4)]) for i in range(4) for k, s in enumerate((4.0, -4.0))]
    got = white(spark, rows, 4)
    assert len(got) == 32 and all(abs(r[5] - 0.25) < 1e-12 and r[6] < 1e-9 for r in got)
    w = np.zeros((8, 4))
    for r in got:
        w[r[0], r[1] - 1] = r[4]
    assert np.allclose(w.T @ w / 8, np.eye(4), atol=1e-9)


def test_nothing_to_whiten(spark):
    assert white(spark, []) == white(spark, [(1, [1.0, 2.0])]) == white(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert white(spark, [(1, []), (2, [])]) == []
