import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maintspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>"


def held(got, rows, most=4, close=1e-8):
    """Holds the result against the covariance's own eigenvectors."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[float(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, int((e > e[0] * 1e-14).sum()))
    assert len(got) == k * len(rows)
    for m in range(k):
        mine = {r["vec_id"]: r for r in got if r["component"] == m + 1}
        assert set(mine) == set(x)
        want = {i: float(np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)]) @ w[:, m] / math.sqrt(e[m])) for i, v in x.items()}
        assert min(max(abs(mine[i]["whitened"] - sign * want[i]) for i in x) for sign in (1, -1)) < close
        for i, r in mine.items():
            exact = sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
            assert r["deviation"] == (exact if exact < 2**63 else None)
            assert r["n"] == n
            assert abs(r["explained"] / (e[m] / e.sum()) - 1) < 1e-6
            assert r["identity_error"] < 1e-9


def test_equals_the_covariances_eigenvectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held(W.op11_whitening(df.repartition(5)).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_ill_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 7)) * [1e4, 1e2, 10, 1, 0.1, 0, 0]
    a[:, 5], a[:, 6] = a[:, 0], 3.0
    rows = [(i, r.tolist()) for i, r in enumerate(a)]
    held(W.op11_whitening(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_repeats_count_once_and_bad_vectors_go(spark):
    rows = [(i, [float(i % 3), float(i % 2), 0.5]) for i in range(12)] + [(90, [0.001, 0.002, 0.5])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [math.nan, 1.0, 1.0]), (53, [1.0, -math.inf, 1.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumns({n: F.lit("x") for n in ("id", "key", "size", "v", "label", "n")})
    got = W.op11_whitening(df).collect()
    held(got, rows)  # 90 falls on (0, 0, 128) with 0 and 6
    assert got[0]["n"] == 6


def test_few_vectors(spark):
    make = lambda *v: W.op11_whitening(spark.createDataFrame(list(enumerate(v)), SCHEMA)).collect()
    assert make() == []
    assert make(None, []) == []
    assert make([1.0, 2.0]) == []
    assert make([1.0], [1.0]) == []
    two = make([0.0, 0.0], [1.0, 1.0])
    assert sorted(round(abs(r["whitened"]), 9) for r in two) == [1.0, 1.0]
    assert {r["deviation"] for r in two} == {2 * 256 * 256}
    # a shorter vector counts as filled with zeros; entries beyond a long stay at its ends
    held(make([1.0], [0.0, 2.0], [3.0, 1.0]), [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0])])
    assert {r["deviation"] for r in make([1e300], [-1e300])} == {None}


def test_null_ids_stay(spark):
    got = W.op11_whitening(spark.createDataFrame([(None, [1.0]), (None, [2.0]), (3, [2.0])], SCHEMA)).collect()
    assert len(got) == 3
    assert {r["n"] for r in got} == {2}


@pytest.mark.parametrize("scale", [1, 300, 70000, 2**40])
def test_packed_vectors_come_back(scale):
    x = np.random.default_rng(scale).integers(-scale, scale, (50, 9))
    x[3], x[4, 5:] = 0, 0
    x[5, 0] = np.iinfo(np.int64).min
    assert (W.unpacked(W.packed(x), 9) == x).all()
    assert W.packed(x[:, :5])[4] == W.packed(x)[4]


def test_rows_are_solved_against_triangles():
    rng = np.random.default_rng(2)
    r, q = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6), rng.normal(size=(20, 6))
    assert np.abs(W.solve_rows(q @ r, r) - q).max() < 1e-12
