"""Whitening against dense solutions in numpy, with repeated, null, short, equal and very large vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def dense(x):
    """n, S, eigenvalues falling, eigenvectors and trace of the covariance of the distinct rows of x."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, s, e[::-1], q[:, ::-1], np.trace(v), u


def held(rows, x, ids, k):
    """Each row's values are those of the dense solution, up to one sign for each component."""
    n, s, e, q, trace, _ = dense(x)
    sign = {}
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c + 1) for i in ids for c in range(k))
    at = dict(zip(ids, x, strict=True))
    for r in rows:
        v, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        want = (v - s / n) @ q[:, c] / np.sqrt(e[c])
        if abs(want) > 1e-3:
            sign.setdefault(c, np.sign(want * r["whitened"]))
        assert abs(abs(want) - abs(r["whitened"])) < 1e-7 and abs(want - sign.get(c, 1) * r["whitened"]) < 1e-7 + (abs(want) <= 1e-3) * 1
        assert abs(r["explained"] - e[c] / trace) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_query_is_the_dense_solution(spark):
    got = queries.op12_whitening(spark, SF).collect()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack([np.array(v, np.float64) for v in e.embedding])).astype(np.int64)
    held(got, x, e.vec_id.tolist(), 4)


@pytest.mark.parametrize("rows", [3, 4096])
def test_repeats_nulls_and_other_columns(spark, monkeypatch, rows):
    """A vector that a third of the rows hold counts once; spectra of a few rows, and more of them than one task merges, give the same."""
    monkeypatch.setattr(whitening, "SPECTRUM_ROWS", rows)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    x = rng.integers(-30, 30, (80, 6)) * np.array([9, 5, 3, 2, 1, 1])
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0)])
    odd = [(900, None), (901, []), (902, [1, 2]), (903, [5] * 7)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "vec_id long, vec array<bigint>").withColumns({c: F.lit(1) for c in ("x", "n", "part", "at", "component")})
    held(whitening.whiten(df).collect(), x, list(range(len(x))), 4)
    held(whitening.whiten(df, 9).collect(), x, list(range(len(x))), 6)


def test_no_variance(spark):
    rows = lambda v: spark.createDataFrame(v, "vec_id string, vec array<bigint>")
    assert whitening.whiten(rows([])).collect() == []
    assert whitening.whiten(rows([("a", [1, 2]), ("b", [1, 2])])).collect() == []
    one = whitening.whiten(rows([("a", [1, 2]), ("b", [3, 2]), (None, [3, 2])])).collect()
    assert sorted((str(r["vec_id"]), r["component"], round(abs(r["whitened"]), 12), r["explained"]) for r in one) == [("None", 1, 1.0, 1.0), ("a", 1, 1.0, 1.0), ("b", 1, 1.0, 1.0)]


def test_deviation_beyond_64_bits_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [2**61, 0]), (2, [-(2**61), 1]), (3, [0, 5])], "vec_id long, vec array<bigint>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: (3 * 0 - 0) ** 2 + (3 * 5 - 6) ** 2}


def test_scaled_vectors(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([None, 1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(whitening.scaled(F.col("v"))).collect()] == [[128, -1], None, None, None, None, []]


@pytest.mark.parametrize("kind", ["full", "low rank", "few distinct", "coarse"])
def test_spectra_are_orthogonal_and_exact(kind):
    rng = np.random.default_rng(7)
    x = np.floor(40 * rng.standard_normal((200, 24)))
    if kind == "low rank":
        x[:, 12:] = x[:, :12]
    if kind == "few distinct":
        x = x[rng.integers(0, 3, 200)]
    if kind == "coarse":
        x = np.floor(x / 64)
    parts = [whitening.Spectrum(24) for _ in range(3)]
    for i, r in enumerate(x):
        parts[i % 3].add(r)
    parts[0].merge(parts[1])
    parts[0].merge(parts[2])
    got, c = parts[0], np.cov(x.T, bias=True) * len(x)
    assert np.abs(got.q.T @ got.q - np.eye(24)).max() < 1e-13
    assert np.abs((got.q * got.w) @ got.q.T - c).max() < 1e-12 * np.abs(c).max() and np.allclose(got.mean, x.mean(axis=0))


def test_refinement_mends_a_bad_basis(spark):
    """From any basis the residuals lead to the dense solution, and from the right one a single pass."""
    rng = np.random.default_rng(8)
    x = rng.integers(-50, 50, (300, 10))
    n, s, e, q, _, u = dense(x)
    fit = spark.createDataFrame([(v.tolist(),) for v in u], "x array<bigint>")
    for start in (np.eye(10)[:, :5], q[:, :5]):
        got, vec = whitening.refined(fit, s.astype(float), n, start, 4)
        assert np.allclose(got, e[:4], rtol=1e-12) and np.allclose(np.abs((vec * q[:, :4]).sum(axis=0)), 1)
