import math

import numpy as np
import pytest

from fathomline.operators import filters as L


def series(spark, values):
    rows = [(1, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, i int, v double")


def column(df, name="filtered"):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("size", [1, 4, 7])
def test_fir_is_a_convolution(spark, size):
    x = np.sin(np.arange(30.0))
    win = np.hanning(size + 2)[1:-1]
    win /= win.sum()
    gone = {3, 4, 20}
    kept = np.array([i not in gone for i in range(30)], float)
    weight = np.convolve(kept, win, "same")
    want = np.convolve(x * kept, win, "same")
    got = column(L.fir(series(spark, [None if i in gone else v for i, v in enumerate(x)]), ["k"], ["i"], "v", size))
    for g, s, w in zip(got, want, weight, strict=True):
        assert (g is None) if w < 0.49999 else abs(g - s / w) < 1e-9


def test_godin_is_three_convolutions(spark):
    x = want = np.cos(np.arange(120.0) / 5) + np.arange(120.0) / 50
    for n in (24, 24, 25):
        want = np.convolve(want, np.ones(n) / n, "same")
    assert np.allclose(column(L.godin(series(spark, x), ["k"], ["i"], "v")), want)
    marked = np.concatenate([[np.nan], x, [np.nan]])
    for n in (24, 24, 25):
        marked = np.convolve(marked, np.ones(n) / n, "same")
    got = np.array(column(L.godin(series(spark, x), ["k"], ["i"], "v", ends="null")), float)
    assert np.allclose(got, marked[1:-1], equal_nan=True)


def test_harmonics_come_back(spark):
    t = np.linspace(0, 10 * math.pi, 125)
    h = np.cos(t - 1) + 5
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, h, strict=True))] + [(2, 0, 1.0, None)], "k int, i int, t double, h double")
    comps = L.decompose(df, ["k"], "t", "h", [1.0, 0.0])
    got = {r["omega"]: (r["amplitude"], r["phase"]) for r in comps.collect()}
    assert np.allclose(got[1.0], (1, 1)) and np.allclose(got[0.0], (5, 0))
    assert np.allclose(column(L.recompose(df.where("k = 1"), comps, ["k"], "t"), "level"), h)
    assert L.decompose(df.limit(0), ["k"], "t", "h", [1.0]).count() == 0
    alone = L.decompose(df.where("k = 1").drop("k"), [], "t", "h", [1.0, 0.0])
    assert np.allclose(column(L.recompose(df.where("k = 1"), alone, [], "t"), "level"), h)
