"""Tiles against the whole array, for several sizes of tiles."""

import numpy as np
import pytest

from fathomline.operators import tiles


def whole(v, width, iterations, smoothing=0, keep=True):
    """A plain box mean over the array mirrored at its borders, growing into cells without values."""
    given, out, reach = ~np.isnan(v), v.copy(), width // 2
    for k in range(iterations + smoothing):
        p = np.pad(out, reach, mode="symmetric")
        new = out.copy()
        for r in range(v.shape[0]):
            for c in range(v.shape[1]):
                near = p[r : r + width, c : c + width]
                if (keep and given[r, c]) or np.isnan(near).all() or (k >= iterations and np.isnan(out[r, c])):
                    continue
                if keep or given[r, c]:
                    new[r, c] = np.nanmean(near)
        out = new
    return out


@pytest.fixture(scope="module")
def raster():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(23, 31))
    v[5:12, 8:20] = np.nan
    v[0:2, 25:31] = np.nan
    v[20, 3] = np.nan
    return v


def frame(spark, v):
    return spark.createDataFrame([(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) for r in range(v.shape[0]) for c in range(v.shape[1])], "row int, col int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    rows = df.collect()
    assert len({(r["row"], r["col"]) for r in rows}) == len(rows) == shape[0] * shape[1]
    for r in rows:
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.mark.parametrize("size", [4, 7, 512])
def test_tiles_are_the_whole(spark, raster, size):
    df = frame(spark, raster)
    assert np.allclose(array(tiles.smoothed(df, 3, 2, size), raster.shape), whole(raster, 3, 2, keep=False), equal_nan=True)
    assert np.allclose(array(tiles.filled(df, 3, 2, 1, size), raster.shape), whole(raster, 3, 2, 1), equal_nan=True)


def test_holes_and_local_filling(spark, raster):
    df = frame(spark, raster)
    got = {}
    for r in tiles.holes(df).collect():
        got.setdefault(tuple(r["hole"]), set()).add((r["row"], r["col"]))
    assert {k: len(v) for k, v in got.items()} == {(5, 8): 84, (0, 25): 12, (20, 3): 1}
    filled = array(tiles.filled_locally(df, 3, 7, 50), raster.shape)
    assert np.isnan(filled[5:12, 8:20]).all()  # too large
    want = raster.copy()
    for r0, r1, c0, c1 in ((0, 2, 25, 31), (20, 21, 3, 4)):
        a, b = max(0, r0 - 1), max(0, c0 - 1)
        crop = whole(raster[a : r1 + 1, b : c1 + 1], 3, 7)
        want[r0:r1, c0:c1] = crop[r0 - a : r1 - a, c0 - b : c1 - b]
    assert np.allclose(filled, want, equal_nan=True)


def test_tiles_of_nothing_and_wide_halos(spark):
    none = spark.createDataFrame([], "row int, col int, value double")
    assert tiles.smoothed(none).count() == tiles.filled(none).count() == tiles.filled_locally(none).count() == 0
    with pytest.raises(ValueError):
        tiles.tiled(none, lambda v: v, 9, 8)
