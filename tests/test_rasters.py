"""Rasters in tiles: neighbours meet across the sides of tiles, cells that are missing count for nothing, and one shuffle does."""

import random

import pytest

from fathomline.operators import raster
from fathomline.plans import space_queries


@pytest.fixture(scope="module")
def cells():
    r = random.Random(3)
    near = [(i, j) for i in (*range(-4, 5), *range(60, 69)) for j in (*range(-3, 4), *range(61, 67))]
    return {x: r.choice([None, 1.0, 2.5, 7.0]) for x in near if r.random() < 0.8}


def frame(spark, cells):
    return spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row long, col long, value double")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def around(cells, i, j):
    held = [v for a in (-1, 0, 1) for b in (-1, 0, 1) if (v := cells.get((i + a, j + b))) is not None]
    return sum(held) / len(held) if held else None


def test_smooth_across_tiles_shuffles_cells_once(spark, cells):
    got = raster.smooth(frame(spark, cells))
    assert shuffles(got) == 1
    assert {(x.row, x.col): x.value for x in got.collect()} == pytest.approx({k: None if v is None else around(cells, *k) for k, v in cells.items()})


def test_fill_across_tiles(spark, cells):
    got = {(x.row, x.col): x.value for x in raster.fill(frame(spark, cells), 1).collect()}
    assert got == pytest.approx({k: around(cells, *k) if v is None else v for k, v in cells.items()})


def test_smooth_keeps_cells_that_repeat_or_have_no_place(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, None), (None, 0, 5.0)], "row int, col int, value double")
    assert sorted(map(str, raster.smooth(df).collect())) == sorted(["Row(row=0, col=0, value=2.0)"] * 2 + ["Row(row=0, col=1, value=None)", "Row(row=None, col=0, value=None)"])


def test_upsampled_across_tiles_shuffles_cells_once(spark, cells):
    held = {k: v for k, v in cells.items() if v is not None}
    want = {}
    for i, j in held:
        for a in (0, 1):
            for b in (0, 1):
                met = [held.get((i + c, j + d)) for c in range(a + 1) for d in range(b + 1)]
                if None not in met:
                    want[2 * i + a, 2 * j + b] = sum(met) / len(met)
    got = raster.upsampled(frame(spark, cells))
    assert shuffles(got) == 1
    assert {(x.row, x.col): x.value for x in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("degree", [4, 8, 16])
def test_cell_edges_across_tiles_shuffle_cells_once(spark, cells, degree):
    held = {k: v for k, v in cells.items() if v is not None and v < 7}
    want = {}
    for i, j in held:
        for a, b in ((1, 0), (0, 1), (1, 1), (1, -1), (2, 1), (2, -1), (1, 2), (1, -2)):
            side = (a > 0) * 1, (b > 0) - (b < 0)
            way = {(0, 0), (a, b)} | ({(1, 0), (0, side[1])} if abs(a * b) == 1 else {(1, 0), (1, side[1])} if a == 2 else {(0, side[1]), (1, side[1])} if abs(b) == 2 else set())
            met = [held.get((i + c, j + d)) for c, d in way]
            if (a * a + b * b) <= {4: 1, 8: 2, 16: 5}[degree] and None not in met:
                want[i, j, i + a, j + b] = sum(met) / len(met)
    got = raster.cell_edges(frame(spark, cells), degree, 5.0)
    assert shuffles(got) == 1
    assert {(x.a_row, x.a_col, x.b_row, x.b_col): x.value for x in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("name", ["first_valid_layer", "raster_composite"])
def test_layers_are_shuffled_once(spark, name):
    assert shuffles(space_queries.Q[name][0](spark, "/root/testdata/sf0.001")) == 1
