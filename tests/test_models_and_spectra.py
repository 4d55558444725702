import math

import numpy as np
import pytest

from fathomline.operators import mesh, mesh_joins, raster, spectra, transect
from fathomline.sources import models


def test_spectrum_is_that_of_the_tapered_covariances(spark):
    r = np.random.default_rng(3)
    v = np.sin(np.arange(60) * 2 * math.pi / 8) + r.normal(0, 0.2, 60)
    v[[7, 8, 30]] = np.nan
    rows = [("a", i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)] + [("one", 0, 1.0), ("none", 0, None)]
    got = spectra.spectrum(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "i", "v", 10, 32, 0.5).where("k = 'a'").orderBy("frequency").collect()
    ok = ~np.isnan(v)
    i = np.arange(60)
    flat = v - np.polyval(np.polyfit(i[ok], v[ok], 1), i)
    cov = [np.nanmean(flat[: 60 - k] * flat[k:]) for k in range(11)]
    both = np.zeros(32)
    both[0] = cov[0]
    for k in range(1, 11):
        both[k] = both[-k] = cov[k] * (0.5 + 0.5 * math.cos(math.pi * k / 10))
    power = np.abs(np.real(np.fft.fft(both)))[:17] * 2
    power[[0, 16]] /= 2
    assert [x.frequency for x in got] == pytest.approx([k / 16 for k in range(17)])
    assert [x.power for x in got] == pytest.approx(list(power * 0.5))
    assert max(got, key=lambda x: x.power).frequency == 0.25
    for wrong in ((10, 31), (0, 32), (32, 32)):
        with pytest.raises(ValueError):
            spectra.spectrum(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "i", "v", *wrong)


def test_dominant_period_is_the_peak_of_a_fine_scan(spark):
    t = np.arange(0, 400, 0.7)
    waves = {"a": 3 + np.sin(2 * math.pi * t / 12.42) + 0.3 * np.cos(2 * math.pi * t / 24), "b": np.cos(2 * math.pi * t / 23.9)}
    rows = [(k, float(x), float(y)) for k, w in waves.items() for x, y in zip(t, w, strict=True)]
    rows += [("a", None, 1.0), ("a", 1.0, None), (None, 1.0, 1.0), ("none", None, None)]
    given = [float(p) for p in np.arange(10, 30, 0.25)]
    got = {r.k: r for r in spectra.dominant_period(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", "v", given).collect()}
    assert set(got) == {"a", "b"}
    for k, w in waves.items():
        h = w - w.mean()
        scan = np.arange(11.5, 25, 0.0005)
        e = np.array([np.mean(h * np.cos(2 * math.pi * t / p)) ** 2 + np.mean(h * np.sin(2 * math.pi * t / p)) ** 2 for p in scan])
        assert got[k].period == pytest.approx(scan[e.argmax()], abs=2e-3)
        assert got[k].energy == pytest.approx(e.max(), rel=1e-5)


def test_cell_gradient_of_a_plane(spark):
    nodes, ring = mesh.rectilinear(spark, 5, 4, 2.0, 1.0)
    centre = mesh.cell_geometry(ring, nodes).selectExpr("cell", "cx", "cy", "3 * cx - 2 * cy as value")
    got = mesh_joins.cell_gradient(mesh.edges_of(ring), ring, nodes, centre).join(centre, "cell").collect()
    assert got
    xs, ys = sorted({r.cx for r in got}), sorted({r.cy for r in got})
    inner = [r for r in got if r.cx not in (xs[0], xs[-1]) and r.cy not in (ys[0], ys[-1])]
    assert inner
    for r in inner:
        assert (r.u, r.v) == (pytest.approx(3), pytest.approx(-2))


def test_forcing_values(spark):
    text = ["note", "", "[forcing]", "Name = a_0001", "Quantity=time", "Unit = seconds since 2001-01-01", "quantity = level", "name = b", "0 1.5", "\t60   x ", None, "[FORCING]", "Quantity = flow", "7"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)] + [("empty", 0, "")], "file string, n long, value string").repartition(3)
    got = [tuple(r) for r in models.forcing_values(lines).orderBy("block", "row", "quantity").collect()]
    b = {"name": "b"}
    want = [("f", 1, b, 1, "level", None, 1.5), ("f", 1, b, 1, "time", "seconds since 2001-01-01", 0.0), ("f", 1, b, 2, "level", None, None), ("f", 1, b, 2, "time", "seconds since 2001-01-01", 60.0)]
    assert got == [*want, ("f", 2, {}, 1, "flow", None, 7.0)]
    with pytest.raises(Exception, match="one number for each quantity"):
        models.forcing_values(spark.createDataFrame([("f", 0, "[forcing]"), ("f", 1, "quantity = q"), ("f", 2, "1 2")], "file string, n long, value string")).collect()


def test_polyline_lines(spark):
    points = spark.createDataFrame([("w", 2, 3.0, 4.5, "end"), ("w", 1, 1.0, None, None)], "label string, k int, x double, y double, name string")
    got = [r.value for r in models.polyline_lines(points, "label", "k", ["x", "y"], "name").orderBy("n").collect()]
    assert got == ["w", "  2     2", "1.0              nan   ", "3.0              4.5   end"]
    assert models.polyline_lines(points.limit(0), "label", "k", ["x", "y"]).count() == 0


def test_three_file_mesh(spark):
    of = lambda rows: spark.createDataFrame(list(enumerate(rows)), "n long, value string")
    nodes, edges, cells, ring = models.three_file_mesh(of(["0 0 -1", " 1e0\t0 -1"]), of(["0 1 1 0 -1 0", ""]), of(["0.5 0.25 0 1 2 -1 -1 -1", "4 1.5 2.5 0 1 2 3 -1 -1 -1 -1", "3 1 2 4 5 6 0 -1 -1"]))
    assert [tuple(r) for r in nodes.orderBy("node").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0)]
    assert [tuple(r) for r in edges.collect()] == [(0, 0, 1, 1, 0, None)]
    assert [tuple(r) for r in cells.orderBy("cell").collect()] == [(0, 0.5, 0.25), (1, 1.5, 2.5), (2, 1.0, 2.0)]
    assert [tuple(r) for r in ring.orderBy("cell", "pos").collect()] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, 4), (2, 1, 5), (2, 2, 6)]


def test_cell_edges_against_all_stencils(spark):
    r = np.random.default_rng(5)
    held = {(int(i), int(j)): float(v) for (i, j), v in np.ndenumerate(r.uniform(0, 1, (7, 8))) if v < 0.8}
    rows = [(i, j, v) for (i, j), v in held.items()] + [(50, 50, None), (50, 51, float("nan"))]
    for degree, reach in ((4, {(0, 1)}), (8, {(0, 1), (1, 1)}), (16, {(0, 1), (1, 1), (1, 2)})):
        got = {((x.a_row, x.a_col), (x.b_row, x.b_col)): (x.length, x.value) for x in raster.cell_edges(spark.createDataFrame(rows, "row long, col long, value double"), degree, 0.75, 3.0, 2.0).collect()}
        want = {}
        for a in held:
            for b in held:
                far = (abs(a[0] - b[0]), abs(a[1] - b[1]))
                if (a[0], -a[1]) >= (b[0], -b[1]) and a[0] >= b[0] or tuple(sorted(far)) not in reach:
                    continue
                box = [(i, j) for i in range(min(a[0], b[0]), max(a[0], b[0]) + 1) for j in range(min(a[1], b[1]), max(a[1], b[1]) + 1)]
                # of a knight's six cells, the two corners off its way do not count
                touched = [c for c in box if sum(far) < 3 or c in (a, b) or (2 * c[0] - a[0] - b[0]) ** 2 + (2 * c[1] - a[1] - b[1]) ** 2 <= 1]
                if all(held.get(c, 9.0) <= 0.75 for c in touched):
                    want[frozenset((a, b))] = (math.hypot(far[0] * 2, far[1] * 3), np.mean([held[c] for c in touched]))
        assert {frozenset(k) for k in got} == set(want) and len(got) == len(want)
        for k, v in got.items():
            assert v == (pytest.approx(want[frozenset(k)][0]), pytest.approx(want[frozenset(k)][1]))


def test_secondary_strength(spark):
    rows = [("a", 1, 2.0, 0.5), ("a", 2, None, 0.5), ("a", 3, 1.0, 0.5), ("a", 4, -1.0, 0.5), ("a", 5, -3.0, 0.5), ("a", 6, -9.0, 0.0), ("b", 1, 1.0, 0.5), ("c", 1, None, 0.5)]
    t = spark.createDataFrame(rows, "k string, i int, v double, dz double")
    assert {r.k: r.strength for r in transect.secondary_strength(t, "v", "i", ["k"]).collect()} == {"a": 1.5, "b": 0.0, "c": 0.0}


def test_clearance_and_circumcentre_errors_of_a_lattice(spark):
    nodes, ring = mesh.rectilinear(spark, 4, 4, 2.0, 1.0)
    assert {round(r.error, 9) for r in mesh_joins.circumcentre_errors(ring, nodes).collect()} == {0.0}
    edges = mesh.edges_of(ring)
    one = {round(abs(r.clearance), 9) for r in mesh_joins.edge_clearance(edges, ring, nodes).collect()}
    assert one == {round(0.5 / math.sqrt(2), 9), round(1 / math.sqrt(2), 9)}
    two = mesh_joins.edge_clearance(edges, ring, nodes, both=True)
    assert two.where("clearance is null").count() == edges.where("left is null or right is null").count()
    kite = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 1.0, 3.0), (3, 0.0, 1.0)], "node long, x double, y double")
    cell = spark.createDataFrame([(0, k, k) for k in range(4)] + [(1, k, k) for k in range(3)], "cell long, pos int, node long")
    got = {r.cell: r.error for r in mesh_joins.circumcentre_errors(cell, kite).collect()}
    assert got[1] == 0 and got[0] > 0.01
