"""Forests, bottlenecks and solves against Kruskal, plain minimax and dense solutions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import mesh, raster, solve, spanning


def kruskal(edges):
    up = {n: n for e in edges for n in e[:2]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        a2, b2 = root(a), root(b)
        if a2 != b2:
            up[a2] = b2
            out.append((a, b, w))
    return out


def minimax(edges, u, v):
    """The largest weight on the only way from u to v in a forest."""
    near = {}
    for a, b, w in kruskal(edges):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    todo, seen = [(u, None)], {u}
    while todo:
        n, most = todo.pop()
        if n == v:
            return most
        for m, w in near.get(n, []):
            if m not in seen:
                seen.add(m)
                todo.append((m, w if most is None else max(most, w)))
    return None


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(4)
    e = [(a, b, rng.randint(1, 40)) for a in range(70) for b in rng.sample(range(70), 3)]
    e += [(100 + i, 101 + i, i % 5) for i in range(40)] + [(5, 5, 1), (200, 201, 3), (201, 200, 1)]
    return e


def test_forest_is_kruskals(spark, graph):
    df = spark.createDataFrame([*graph, (None, 3, 1), (3, None, 1), (3, 4, None)], "a long, b long, w int")
    assert sorted(map(tuple, spanning.spanning_forest(df).collect())) == sorted(kruskal(graph))
    assert spanning.spanning_forest(df.where("false")).count() == 0


def test_bottlenecks_are_the_plain_ones(spark, graph):
    rng = random.Random(5)
    pairs = [(rng.randrange(70), rng.randrange(70)) for _ in range(150)] + [(100, 140), (139, 117), (3, 100), (200, 201), (6, 6), (999, 3), (None, 4)]
    got = {(r["u"], r["v"]): r["w"] for r in spanning.bottlenecks(spark.createDataFrame(graph, "a long, b long, w int"), spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(u, v): None if u == v else minimax(graph, u, v) for u, v in pairs if u is not None}
    none = spark.createDataFrame([], "a long, b long, w int")
    assert [tuple(r) for r in spanning.bottlenecks(none, spark.createDataFrame([(1, 2)], "u long, v long")).collect()] == [(1, 2, None)]


def test_bottlenecks_over_a_rasters_edges(spark):
    """Ways over a raster with a wall that has one low gap."""
    rng = np.random.default_rng(6)
    v = rng.integers(0, 10, (9, 12)).astype(float)
    v[:, 6] = 50
    v[4, 6] = 20
    grid = spark.createDataFrame([(r, c, float(v[r, c])) for r in range(9) for c in range(12)], "row int, col int, value double")
    spot = lambda n: (F.col(f"{n}_row") * 12 + F.col(f"{n}_col")).alias(n)
    links = raster.cell_edges(grid, 4).select(spot("a"), spot("b"), F.col("value").alias("w"))
    ends = spark.createDataFrame([(0, 107)], "u long, v long")
    assert spanning.bottlenecks(links, ends).first()["w"] == minimax([tuple(r) for r in links.collect()], 0, 107)
    named = grid.select((F.col("row") * 12 + F.col("col")).alias("n"), "row", "col", "value")
    right = named.select((F.col("col") - 1).alias("col"), "row", F.col("n").alias("m"), F.col("value").alias("w"))
    down = named.select("col", (F.col("row") - 1).alias("row"), F.col("n").alias("m"), F.col("value").alias("w"))
    e = named.join(right.unionByName(down), ["row", "col"]).select(F.col("n").alias("a"), F.col("m").alias("b"), F.greatest("value", "w").alias("w"))
    assert spanning.bottlenecks(e, ends).first()["w"] == 20


def lattice(spark, wide=5, high=4):
    nodes, ring = mesh.rectilinear(spark, wide, high)
    nodes = nodes.select("node", (F.col("x") + 0.1 * F.sin("node")).alias("x"), (F.col("y") + 0.1 * F.cos(F.col("node") * 2)).alias("y"))
    return nodes, ring, mesh.edges_of(ring)


def test_levels_of_edges(spark):
    """Two cells side by side with a ridge between them that has a gap, and cells without points."""
    nodes, ring = mesh.rectilinear(spark, 3, 1, 4.0, 6.0)
    v = np.full((6, 8), 1.0)
    v[:, 3:5] = 9.0
    v[2, 3:5] = 4.0
    v[0, 0], v[5, 7] = -1.0, -2.0
    rows = [(r, c, float(v[r, c])) for r in range(6) for c in range(8)]
    got = spanning.connection_levels(mesh.edges_of(ring), ring, nodes, spark.createDataFrame(rows, "row int, col int, value double"), 0.5, 0.5)
    inner = {(r["n1"], r["n2"]): r["level"] for r in got.collect()}
    assert inner == {(1, 5): 4.0, (2, 6): None}
    v[2, 3] = np.nan
    rows = [(r, c, float(v[r, c])) for r in range(6) for c in range(8)]
    got = spanning.connection_levels(mesh.edges_of(ring), ring, nodes, spark.createDataFrame(rows, "row int, col int, value double"), 0.5, 0.5)
    assert {(r["n1"], r["n2"]): r["level"] for r in got.collect()}[1, 5] == 9.0


def test_connection_levels_of_small_and_large_pairs_agree(spark, monkeypatch):
    """Tasks that take whole pairs and the way for large ones give each edge one level, and pairs in tasks take no rounds."""
    nodes, ring = mesh.rectilinear(spark, 4, 3, 4.0, 3.0)
    rng = np.random.default_rng(3)
    rows = [(r, c, float(rng.integers(0, 9))) for r in range(9) for c in range(16) if rng.random() < 0.8]
    rows += [(0, 0, 0.5), (0, 0, 7.5), (20, 3, 1.0)]
    grid = spark.createDataFrame(rows, "row int, col int, value double")
    called = []
    rounds = spanning._rounds
    monkeypatch.setattr(spanning, "_rounds", lambda e: called.append(e) or rounds(e))
    found = []
    for most in (1 << 12, 20):
        monkeypatch.setattr(spanning, "PAIR_POINTS", most)
        got = spanning.connection_levels(mesh.edges_of(ring), ring, nodes, grid, 0.5, 0.5).collect()
        assert bool(called) == (most < 100)
        found.append({(r["n1"], r["n2"]): r["level"] for r in got})
    assert found[0] == found[1]
    assert len(found[0]) == 17 and any(v is not None for v in found[0].values())


def dense(rows, n):
    m = np.zeros((n, n))
    for r in rows:
        m[r["i"], r["j"]] += r["v"]
    return m


def test_conjugate_gradients_are_the_dense_solution(spark):
    rng = np.random.default_rng(7)
    n = 40
    m = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.1)
    m = m @ m.T + np.diag(rng.uniform(0.5, 50, n))
    b = rng.normal(size=(n, 2))
    entries = [(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m != 0)]
    entries += [(0, 0, 1.0), (0, 0, -1.0)]
    rhs = [(i, float(b[i, 0]), None if i == 3 else float(b[i, 1])) for i in range(n)]
    b[3, 1] = 0
    got = solve.conjugate_gradients(spark.createDataFrame(entries, "i int, j int, v double"), spark.createDataFrame(rhs, "i int, s double, t double"), ["s", "t"], 1e-12).orderBy("i").collect()
    assert np.abs(np.array([[r["s"], r["t"]] for r in got]) - np.linalg.solve(m, b)).max() < 1e-8
    with pytest.raises(ValueError):
        solve.conjugate_gradients(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 2.0), (1, 0, 2.0)], "i int, j int, v double"), spark.createDataFrame([(0, 1.0), (1, -1.0)], "i int, s double"), ["s"]).collect()
    zero = solve.conjugate_gradients(spark.createDataFrame([(0, 0, 2.0)], "i int, j int, v double"), spark.createDataFrame([(0, 0.0)], "i int, s double"), ["s"]).collect()
    assert [tuple(r) for r in zero] == [(0, 0.0)]


def test_extrapolation_is_the_dense_solution(spark):
    nodes, ring, edges = lattice(spark)
    samples = spark.createDataFrame([(0, 3.0, 1.0), (0, 5.0, 2.0), (13, -1.0, 0.5), (19, 8.0, 1.0), (7, None, 1.0), (None, 1.0, 1.0), (8, 1.0, 0.0)], "cell long, value double, weight double")
    m = dense(solve.diffusion_matrix(edges, ring, nodes, 0.02, 1.0).collect(), 20)
    assert np.abs(m - m.T).max() < 1e-12
    w, v = np.zeros(20), np.zeros(20)
    for c, x, k in [(0, 3.0, 1.0), (0, 5.0, 2.0), (13, -1.0, 0.5), (19, 8.0, 1.0)]:
        w[c] += k
        v[c] += k * x
    want = np.linalg.solve(m, v) / np.linalg.solve(m, w)
    got = {r["cell"]: (r["value"], r["weight"]) for r in solve.extrapolated(edges, ring, nodes, samples, 0.02, 1.0, tolerance=1e-13).collect()}
    assert max(abs(got[i][0] - want[i]) for i in range(20)) < 1e-8
    assert min(want) > -1.1 and max(want) < 8.1


def test_harmonic_values_run_evenly(spark):
    links = [(i, i + 1, 1.0) for i in range(10)] + [(20, 21, 1.0), (3, 3, 1.0)]
    got = {r["node"]: r["value"] for r in solve.harmonic(spark.createDataFrame(links, "a long, b long, w double"), spark.createDataFrame([(0, 0.0), (10, 5.0), (None, 1.0)], "node long, value double"), 1e-13).collect()}
    assert {n: v for n, v in got.items() if n > 10} == {20: None, 21: None}
    assert all(abs(got[i] - i / 2) < 1e-8 for i in range(11))
