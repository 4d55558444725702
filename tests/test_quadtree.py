"""Joins over quadtrees against all pairs: crowds, points in one place, holes, shared edges, very many edges, no points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import quadtree as qt


def frame(spark, x, y, name="pid", first=0):
    return spark.createDataFrame([(first + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], f"{name} long, x double, y double")


def inside(px, py, edges):
    """{(i, poly)} by rays over all edges."""
    out = set()
    for poly in {e[0] for e in edges}:
        e = np.array([v[1:] for v in edges if v[0] == poly])
        cross = (e[None, :, 1] <= py[:, None]) != (e[None, :, 3] <= py[:, None])
        with np.errstate(all="ignore"):
            at = e[None, :, 0] + (py[:, None] - e[None, :, 1]) * (e[None, :, 2] - e[None, :, 0]) / (e[None, :, 3] - e[None, :, 1])
        out |= {(int(i), poly) for i in np.flatnonzero((cross & (at > px[:, None])).sum(axis=1) % 2)}
    return out


def ring(poly, x, y):
    return [(poly, float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True)]


EDGES = "poly long, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def crowd():
    """90 % of 4,000 points in a thousandth of the area, 200 of them in one place."""
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 100, 4000), rng.uniform(0, 100, 4000)
    x[:3600], y[:3600] = 40 + rng.uniform(0, 3, 3600), 70 + rng.uniform(0, 3, 3600)
    x[:200], y[:200] = 41.5, 71.5
    return x, y


@pytest.mark.parametrize("leaf", [16, 4096])
def test_pairs_within_a_radius(spark, crowd, leaf):
    x, y = crowd[0][3000:], crowd[1][3000:]
    rng = np.random.default_rng(2)
    lx, ly = np.concatenate([rng.uniform(-5, 105, 60), x[:60]]), np.concatenate([rng.uniform(-5, 105, 60), y[:60]])
    left, right = frame(spark, lx, ly), frame(spark, x, y, "qid")
    odd = spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)], "pid long, x double, y double")
    got = qt.within(left.unionByName(odd), right.unionByName(odd.withColumnRenamed("pid", "qid")), 1.3, qt.quadtree(left, right, leaf_points=leaf))
    d = np.hypot(lx[:, None] - x[None], ly[:, None] - y[None])
    assert sorted((r["pid"], r["qid"]) for r in got.select("pid", "qid").collect()) == sorted(map(tuple, np.argwhere(d <= 1.3).tolist()))


def test_nearest_points(spark, crowd, monkeypatch):
    monkeypatch.setattr(qt, "LEAF_POINTS", 32)
    x, y = crowd[0][2500:], crowd[1][2500:]
    rng = np.random.default_rng(3)
    lx, ly = np.concatenate([rng.uniform(-50, 150, 50), x[:50], [1e6]]), np.concatenate([rng.uniform(-50, 150, 50), y[:50], [-1e6]])
    got = qt.nearest(frame(spark, lx, ly), frame(spark, x, y, "qid"), 5).collect()
    d = np.hypot(lx[:, None] - x[None], ly[:, None] - y[None])
    want = [(i, int(j), k + 1) for i in range(len(lx)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:5])]
    assert sorted((r["pid"], r["qid"], r["rank"]) for r in got) == sorted(want)
    few = qt.nearest(frame(spark, [0.0, 9.0], [0.0, 9.0]), frame(spark, [1.0, 2.0], [1.0, 2.0], "qid"), 3).collect()
    assert sorted((r["pid"], r["qid"], r["rank"]) for r in few) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1)]


@pytest.mark.parametrize("leaf", [8, 64, 4096])
def test_points_in_polygons_with_holes_and_shared_edges(spark, crowd, leaf):
    rng = np.random.default_rng(4)
    turn = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    far = rng.uniform(5, 30, 60)
    edges = ring(1, 42 + far * np.cos(turn), 70 + far * np.sin(turn))
    edges += ring(2, np.array([0, 50, 50, 0.0]), np.array([0, 0, 100, 100.0])) + ring(2, np.array([40, 43, 43, 40.0]), np.array([70, 70, 73, 73.0]))  # a hole
    edges += ring(3, np.array([50, 100, 100, 50.0]), np.array([0, 0, 100, 100.0]))  # shares an edge with 2
    edges += ring(4, np.array([200, 210, 205.0]), np.array([0, 0, 5.0]))
    px, py = np.concatenate([crowd[0][::7], [50.0, 50.0, 0.0, 100.0]]), np.concatenate([crowd[1][::7], [50.0, 0.0, 0.0, 100.0]])
    pts = frame(spark, px, py)
    e = spark.createDataFrame(edges, EDGES)
    tree = qt.quadtree(pts, e.select(F.col("x0").alias("x"), F.col("y0").alias("y")), leaf_points=leaf)
    got = qt.in_polygons(pts, e, tree=tree)
    assert sorted((r["pid"], r["poly"]) for r in got.collect()) == sorted(inside(px, py, edges))


def test_a_polygon_of_very_many_edges(spark):
    """100,000 edges of a rough circle: leaves share them, and each corner's ray meets few."""
    rng = np.random.default_rng(5)
    n = 100_000
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = 50 + rng.uniform(-0.5, 0.5, n)
    x, y = far * np.cos(turn), far * np.sin(turn)
    rows = spark.createDataFrame(__import__("pandas").DataFrame({"poly": 1, "pos": np.arange(n), "x": x, "y": y}))
    px, py = rng.uniform(-60, 60, 3000), rng.uniform(-60, 60, 3000)
    e = qt.ring_edges(rows)
    pts = frame(spark, px, py)
    tree = qt.quadtree(pts, e.select(F.col("x0").alias("x"), F.col("y0").alias("y")))
    held = tree.meets(e, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), segments=True).groupBy("leaf").count()
    assert held.agg(F.max("count")).first()[0] < 3 * qt.LEAF_POINTS
    got = {r["pid"] for r in qt.in_polygons(pts, e, tree=tree).collect()}
    assert got == {i for i, _ in inside(px, py, ring(1, x, y))}


def test_a_crowded_place_is_dealt_to_many_tasks(spark):
    """90 % of 40,000 points lie in a hundredth of a side, a third in one place: the largest task holds little more than the median."""
    n = 40_000
    u, v = F.rand(1), F.rand(2)
    near = F.col("id") < n * 9 // 10
    one = F.col("id") < n // 3
    pts = spark.range(n).select(F.col("id").alias("pid"), F.when(one, 3.7).when(near, 3 + u).otherwise(u * 100).alias("x"), F.when(one, 3.2).when(near, 3 + v).otherwise(v * 100).alias("y"))
    pts = spark.createDataFrame(pts.toPandas())
    tree = qt.quadtree(pts, leaf_points=500)
    held = np.array([r["count"] for r in qt.dealt(pts, tree, "pid").groupBy("leaf", "part").count().collect()])
    assert held.sum() == n and held.max() <= 2 * 500 and held.max() < 4 * np.median(held)
    spread = qt.dealt(pts, tree, "pid").where("x = 3.7 and y = 3.2").groupBy("leaf", "part").count().count()
    assert spread > 20


def test_nothing_and_one_place(spark):
    none = frame(spark, [], [])
    one = frame(spark, [5.0] * 3, [5.0] * 3)
    edges = spark.createDataFrame(ring(1, np.array([0, 9, 9, 0.0]), np.array([0, 0, 9, 9.0])), EDGES)
    assert qt.within(none, one.withColumnRenamed("pid", "qid"), 1.0).count() == 0 and qt.nearest(one, none.withColumnRenamed("pid", "qid"), 2).count() == 0
    assert qt.nearest(none, one.withColumnRenamed("pid", "qid"), 2).count() == 0
    assert qt.within(one, one.withColumnRenamed("pid", "qid"), 0.0).count() == 9
    assert qt.in_polygons(one, edges).count() == 3 and qt.in_polygons(none, edges).count() == 0 and qt.in_polygons(one, edges.where("false")).count() == 0


def test_points_of_one_place_part_only_after_the_join(spark, monkeypatch):
    """30 places of 40 points each, some ids null or repeated, lists of 8: all pairs, from as many joined rows as there are lists."""
    monkeypatch.setattr(qt, "TOGETHER", 8)
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 9, 30), rng.uniform(0, 9, 30)
    ids = [None, None, *range(7), *range(7), *range(100, 124)]
    left = spark.createDataFrame([(i, float(a), float(b)) for a, b in zip(x, y, strict=True) for i in ids], "pid long, x double, y double")
    rx, ry = rng.uniform(0, 9, 200), rng.uniform(0, 9, 200)
    right = frame(spark, rx, ry, "qid")
    got = qt.within(left, right, 1.3, digits=2)
    d = np.hypot(x[:, None] - rx[None], y[:, None] - ry[None])
    want = [(i, int(q), round(float(d[p, q]), 2)) for p, q in np.argwhere(d <= 1.3) for i in ids]
    key = lambda v: (v[0] is None, v[0] or 0, *v[1:])
    assert sorted(((r["pid"], r["qid"], r["d"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sorted(((r["pid"], r["qid"], r["d"]) for r in qt.within(left, right, 1.3, digits=2, together=False).collect()), key=key) == sorted(want, key=key)
    lists = qt._ids_by_place(left.select(F.col("pid").alias("_l"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), F.lit(1.3).alias("_r"))).withColumn("n", F.size("_ls"))
    most, ids, rows = lists.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert most <= 16 and ids == 30 * 40 and rows < 30 * 15
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_ls") < plan.index("Join Inner")  # pairs are made above the join, not sent through it


def test_pairs_of_crowded_places_pack_into_small_files(spark, tmp_path):
    """20 places of 200 points each near 2,000 points: a quarter of a byte for a pair, which takes over a byte where points meet one by one."""
    rng = np.random.default_rng(9)
    at = rng.permutation(np.repeat(np.arange(20), 200))
    left = frame(spark, rng.uniform(0, 9, 20)[at], rng.uniform(0, 9, 20)[at])
    right = frame(spark, rng.uniform(0, 9, 2000), rng.uniform(0, 9, 2000), "qid")
    qt.within(left, right, 1.3).write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert rows > 100_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * rows
