import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import geometry as G
from fathomline.functions import time as T
from fathomline.operators import graph, mesh, raster, spatial
from fathomline.operators import temporal as S


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(6), 3.0), (1, at(7), 5.0)], "k int, ts timestamp_ntz, value double")
    got = {r["bin"]: r["mean"] for r in S.bin_mean(df, ["k"], 21600).collect()}
    assert got == {at(-6): 1.0, at(0): 3.0, at(6): 5.0}


def test_nearest_takes_the_later_of_equals(spark):
    left = spark.createDataFrame([(1, at(1))], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, at(0), 1.0), (1, at(2), 2.0)], "k int, ts timestamp_ntz, value double")
    assert S.nearest(left, right, ["k"]).first()["near_value"] == 2.0
    assert S.nearest(left, right, ["k"], 60).first()["near_value"] is None
    assert S.interp_near(left, right, ["k"]).first()["interp"] == 1.5


def test_time_functions(spark):
    r = spark.createDataFrame([(at(30), "2 hours since 2024-01-01 00:00:00")], "t timestamp_ntz, c string").select(
        T.to_jdate(F.col("t")).alias("j"), T.cf_time(F.col("c")).alias("c"), G.letters_to_number(F.lit("AB")).alias("n")
    ).first()
    assert (r["j"], r["c"], r["n"]) == (2024001, at(2), 27)


def test_point_in_polygon(spark):
    ring = spark.createDataFrame([("p", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])], "poly string, pos int, x double, y double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 3.0), (3, 3.5, 2.5), (4, 9.0, 9.0)], "pid long, x double, y double")
    assert sorted(r["pid"] for r in spatial.points_in_polygons(pts, ring, 1.0).collect()) == [1, 3]


def test_rectilinear_mesh_and_paths(spark):
    nodes, ring = mesh.rectilinear(spark, 3, 2)
    edges = mesh.edges_of(ring)
    assert edges.count() == 17 and mesh.boundary_edges(edges).count() == 10
    assert {round(r["area"], 9) for r in mesh.cell_geometry(ring, nodes).collect()} == {1.0}
    g = edges.select(F.col("n1").alias("a"), F.col("n2").alias("b"), F.lit(1.0).alias("w"))
    path = graph.shortest_path(g, 0, 11).orderBy("distance").collect()
    assert [r["distance"] for r in path] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    flow = edges.join(nodes.withColumnRenamed("node", "n1"), "n1").select("n1", "n2", F.when(F.col("n2") - F.col("n1") > 1, 1.0).otherwise(0.0).alias("value"))
    uv = mesh.perot(ring, nodes, edges, flow).collect()
    assert all(abs(r["u"] - 1) < 1e-9 and abs(r["v"]) < 1e-9 for r in uv)


def test_raster_fill_and_bilinear(spark):
    g = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(r + c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    assert raster.fill(g).where("row = 1 and col = 1").first()["value"] == 2.0
    p = spark.createDataFrame([(1, 0.5, 0.0), (2, 2.0, 2.0), (3, 1.9, 2.4), (4, 2.6, 0.0), (5, 0.0, -0.5), (6, 0.0, -1.5), (7, 0.2, 0.2)], "pid long, x double, y double")
    assert {r["pid"]: r["value"] for r in raster.bilinear(raster.fill(g), p).collect()} == {1: 0.5, 2: 4.0, 3: 4.0, 4: None, 5: -0.5, 6: None, 7: pytest.approx(0.4)}
    assert {r["pid"]: r["value"] for r in raster.bilinear(g, p).collect()} == {1: None, 2: 4.0, 3: 4.0, 4: None, 5: None, 6: None, 7: None}  # a corner is missing


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_of_far_and_unplaced_points(spark):
    near = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e12, 0.0), (3, None, 0.0), (4, float("nan"), 0.0)], "pid long, x double, y double")
    right = spark.createDataFrame([(10, 0.0, 0.5), (11, 0.0, None), (12, 1.0, float("nan"))], "qid long, x double, y double")
    for rounds in (1, 3):
        assert sorted((r["pid"], r["qid"], r["rank"]) for r in spatial.knn(near, right, 2, 0.5, rounds=rounds).collect()) == [(1, 10, 1), (2, 10, 1)]
    assert spatial.knn(near, right.where("qid > 10"), 2, 0.5, rounds=3).count() == 0


def test_shortest_path_is_a_path_where_ways_tie(spark):
    def path(edges, a, b):
        df = spark.createDataFrame([(x, y, float(w)) for x, y, w in edges], "a bigint, b bigint, w double")
        return [tuple(r) for r in graph.shortest_path(df, a, b).orderBy("distance").collect()]

    tied = [(0, 1, 1), (0, 2, 1), (1, 4, 1), (2, 3, 1), (3, 5, 1), (4, 5, 1)]
    assert path(tied, 0, 5) == [(0, 0.0), (2, 1.0), (3, 2.0), (5, 3.0)]
    assert path([(k, k + 1, 1) for k in range(20)], 3, 17) == [(k, float(k - 3)) for k in range(3, 18)]
    assert path(tied, 4, 4) == [(4, 0.0)] and path([*tied, (8, 9, 1)], 0, 9) == []


def test_dice_interval_fits_whole_windows(spark):
    def dice(a, b, width, overlap):
        df = spark.sql(f"select timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, {a}) as a, timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, {b}) as b")
        rows = S.dice_interval(df, "a", "b", width, overlap).orderBy("window_start").collect()
        return [(r["window_start"].second + r["window_start"].microsecond / 1e6, r["window_end"].second + r["window_end"].microsecond / 1e6) for r in rows]

    got = dice(0, 10, 3, 0)
    assert len(got) == 3 and abs(got[0][1] - 10 / 3) < 1e-5 and got[-1][1] == 10.0
    assert dice(0, 10, 5, 0.5) == [(0.0, 5.0), (2.5, 7.5), (5.0, 10.0)]
    assert dice(0, 5, 10, 0) == [(0.0, 5.0)] and dice(0, 1, 10, 0.5) == []


def test_windows_of_one_long_series_are_linear(spark):
    """100,000 samples of one key: quadratic frames would take minutes."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 1000 == 500, F.col("id").cast("double")).alias("v"))
    began = time.time()
    got = S.fill_invalid(df, ["k"], ["i"], "v").agg(F.sum("filled").alias("s"), F.count("filled").alias("n")).first()
    want = sum(max(500, min(99_500, i)) for i in range(100_000))
    assert got["n"] == 100_000 and abs(got["s"] - want) < 1e-3 and time.time() - began < 30


def test_fill_invalid_on_the_line_through_the_ends(spark):
    rows = [(0, None), (1, 1.0), (2, None), (3, 5.0), (4, None)]
    df = spark.createDataFrame([(1, i, v) for i, v in rows], "k int, i int, v double")
    assert [r["filled"] for r in S.fill_invalid(df, ["k"], ["i"], "v", ends="linear").orderBy("i").collect()] == [-1.0, 1.0, 3.0, 5.0, 7.0]


def test_edges_of_no_mesh_are_an_error(spark):
    ring = spark.createDataFrame([(c, p, n) for c in (1, 2) for p, n in enumerate((1, 2, 3))], "cell bigint, pos int, node bigint")
    with pytest.raises(Exception, match="several cells on a side"):
        mesh.edges_of(ring).collect()
    assert {r["left"] for r in mesh.edges_of(ring, more="last").where("left is not null").collect()} == {2}


def test_geometry_far_from_the_origin(spark):
    nodes = spark.createDataFrame([(k, 4e6 + x, 5e6 + y) for k, (x, y) in enumerate([(0, 0), (2, 0), (2, 1), (0, 1)])], "node bigint, x double, y double")
    ring = spark.createDataFrame([(1, k, k) for k in range(4)], "cell bigint, pos int, node bigint")
    r = mesh.cell_geometry(ring, nodes).first()
    assert (r["area"], r["cx"], r["cy"]) == (2.0, 4e6 + 1, 5e6 + 0.5)
    x, y = G.circumcentre(*(F.lit(v) for v in (4e6, 5e6, 4e6 + 2, 5e6, 4e6, 5e6 + 4)))
    assert tuple(spark.range(1).select(x, y).first()) == (4e6 + 1, 5e6 + 2)


def test_idw_falls_back_to_the_nearest(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "pid int, x double, y double")
    right = spark.createDataFrame([(1, 0.5, 0.0, 2.0), (2, 1.0, 0.0, 4.0), (3, 60.0, 0.0, 10.0), (4, 0.1, 0.0, None)], "qid int, x double, y double, v double")
    got = {r["pid"]: (r["v"], r["n"]) for r in spatial.idw(left, right, 1.0, "v", closest=2, high=5.0).collect()}
    assert got[1] == ((2 / 0.5 + 4 / 1.0) / 3, 2)
    assert abs(got[2][0] - (5 / 10 + 4 / 49) / (1 / 10 + 1 / 49)) < 1e-12
    assert {r["pid"] for r in spatial.idw(left, right, 1.0, "v").collect()} == {1}


def test_solar_radiation_against_numpy(spark):
    for text in ("2022-08-07T19:30:00", "2024-02-29T03:00:00", "2021-12-31T23:59:00"):
        t = np.datetime64(text)
        d = 6.24004077 + 0.01720197 * ((t - np.datetime64("2000-01-01T00:00")) / np.timedelta64(1, "D"))
        late = -7.659 * np.sin(d) + 9.863 * np.sin(2 * d + 3.5932)
        t = t.astype("M8[us]") + np.timedelta64(int(late * 60e6), "us")
        day = (t - t.astype("M8[Y]")) / np.timedelta64(1, "D")
        tilt = np.pi / 180 * 23.45 * np.sin(2 * np.pi / 365 * (day - 81))
        local = t + np.timedelta64(int(86400 * -122.419 / 360), "s")
        angle = ((local - local.astype("M8[D]")) / np.timedelta64(1, "h") - 12) * np.pi / 12
        lat = 37.775 * np.pi / 180
        want = 1000 * max(0, np.sin(lat) * np.sin(tilt) + np.cos(lat) * np.cos(tilt) * np.cos(angle))
        ts = F.lit(text).cast("timestamp_ntz")
        got = spark.range(1).select(T.solar_radiation(ts), T.equation_of_time(ts)).first()
        assert abs(got[0] - want) < 1e-6 and abs(got[1] - late) < 1e-9


def test_rounds_of_a_long_chain_stay_cheap(spark):
    """3,000 links in a row: what a round plans doesn't grow with the rounds before."""
    import time

    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    shuffled = chain.select((F.col("a") * 1009 % 3001).alias("a"), (F.col("b") * 1009 % 3001).alias("b"))
    began = time.time()
    assert graph.components(shuffled).agg(F.count("*"), F.max("component")).first() == (3001, 0)
    assert time.time() - began < 120
