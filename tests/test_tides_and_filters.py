"""Operators that SQL can't express, against plain numpy versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import time as T
from fathomline.operators import filters, metrics, mesh_joins, reshape, temporal, tides
from fathomline.plans import more_queries

BEGIN = dt.datetime(2020, 1, 1)


def series(spark, values, minutes=60, key="a"):
    rows = [(key, BEGIN + dt.timedelta(minutes=minutes * k), None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def slow_filter(b, a, x, state):
    out, past_x, past_y = [], [], []
    s = list(state)
    for v in x:
        y = b[0] * v + s[0]
        s = [b[i + 1] * v - a[i + 1] * y + (s[i + 1] if i + 1 < len(s) else 0.0) for i in range(len(s))]
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("block", [20_000, 50])
def test_lowpass_is_one_pass_over_the_whole_series(spark, monkeypatch, block):
    monkeypatch.setattr(filters, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=3000))
    b, a = filters.butter(4, 1 / 6)
    assert np.allclose(b.sum() / a.sum(), 1) and abs(abs(np.polyval(b, np.exp(1j * math.pi / 6)) / np.polyval(a, np.exp(1j * math.pi / 6))) - math.sqrt(0.5)) < 1e-12
    n = len(a) - 1
    m = np.zeros((n, n))
    m[:, 0] = -a[1:]
    m[:-1, 1:] = np.eye(n - 1)
    zi = np.linalg.solve(np.eye(n) - m, b[1:] - a[1:] * b[0])
    long = np.concatenate([2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]])
    there = slow_filter(b, a, long, zi * long[0])[::-1]
    want = slow_filter(b, a, there, zi * there[0])[::-1][15:-15]
    df = series(spark, x)
    got = column(filters.lowpass(df, ["k"], ["ts"], "v", 1.0, 6.0), "filtered")
    assert np.abs(np.array(got) - want).max() < 1e-9 * np.abs(x).max()
    causal = column(filters.lowpass(df, ["k"], ["ts"], "v", 1.0, 6.0, causal=True), "filtered")
    assert np.abs(np.array(causal) - slow_filter(b, a, x, np.zeros(4))).max() < 1e-9 * np.abs(x).max()


def test_lowpass_has_half_its_response_at_twice_the_cutoff(spark):
    for period, share in ((24.0, 0.5), (240.0, 1.0), (6.0, 0.0)):
        x = np.sin(2 * math.pi * np.arange(4000) / period)
        got = np.array(column(filters.lowpass(series(spark, x), ["k"], ["ts"], "v", 1.0, 12.0), "filtered"))
        assert abs(np.abs(got[1000:3000]).max() - share) < 0.01


def test_lowpass_of_short_and_broken_series(spark):
    df = series(spark, range(15)).union(series(spark, [1.0, None] * 20, key="b")).union(series(spark, range(16), key="c"))
    got = {r["k"]: r["n"] for r in filters.lowpass(df, ["k"], ["ts"], "v", 1.0, 6.0).groupBy("k").agg(F.count("filtered").alias("n")).collect()}
    assert got == {"a": 0, "b": 0, "c": 16}


def plain_datum(t, h, stat, daily):
    step = np.median(np.diff(t))
    per = 12.42 * 60 / step
    a = h - h.mean()
    i0 = int(np.flatnonzero(a[:-1] * a[1:] < 0)[0])
    months = int((t[-1] - t[i0]) / (12.42 * 60 * 57))
    f = min if stat == "min" else max
    ends = [int(i0 + round(k * per)) for k in range(57 * months + 1)]
    found = [f(h[p:q]) for p, q in zip(ends[:-1], ends[1:])]
    if daily:
        found = [f(found[k : k + 2]) for k in range(0, len(found) - 1, 2)]
    return sum(found) / len(found)


def tide(n, minutes):
    t = np.arange(n) * minutes
    return t, np.cos(2 * math.pi * t / (12.42 * 60)) + 0.4 * np.cos(2 * math.pi * t / (23.93 * 60) + 1) + 0.2


@pytest.mark.parametrize(("stat", "daily"), [("min", True), ("max", False), ("max", True), ("min", False)])
def test_tidal_datums(spark, stat, daily):
    t, h = tide(4000, 30)
    got = tides.tidal_datum(series(spark, h, 30), ["k"], "v", stat, daily).first()["datum"]
    assert abs(got - plain_datum(t, h, stat, daily)) < 1e-12


def test_omegas_that_a_series_can_tell_apart():
    whole = tides.names_to_omegas(list(tides.SPEEDS))
    assert tides.omegas_to_names([0.0, *whole]) == ["DC", *tides.SPEEDS]
    assert abs(2 * math.pi / tides.names_to_omegas(["M2"])[0] / 3600 - 12.4206) < 1e-3
    for days in (3, 15, 30, 400):
        left = tides.select_omegas(days * 86400.0)
        beats = np.diff([0.0, *left])
        assert (beats >= 0.25 * 2 * math.pi / (days * 86400.0)).all() and whole[0] in left
    assert tides.select_omegas(365.25 * 10 * 86400.0) == sorted(whole)
    # Of two that can't be told apart the one earlier in the list stays.
    assert tides.select_omegas(86400.0, [2e-4, 1.99e-4]) == [2e-4] and tides.select_omegas(86400.0, [1.99e-4, 2e-4]) == [1.99e-4]


def test_slack_water_phases_and_hours(spark):
    n = 24 * 20
    u = np.sin(2 * math.pi * (np.arange(n) - 3.3) / 12.0)
    df = series(spark, u)
    slack = tides.slack_water(df, ["k"], "v", 1.0, leave_mean=True)
    hours = sorted(((r["slack"] - BEGIN).total_seconds() / 3600, r["rising"]) for r in slack.collect())
    inner = [x for x in hours if 5 < x[0] < n - 5]
    assert all(abs((h - 3.3) / 6 - round((h - 3.3) / 6)) < 0.05 for h, _ in inner)
    assert all(up == (round((h - 3.3) / 6) % 2 == 0) for h, up in inner)
    ebb = tides.phases(slack, ["k"], "ebb").collect()
    assert all(abs((r["end"] - r["start"]).total_seconds() / 3600 - 6) < 0.2 for r in ebb[1:-1])
    got = tides.tidal_hour(df, slack, ["k"]).orderBy("ts").collect()
    for k, r in list(enumerate(got))[20:-20]:
        want = (6 + k - 3.3) % 12
        assert min(abs(r["hour"] - want), 12 - abs(r["hour"] - want)) < 0.2


def test_filled_tide_is_near_the_truth_in_a_gap(spark):
    t, h = tide(24 * 40, 60)
    gone = [None if 300 <= k < 330 else v for k, v in enumerate(h)]
    df = series(spark, gone).where("v is not null")
    got = np.array(column(tides.filled_tide(df, ["k"], "v", 3600.0, tides.select_omegas(40 * 86400.0)), "v"))
    assert len(got) == len(h) and np.abs(got - h)[300:330].max() < 0.1 and np.abs(got - h)[:300].max() == 0


def test_windowed_slope_of_a_line(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    df = series(spark, x).withColumn("w", 3 * F.col("v") + 1)
    got = column(filters.windowed_slope(df, ["k"], ["ts"], "v", "w", 24), "slope")
    assert np.abs(np.array(got)[30:-30] - 3).max() < 1e-9


def test_nearest_mean_and_downcasts(spark):
    df = series(spark, [0.0, -1, -2, -3, -4, -5, -4, -3, -2, -3, -4, -5, -6, -7, -6, -7])
    got = temporal.downcasts(df, ["k"], "ts", "v", -0.5, 3).collect()
    assert [(r["cast"], r["start"].hour, r["end"].hour, r["n"]) for r in got] == [(0, 1, 4, 4), (1, 8, 12, 5)]


def test_bootstrap_is_near_and_repeatable(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("v"))
    a, b = (sorted(map(tuple, metrics.bootstrap(df, "id", "v", 20, s).collect())) for s in (0, 0))
    means = [x[1] for x in a]
    assert a == b and abs(np.mean(means) - 4.5) < 0.1 and 0.02 < np.std(means) < 0.2


def test_weighted_sum_needs_all_series(spark):
    a, b = series(spark, [1, 2]), series(spark, [10, 20])
    assert column(temporal.weighted_sum({"a": a, "b": b}, {"a": 1, "b": 0.5}, value="v"), "v") == [6.0, 12.0]
    with pytest.raises(Exception, match="not all series"):
        temporal.weighted_sum({"a": a, "b": series(spark, [1])}, {"a": 1, "b": 1}, value="v").collect()


def test_meshes_added_at_a_common_side(spark):
    from fathomline.operators.mesh import edges_of, rectilinear

    nodes, ring = rectilinear(spark, 2, 2)
    more = nodes.select("node", (F.col("x") + 2.0004).alias("x"), "y")
    n, r, mapping = mesh_joins.added(nodes, ring, more, ring, 0.01)
    assert n.count() == 15 and r.select("cell").distinct().count() == 8
    e = edges_of(r)
    assert e.where("left is null or right is null").count() == 12 and mapping.where("into < 9").count() == 3
    assert mesh_joins.main_component(e, r.select("cell").distinct()).count() == 8
    assert mesh_joins.boundary_rings(e).select("ring").distinct().count() == 1


def test_names_without_common_parts(spark):
    df = spark.createDataFrame([("run_a_2020.nc",), ("run_b_2020.nc",)], "name string")
    assert sorted(r["short"] for r in reshape.distinct_parts(df, "name").collect()) == ["a", "b"]
    one = spark.createDataFrame([("only one",)], "name string")
    assert [r["short"] for r in reshape.distinct_parts(one, "name").collect()] == ["one"]


def test_parsed_intervals(spark):
    cases = [("2020:2021", "2020-01-01", "2021-01-01"), (":20200103", "2020-01-01", "2020-01-03"), ("-1d", "2020-01-07", "2020-01-08"), ("+12h", "2020-01-01", "2020-01-01 12:00:00"), ("202001:+1.5d", "2020-01-01", "2020-01-02 12:00:00"), ("-90m:20200102", "2020-01-01 22:30:00", "2020-01-02"), ("", "2020-01-01", "2020-01-08"), ("2021:2020", None, None)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, s string")
    a, b = T.parsed_interval(F.col("s"), F.lit("2020-01-01").cast("timestamp_ntz"), F.lit("2020-01-08").cast("timestamp_ntz"))
    for r in df.select("k", a.alias("a"), b.alias("b")).collect():
        want = [None if x is None else dt.datetime.fromisoformat(x) for x in cases[r["k"]][1:]]
        assert [r["a"], r["b"]] == want, cases[r["k"]]


def test_shortest_path_query_is_dijkstra(spark):
    import heapq

    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in more_queries.Q["shortest_path"][0](spark, sf).orderBy("distance").collect()]
    near = {}
    for a, b in {(r["l_partkey"] * 2, r["l_suppkey"] * 2 + 1) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}:
        w = 1 + (a * 7 + b * 3) % 11 / 4
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    far, todo = {}, [(0.0, 0)]
    while todo:
        d, n = heapq.heappop(todo)
        if n not in far:
            far[n] = d
            for m, w in near[n]:
                heapq.heappush(todo, (d + w, m))
    assert got[0] == (0, 0.0) and got[-1] == (40, far[40]) and all(far[n] == d for n, d in got)
    assert all(any(m == b and abs(da + w - db) < 1e-12 for m, w in near[a]) for (a, da), (b, db) in zip(got[:-1], got[1:]))
