"""Series without a key, large values, places near a border of buckets, large node numbers, and known projected points."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from fathomline.functions import geometry
from fathomline.operators import filters, lines, mesh_joins, metrics, temporal


@pytest.fixture(scope="module")
def two_series(spark):
    """80 samples of two series, one of them without a key."""
    at = datetime.datetime(2020, 1, 1)
    rows = [(k, i, at + datetime.timedelta(hours=i), math.sin(i / 5) + (k is None), math.cos(i / 7), 1.0) for k in ("a", None) for i in range(40)]
    return spark.createDataFrame(rows, "k string, i int, ts timestamp, x double, y double, z double")


def test_series_without_a_key_are_kept(two_series):
    assert filters.lowpass(two_series, ["k"], ["i"], "x", 1.0, 10.0).where("filtered is not null").groupBy("k").count().count() == 2
    assert metrics.rotated_to_principal(two_series, ["k"], "x", "y").count() == 80
    assert {r["k"]: r["n"] for r in metrics.paired(two_series, ["k"], "x", "y").collect()} == {"a": 40, None: 40}
    assert {r["k"] for r in metrics.windowed_median(two_series, ["k"], "x", 9.0).collect()} == {"a", None}
    merged = temporal.merged_gages(two_series.select("k", "ts", F.col("x").alias("value")), two_series.select("k", "ts", F.col("y").alias("value")), ["k"])
    assert merged.count() == 80 and merged.where("value is null").count() == 0
    later = two_series.where("i >= 30").select("k", F.timestamp_add("DAY", F.lit(9), "ts").alias("ts"), F.col("y").alias("value"))
    assert {r["k"]: r["count"] for r in temporal.merged_gages(two_series.select("k", "ts", F.col("x").alias("value")), later, ["k"]).groupBy("k").count().collect()} == {"a": 50, None: 50}


def test_spreads_of_large_values(spark):
    small = [float(i % 7) for i in range(200)]
    near, far = (spark.createDataFrame([(i, v + off, 1.0 + i % 3) for i, v in enumerate(small)], "id long, v double, w double") for off in (0.0, 1e9))
    a, b = (metrics.bandwidth(x, "v", "w").first() for x in (near, far))
    assert a["spread"] == pytest.approx(b["spread"], rel=1e-6) and a["width"] == pytest.approx(b["width"], rel=1e-6)
    a, b = (metrics.bootstrap(x, "id", "v", 3).orderBy("replicate").collect() for x in (near, far))
    assert [r["variance"] for r in b] == pytest.approx([r["variance"] for r in a], rel=1e-6)
    assert [r["mean"] - 1e9 for r in b] == pytest.approx([r["mean"] for r in a], abs=1e-5)


def test_lines_meet_within_a_distance(spark):
    """Ends 0.0002 apart on both sides of a multiple of the tolerance; 0.02 apart they don't meet."""
    segments = spark.createDataFrame([(1, 0.0, 0.0, 0.9999, 0.0), (2, 1.0001, 0.0, 2.0, 0.0), (3, 2.02, 0.0, 3.0, 0.0), (4, 3.0, 0.0, 4.0, 0.0)], "seg long, x1 double, y1 double, x2 double, y2 double")
    assert {r["seg"]: r["line"] for r in lines.merged(segments, tolerance=0.01).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r["seg"]: r["line"] for r in lines.merged(segments).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_strings_of_large_node_numbers(spark):
    n = 2**40
    e = spark.createDataFrame([(n, n + 1), (n + 1, n + 2), (n + 5, n + 6)], "n1 long, n2 long")
    got = {(r["n1"] - n, r["n2"] - n): tuple(x - n for x in r["string"]) for r in mesh_joins.linear_strings(e).collect()}
    assert got == {(0, 1): (0, 1), (1, 2): (0, 1), (5, 6): (5, 6)}


def test_projected_points(spark):
    """On the meridian a quarter of it is 10,001,965.729 m on this ellipsoid; east and west, north and south mirror each other."""
    df = spark.createDataFrame([(0, -123.0, 0.0), (1, -123.0, 90.0), (2, -121.0, 40.0), (3, -125.0, 40.0), (4, -121.0, -40.0)], "i int, lon double, lat double")
    e, n = geometry.to_utm(F.col("lon"), F.col("lat"), -123.0)
    got = {r["i"]: (r["e"], r["n"]) for r in df.select("i", e.alias("e"), n.alias("n")).collect()}
    assert got[0] == (500_000.0, 0.0)
    assert got[1] == pytest.approx((500_000.0, 10_001_965.729 * 0.9996), abs=0.01)
    assert got[2][0] - 500_000 == pytest.approx(500_000 - got[3][0], abs=1e-6) and got[2][1] == pytest.approx(got[3][1], abs=1e-6)
    assert got[4][1] == pytest.approx(9_999_999 - got[2][1], abs=1e-6)
    # a degree of longitude at 40 degrees: the scale along the parallel, near the meridian, is 0.9996
    parallel = 6378137 * math.cos(math.radians(40)) / math.sqrt(1 - 0.00669437999 * math.sin(math.radians(40)) ** 2) * math.radians(2)
    assert got[2][0] - 500_000 == pytest.approx(parallel * 0.9996, rel=4e-4)
