"""Lines as rows of (keys, pos, x, y): lengths, normals, resampling, crossings, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.graph import components
from fathomline.operators.spatial import within_radius
from fathomline.operators.temporal import dist_along


def resampled(line: DataFrame, keys: list[str], spacing: float) -> DataFrame:
    """``(keys, pos, x, y, along)``: points each ``spacing`` along a line from its start, and its last point."""
    w = Window.partitionBy(*keys).orderBy("pos")
    s = dist_along(line, keys, ["pos"], "x", "y")
    s = s.withColumns({"_l": F.lead("along").over(w), "_x": F.lead("x").over(w), "_y": F.lead("y").over(w)})
    first, last = F.ceil(F.col("along") / spacing), F.ceil(F.col("_l") / spacing) - 1
    at = F.when(F.col("_l").isNull(), F.array(F.col("along"))).when(last >= first, F.transform(F.sequence(first, last), lambda k: k * F.lit(float(spacing)))).otherwise(F.array().cast("array<double>"))
    s = s.select(*keys, "x", "y", "_x", "_y", "_l", F.col("along").alias("_a"), F.explode(at).alias("along"))
    share = F.coalesce((F.col("along") - F.col("_a")) / F.nullif(F.col("_l") - F.col("_a"), F.lit(0.0)), F.lit(0.0))
    s = s.select(*keys, "along", (F.col("x") + share * F.coalesce(F.col("_x") - F.col("x"), F.lit(0.0))).alias("x"), (F.col("y") + share * F.coalesce(F.col("_y") - F.col("y"), F.lit(0.0))).alias("y"))
    return s.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("along")) - 1).alias("pos"), "x", "y", "along")


def left_normals(line: DataFrame, keys: list[str]) -> DataFrame:
    """``line`` with unit normals (nx, ny) to its left: of the step from the point before to the one behind."""
    w = Window.partitionBy(*keys).orderBy("pos")
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    s = line.withColumns({"_dx": dx, "_dy": dy}).withColumn("_d", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    return s.withColumns({"nx": -F.col("_dy") / F.nullif(F.col("_d"), F.lit(0.0)), "ny": F.col("_dx") / F.nullif(F.col("_d"), F.lit(0.0))}).drop("_dx", "_dy", "_d")


def crossing_side(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """1 if segment a (x1, y1, x2, y2) heads to the left of segment b's direction, -1 to the right, 0 along it."""
    return F.signum((b[2] - b[0]) * (a[3] - a[1]) - (b[3] - b[1]) * (a[2] - a[0]))


def sampled(edges: DataFrame, eid: str, samples: int = 5) -> DataFrame:
    """``(eid, k, x, y)``: evenly spaced points on segments (x1, y1, x2, y2), both ends among them."""
    s = edges.select(eid, "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    share = F.col("k") / (samples - 1)
    return s.select(eid, "k", (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + share * (F.col("y2") - F.col("y1"))).alias("y"))


def merged(segments: DataFrame, sid: str = "seg", tolerance: float = 0.0) -> DataFrame:
    """``(sid, line)``: segments (x1, y1, x2, y2) of which ends meet, exactly or within ``tolerance``, are one line, named by its smallest segment.

    Ends within ``tolerance`` of each other, directly or through others, are one place.  Where more than two ends meet, lines end.
    """
    ends = segments.select(sid, F.explode(F.array(*(F.struct(F.col(f"x{k}").cast("double").alias("x"), F.col(f"y{k}").cast("double").alias("y")) for k in (1, 2)))).alias("p"))
    if tolerance:
        places = ends.select("p").distinct().select("p", "p.x", "p.y")
        near = within_radius(places, places.withColumnRenamed("p", "q"), tolerance, "p", "q")
        ends = ends.join(components(near.select(F.col("p").alias("a"), F.col("q").alias("b"))), F.col("p") == F.col("id")).select(sid, F.col("component").alias("p"))
    pair = ends.groupBy("p").agg(F.count("*").alias("n"), F.min(sid).alias("a"), F.max(sid).alias("b")).where("n = 2 and a <> b")
    found = components(pair.select("a", "b"))
    return segments.select(sid).join(found.withColumnRenamed("id", sid), sid, "left").select(sid, F.coalesce("component", sid).alias("line"))


def broken_track(track: DataFrame, waypoints: DataFrame, keys: list[str], order: str, accept: float = 400.0, leave: float = 800.0, least: int = 10, wid: str = "way") -> DataFrame:
    """``(keys, start, end, n)``: pieces of a track between its closest approaches to waypoints.

    A visit is a run of samples within ``leave`` of a waypoint; its closest sample breaks the track if it is within ``accept``.
    Pieces have more than ``least`` samples; waypoints are few and broadcast.
    """
    w = Window.partitionBy(*keys, wid).orderBy("_i")
    at = track.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    d = F.sqrt((F.col("x") - F.col("wx")) * (F.col("x") - F.col("wx")) + (F.col("y") - F.col("wy")) * (F.col("y") - F.col("wy")))
    near = at.join(F.broadcast(waypoints.select(wid, F.col("x").alias("wx"), F.col("y").alias("wy"))), d < leave).withColumn("_d", d)
    near = near.withColumn("_g", F.col("_i") - F.row_number().over(w))
    cut = near.groupBy(*keys, wid, "_g").agg(F.min(F.struct("_d", "_i")).alias("_b")).where(F.col("_b._d") < accept).select(*keys, F.col("_b._i").alias("start")).distinct()
    out = cut.withColumn("end", F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))).where("end is not null")
    return out.withColumn("n", F.col("end") - F.col("start")).where(F.col("n") > least)
