"""Values of fields, series and meshes at places and times of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.time import micros
from fathomline.operators import lines, mesh_joins, quadtree, raster, temporal
from fathomline.operators.spatial import within_radius
from fathomline.session import shuffled


def at_time(df: DataFrame, keys: list[str], moment: str, value: str, ts: str = "ts") -> DataFrame:
    """``(keys, value, off_seconds)``: each series at one moment, linear between samples and constant beyond, and how far off its nearest sample is."""
    asked = df.select(*keys).distinct().withColumn(ts, F.lit(moment).cast("timestamp_ntz"))
    found = temporal.asof(asked, df.where(F.col(value).isNotNull()), keys, ts, value)
    back, ahead = micros(F.col(ts)) - micros(F.col("t0")), micros(F.col("t1")) - micros(F.col(ts))
    mid = F.when(back + ahead == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * back / F.nullif(back + ahead, F.lit(0)))
    at = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(mid)
    return found.select(*keys, at.alias(value), (F.least(F.coalesce(back, ahead), F.coalesce(ahead, back)) / 1e6).alias("off_seconds"))


def cruise_matches(obs: DataFrame, model: DataFrame, stations: DataFrame, radius: float, value: str = "value", ts: str = "ts") -> DataFrame:
    """``obs(oid, x, y, depth, ts)`` with the value of a model ``(station, ts, depth, value)``: at the nearest station ``(station, x, y)`` within ``radius``, its first time at or after, and there the first depth at or below.

    Observations without such a station, time or depth have no row.
    """
    near = within_radius(obs.select("oid", "x", "y"), stations, radius, "oid", "station").groupBy("oid").agg(F.min(F.struct("d", "station"))["station"].alias("station"))
    placed = obs.join(near, "oid")
    times = model.select("station", ts).distinct().withColumn("_v", F.lit(1))
    timed = temporal.asof(placed, times, ["station"], ts, "_v").where("t1 is not null").drop("t0", "v0", "v1")
    m = model.where(F.col(value).isNotNull()).select(F.col("station").alias("ms"), F.col(ts).alias("mt"), F.col("depth").alias("md"), F.col(value).alias("mv"))
    met = timed.join(m, (F.col("station") == F.col("ms")) & (F.col("t1") == F.col("mt")) & (F.col("md") >= F.col("depth")))
    best = met.groupBy("oid").agg(F.min(F.struct("md", "mv", "mt", "ms")).alias("b"))
    return best.select("oid", F.col("b.ms").alias("station"), F.col("b.mt").alias("model_ts"), F.col("b.md").alias("model_depth"), F.col("b.mv").alias("model_value"))


def paired_points(left: DataFrame, right: DataFrame, radius: float, value: str = "value", lid: str = "pid", rid: str = "qid") -> DataFrame:
    """``(lid, rid, value, other)``: points with the nearest of the other field within ``radius``, the smallest of equally near ones; those without have no row.

    Only places are compared: of points in one place the smallest is first, and the nearest place of each comes from a circle by
    density, see ``quadtree.nearest``, so neither copies nor crowds make pairs that grow as their square.
    """
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_p")
    own = left.select(lid, place)
    firsts = right.groupBy("x", "y").agg(F.min(F.struct(rid, value)).alias("_r"))
    near = quadtree.nearest(left.select("x", "y", place).dropDuplicates(["_p"]), firsts, 1, "_p", "_r").where(F.col("d") <= radius)
    best = own.join(shuffled(near.select("_p", "d", "_r")), "_p").groupBy(lid).agg(F.min(F.struct("d", F.col(f"_r.{rid}").alias(rid), F.col(f"_r.{value}").alias(value))).alias("b"))
    return best.join(shuffled(left.select(lid, value)), lid).select(lid, F.col(f"b.{rid}").alias(rid), value, F.col(f"b.{value}").alias("other"))


def along_edges(edges: DataFrame, grid: DataFrame, eid: str, samples: int = 5) -> DataFrame:
    """``(eid, value)``: mean of the cells of a raster at evenly spaced points of segments in cell coordinates; missing ones are left out."""
    at = lines.sampled(edges, eid, samples).withColumn("pid", F.struct(eid, "k"))
    return raster.nearest_cell(at, grid).groupBy(F.col(f"pid.{eid}").alias(eid)).agg(F.avg("value").alias("value"))


def first_raster(points: DataFrame, cells: DataFrame, rasters: DataFrame, pid: str = "pid") -> DataFrame:
    """``(pid, value)``: of rasters ``(name, priority, resolution, xmin, ymin)`` with ``cells(name, row, col, value)`` the first, by priority, resolution and name, that has a value at a point.

    Rasters are a catalogue's and broadcast.
    """
    r = F.broadcast(rasters.select("name", "priority", "resolution", "xmin", "ymin"))
    at = points.join(r).select(pid, "name", "priority", "resolution", *(F.floor((F.col(c) - F.col(f"{c}min")) / F.col("resolution")).alias(n) for c, n in (("y", "row"), ("x", "col"))))
    met = at.join(cells.where("value is not null"), ["name", "row", "col"])
    return met.groupBy(pid).agg(F.min_by("value", F.struct("priority", "resolution", "name")).alias("value"))


def transect_of_cells(line: DataFrame, keys: list[str], spacing: float, cell_nodes: DataFrame, nodes: DataFrame, values: DataFrame, size: float) -> DataFrame:
    """``(keys, pos, x, y, along, cell, value)``: points each ``spacing`` along a line with the cell that holds each and its value; null outside the mesh."""
    s = lines.resampled(line, keys, spacing).withColumn("pid", F.struct(*keys, "pos"))
    held = mesh_joins.points_to_cells(s, cell_nodes, nodes, size)
    found = held.join(values.select("cell", "value"), "cell", "left")
    return s.join(found, "pid").select(*keys, "pos", "x", "y", "along", "cell", "value")


def period_of_record(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``(keys, begin, end, n)``."""
    return df.groupBy(*keys).agg(F.min(ts).alias("begin"), F.max(ts).alias("end"), F.count("*").alias("n"))


def column_average(t: DataFrame, keys: list[str], z: str, value: str, low: float, high: float) -> DataFrame:
    """``(keys, mean)``: mean of a value over heights from ``low`` to ``high``, linear between samples (trapezoids); only what the samples span counts."""
    w = Window.partitionBy(*keys).orderBy(z)
    s = t.where(F.col(value).isNotNull()).select(*keys, F.col(z).alias("a"), F.col(value).alias("va"), F.lead(z).over(w).alias("b"), F.lead(value).over(w).alias("vb"))
    s = s.where(F.col("b") > F.col("a")).withColumns({"p": F.greatest("a", F.lit(float(low))), "q": F.least("b", F.lit(float(high)))}).where("q > p")
    slope = (F.col("vb") - F.col("va")) / (F.col("b") - F.col("a"))
    mid = F.col("va") + slope * ((F.col("p") + F.col("q")) / 2 - F.col("a"))
    return s.groupBy(*keys).agg((F.sum(mid * (F.col("q") - F.col("p"))) / F.sum(F.col("q") - F.col("p"))).alias("mean"))
