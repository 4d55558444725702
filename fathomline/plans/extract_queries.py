"""Extracts, mesh texts and observation formats over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geometry as G
from fathomline.operators import extracts, lines, mesh_joins, metrics, raster, reshape, select, spatial, tides, transect
from fathomline.operators import temporal as S
from fathomline.plans.more_queries import _HOLDS, _LAT, _PROBES, _cell_values, _lat, _probes, lattice
from fathomline.plans.series_queries import events, r6, table
from fathomline.plans.space_queries import _GRID, _PTS, grid, points
from fathomline.sources import grids
from fathomline.sources import observations as O


def _rdb(s: SparkSession, d: str) -> DataFrame:
    """Events as a table of a gauge with a column of values and one of their qualifiers, read as a series."""
    e = events(s, d).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("datetime"), F.when(F.col("event_id") % 2 == 0, "PST").otherwise("EDT").alias("tz_cd"), F.when(F.col("event_type") == "view", "Ice").otherwise(F.col("value").cast("string")).alias("17_00060_00003"), F.lit("A").alias("17_00060_00003_cd"))
    return O.rdb_series(e)


def _weather(s: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    rec = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.concat(F.lpad((n % 24 + 1).cast("string"), 2, "0"), F.lit("00")).alias("Hour"), F.col("o_custkey").cast("string").alias("Station"), F.struct(F.when(n % 5 == 0, "--").otherwise((n % 40).cast("string")).alias("Value"), F.lit("Y").alias("Qc")).alias("HlyAirTmp"))
    j = table(s, d, "orders").select(F.to_json(F.struct(F.struct(F.array(F.struct(F.array(rec).alias("Records"))).alias("Providers")).alias("Data"))).alias("j"))
    return O.weather_records(j, "j", ["HlyAirTmp"]).groupBy("station", "ts").agg(F.count("*").alias("n"), F.sum("HlyAirTmp").alias("total"), F.max("HlyAirTmp_qc").alias("qc"))


def _items(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).groupBy("user_id").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime"), F.col("event_type").alias("measure"), "value")).alias("items"))
    j = rows.select(F.to_json(F.struct(F.struct(F.lit(70).alias("limit")).alias("meta"), "items")).alias("j"))
    return O.gauge_items(j, "j").groupBy("measure", "full").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first"))


def _buoys(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_type") == "view", F.lit(999.0)).otherwise(F.col("value"))
    line = F.concat_ws("  ", F.date_format("ts", "yyyy MM dd HH mm"), F.col("event_id").cast("string"), t.cast("string"))
    return O.buoy_rows(events(s, d).select(line.alias("value")), ["id", "WTMP"]).select(F.col("id").cast("long").alias("id"), "ts", "WTMP")


def _two_meshes(s: SparkSession, d: str, write, read) -> DataFrame:
    nodes, ring = lattice(s, d)
    n, r = read(write(nodes, ring))
    return r.join(n, "node").groupBy("cell").agg(F.sum((F.col("pos") + 1) * F.col("node")).alias("places"), F.round(F.sum("x"), 6).alias("x"), F.round(F.sum("y"), 6).alias("y"))


_TWO = f"with {_LAT} select cell, cast(sum((pos + 1) * node) as bigint) as places, round(sum(x), 6) as x, round(sum(y), 6) as y from ring join nodes using (node) group by 1"


def _transect(s: SparkSession, d: str) -> DataFrame:
    nodes, ring = lattice(s, d)
    line = _probes(s, d).where("pid < 4").select(F.lit(1).alias("k"), F.col("pid").alias("pos"), "x", "y")
    found = extracts.transect_of_cells(line, ["k"], 0.37, ring, nodes, _cell_values(s, d), 1.0)
    return found.groupBy("cell").agg(F.count("*").alias("n"), F.max("value").alias("value"))


def _crossed(s: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey")
    seg = table(s, d, "supplier").select(n.alias("seg"), (n % 5).cast("double").alias("x1"), (n % 7).cast("double").alias("y1"), ((n + 3) % 5).cast("double").alias("x2"), ((n * 2) % 7).cast("double").alias("y2"))
    return extracts.along_edges(seg, grid(s, d), "seg").withColumn("value", F.round("value", 6))


Q = {
    "rdb_series": (
        _rdb,
        """select event_id, date_trunc('minute', ts) + case when event_id % 2 = 0 then interval 8 hour else interval 4 hour end as ts, 'stream_flow' as parameter, 'mean' as statistic, case when event_type <> 'view' then value end as value from events""",
    ),
    "weather_records": (
        _weather,
        """select cast(o_custkey as varchar) as station, date_trunc('day', o_orderdate) + to_hours(cast(o_orderkey % 24 + 1 as integer)) as ts, count(*) as n, sum(case when o_orderkey % 5 <> 0 then cast(o_orderkey % 40 as double) end) as total, 'Y' as qc from orders group by 1, 2""",
    ),
    "gauge_items": (
        _items,
        """with u as (select user_id, count(*) = 70 as f from events group by 1) select event_type as measure, f as "full", count(*) as n, round(sum(value), 2) as total, min(date_trunc('second', ts)) as first from events join u using (user_id) group by 1, 2""",
    ),
    "buoy_rows": (_buoys, "select event_id as id, date_trunc('minute', ts) as ts, case when event_type <> 'view' then value end as WTMP from events"),
    "dated_values": (
        lambda s, d: O.dated_values(table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yy").alias("t"), F.col("o_totalprice").cast("string").alias("v")), "t", "v", "MM/dd/yy", 2030).groupBy("ts").agg(F.round(F.sum("value"), 2).alias("total")),
        "select date_trunc('day', o_orderdate)::timestamp as ts, round(sum(o_totalprice), 2) as total from orders group by 1",
    ),
    "timed_values": (
        lambda s, d: O.timed_values(table(s, d, "part").select(F.concat_ws(" ", F.col("p_partkey") * 7, F.col("p_size") / 4, F.lit("# said")).alias("value")), "2020-01-01", "M"),
        "select timestamp '2020-01-01' + to_minutes(p_partkey * 7) as ts, p_size / 4.0::double as val1 from part",
    ),
    "xyz_points": (
        lambda s, d: r6(O.xyz_points(points(s, d).select(F.concat_ws(", ", "x", "y", "f").alias("value"))), "x", "y"), f"select round(x, 6) as x, round(y, 6) as y, f as z from ({_PTS})"),
    "salinity": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(O.salinity(F.col("p_retailprice") * 20), 4).alias("salinity")),
        """with c as (select p_partkey, sqrt(p_retailprice * 20 / 1000 / 42.914::double / (0.6766097::double + 2.00564e-2::double * t + 1.104259e-4::double * t ** 2 - 6.9698e-7::double * t ** 3 + 1.0031e-9::double * t ** 4)) as r, t from part, (select 25.0::double * 1.00024::double as t))
        select p_partkey, round(0.0080::double - 0.1692::double * r + 25.3851::double * r ** 2 + 14.0941::double * r ** 3 - 7.0261::double * r ** 4 + 2.7081::double * r ** 5
          + (t - 15) / (1 + 0.0162::double * (t - 15)) * (0.0005::double - 0.0056::double * r - 0.0066::double * r ** 2 - 0.0375::double * r ** 3 + 0.0636::double * r ** 4 - 0.0144::double * r ** 5), 4) as salinity from c""",
    ),
    "local_series": (
        lambda s, d: O.local_series(table(s, d, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("t")), "t", "America/Los_Angeles").select("o_orderkey", F.col("ts").isNotNull().alias("known")),
        None,
    ),
    "period_of_record": (lambda s, d: extracts.period_of_record(events(s, d), ["user_id"]), 'select user_id, min(ts) as begin, max(ts) as "end", count(*) as n from events group by 1'),
    "mesh_2dm": (lambda s, d: _two_meshes(s, d, grids.write_2dm, grids.read_2dm), _TWO),
    "mesh_gr3": (lambda s, d: _two_meshes(s, d, grids.write_gr3, grids.read_gr3), _TWO),
    "at_time": (
        lambda s, d: r6(extracts.at_time(events(s, d), ["user_id"], "2024-01-15 00:00:00", "value"), "value", "off_seconds"),
        """with m as (select 1705276800000000 as t), c as (select user_id, any_value(t) as t, max(epoch_us(ts)) filter (epoch_us(ts) <= t) as t0, min(epoch_us(ts)) filter (epoch_us(ts) >= t) as t1,
          arg_max(value, ts) filter (epoch_us(ts) <= t) as v0, arg_min(value, ts) filter (epoch_us(ts) >= t) as v1 from events, m group by 1)
        select user_id, round(case when t0 is null then v1 when t1 is null then v0 when t0 = t1 then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end, 6) as value, round(least(coalesce(t - t0, t1 - t), coalesce(t1 - t, t - t0)) / 1e6::double, 6) as off_seconds from c""",
    ),
    "paired_points": (
        lambda s, d: extracts.paired_points(points(s, d).withColumnRenamed("f", "value"), points(s, d, "qid").where("qid % 3 = 0").withColumnRenamed("f", "value"), 0.05),
        f"""with p as ({_PTS}), k as (select a.pid, b.pid as qid, a.f as value, b.f as other, row_number() over (partition by a.pid order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.pid) as k
          from p a join p b on b.pid % 3 = 0 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05) select pid, qid, value, other from k where k = 1""",
    ),
    "value_on_edges": (
        _crossed,
        f"""with g as ({_GRID}), s as (select s_suppkey as seg, s_suppkey % 5 as x1, s_suppkey % 7 as y1, (s_suppkey + 3) % 5 as x2, s_suppkey * 2 % 7 as y2 from supplier), k as (select seg, x1 + k / 4.0::double * (x2 - x1) as x, y1 + k / 4.0::double * (y2 - y1) as y from s, (select unnest(range(0, 5)) as k))
        select seg, round(avg(value), 6) as value from k left join g on g.row = floor(y + 0.49::double) and g.col = floor(x + 0.49::double) group by 1""",
    ),
    "transect_of_cells": (
        _transect,
        f"""with {_LAT}, q as (select s_suppkey as pos, s_suppkey * 7 % 390 / 10.0::double + 0.013::double as x, s_suppkey * 3 % 40 / 10.0::double + 0.017::double as y from supplier where s_suppkey < 4),
        s as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as d from q window w as (order by pos)), a as (select *, sum(d) over (order by pos rows unbounded preceding) as a from s),
        z as (select *, lead(a) over w as l, lead(x) over w as x1, lead(y) over w as y1 from a window w as (order by pos)),
        k as (select *, unnest(case when l is null then [a] else list_transform(range(cast(ceil(a / 0.37::double) as bigint), cast(ceil(l / 0.37::double) as bigint)), lambda i: i * 0.37::double) end) as pt from z),
        p as (select row_number() over (order by pt) as pid, x + coalesce((pt - a) / nullif(l - a, 0), 0) * coalesce(x1 - x, 0) as x, y + coalesce((pt - a) / nullif(l - a, 0), 0) * coalesce(y1 - y, 0) as y from k), {_HOLDS}
        select held.cell, count(*) as n, max(cv.value) as value from p left join held using (pid) left join cv on cv.cell = held.cell group by 1""",
    ),
    "column_average": (
        lambda s, d: r6(extracts.column_average(table(s, d, "lineitem").groupBy("l_orderkey", "l_quantity").agg((F.max("l_extendedprice") * 1.4142135623).alias("v")), ["l_orderkey"], "l_quantity", "v", 10.0, 30.0), "mean"),
        """with p as (select l_orderkey, l_quantity as a, max(l_extendedprice) * 1.4142135623::double as va from lineitem group by 1, 2), q as (select *, lead(a) over w as b, lead(va) over w as vb from p window w as (partition by l_orderkey order by a)),
        r as (select *, greatest(a, 10.0::double) as p, least(b, 30.0::double) as q from q where b > a) select l_orderkey, round(sum((va + (vb - va) / (b - a) * ((p + q) / 2 - a)) * (q - p)) / sum(q - p), 6) as mean from r where q > p group by 1""",
    ),
    "area_by_region": (
        lambda s, d: r6(mesh_joins.area_by_region(lattice(s, d)[1], lattice(s, d)[0], s.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(2.1, 0.3), (20.3, 0.4), (11.2, 4.7)])], "poly int, pos int, x double, y double"), 5.0), "area"),
        f"""with {_LAT}, c as (select * from (values (0, 2.1::double, 0.3::double, 20.3::double, 0.4::double), (1, 20.3::double, 0.4::double, 11.2::double, 4.7::double), (2, 11.2::double, 4.7::double, 2.1::double, 0.3::double)) as c(k, x0, y0, x1, y1)),
        i as (select cell, any_value(area) as area, sum(case when ((y0 <= cy) <> (y1 <= cy)) and cx < x0 + (cy - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) as n from g, c group by cell)
        select 1 as poly, round(sum(abs(area)), 6) as area, count(*) as cells from i where n % 2 = 1""",
    ),
    "volume_at_level": (
        lambda s, d: r6(mesh_joins.volume_at(table(s, d, "part").select(F.col("p_size").cast("double").alias("area"), (F.col("p_retailprice") / 1000).alias("depth")), 1.2), "volume", "wet_area"),
        "select round(sum(p_size * greatest(0, 1.2::double - p_retailprice / 1000)), 6) as volume, cast(sum(case when 1.2::double - p_retailprice / 1000 > 0 then p_size else 0 end) as double) as wet_area from part",
    ),
    "cells_in_box": (lambda s, d: mesh_joins.cells_clipped(lattice(s, d)[1], lattice(s, d)[0], (2.5, 9.5, 0.5, 3.5)), f"with {_LAT} select cell from g where cx between 2.5 and 9.5 and cy between 0.5 and 3.5"),
    "main_component": (lambda s, d: mesh_joins.main_component(_lat(s, d)[2].where("(left + right) % 13 <> 1"), _lat(s, d)[1].select("cell").distinct()), None),
    "cell_mean_of_pixels": (
        lambda s, d: r6(mesh_joins.cell_mean_of_pixels(_probes(s, d).withColumn("value", F.col("pid") * 1.5), lattice(s, d)[1], lattice(s, d)[0], 1.0), "mean"),
        f"with {_LAT}, {_PROBES}, {_HOLDS} select cell, round(avg(pid * 1.5::double), 6) as mean, count(*) as n from held group by 1",
    ),
    "polygon_circumcentres": (
        lambda s, d: r6(mesh_joins.polygon_circumcentre(lattice(s, d)[1], lattice(s, d)[0]), "x", "y"),
        f"""with {_LAT}, t as (select p.cell, a.x as ax, a.y as ay, b.x - a.x as bx, b.y - a.y as b_y, c.x - a.x as cx, c.y - a.y as c_y from h p join h q on q.cell = p.cell and q.a = p.b join nodes a on a.node = p.a join nodes b on b.node = p.b join nodes c on c.node = q.b)
        select cell, round(avg(ax + (c_y * (bx * bx + b_y * b_y) - b_y * (cx * cx + c_y * c_y)) / (2 * (bx * c_y - b_y * cx))), 6) as x, round(avg(ay + (bx * (cx * cx + c_y * c_y) - cx * (bx * bx + b_y * b_y)) / (2 * (bx * c_y - b_y * cx))), 6) as y from t group by 1""",
    ),
    "dual_edges": (lambda s, d: mesh_joins.dual(_lat(s, d)[2], _lat(s, d)[1], _lat(s, d)[0])[1], f"with {_LAT} select distinct least(l, r) as n1, greatest(l, r) as n2 from e where l is not null and r is not null"),
    "growing_scale": (
        lambda s, d: r6(raster.growing_scale(points(s, d), s.createDataFrame([(0.0, 0.0, 1.0), (0.3, -0.2, 0.9)], "x double, y double, value double"), 1.3), "value"),
        f"select pid, round(least(1 + 0.3::double * sqrt(x * x + y * y), 0.9::double + 0.3::double * sqrt((x - 0.3::double) ** 2 + (y + 0.2::double) ** 2)), 6) as value from ({_PTS})",
    ),
    "rectified_points": (
        lambda s, d: r6(raster.rectified(points(s, d).withColumnRenamed("f", "value"), 0.25, 0.2), "value"),
        f"select cast(round_even(y / 0.2::double, 0) as bigint) as row, cast(round_even(x / 0.25::double, 0) as bigint) as col, round(avg(f), 6) as value from ({_PTS}) group by 1, 2",
    ),
    "extrapolated_columns": (
        lambda s, d: transect.extrapolated(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("z"), F.when(F.col("l_linenumber").between(2, 4), F.col("l_quantity")).alias("v")), "v", "z", ["l_orderkey"], surface="zero").select("l_orderkey", "l_linenumber", "v"),
        """with e as (select l_orderkey, l_linenumber as z, case when l_linenumber between 2 and 4 then l_quantity end as v from lineitem), b as (select l_orderkey, min(z) filter (v is not null) as lo, max(z) filter (v is not null) as hi, arg_min(v, {'z': z, 'v': v}) filter (v is not null) as a from e group by 1)
        select l_orderkey, z as l_linenumber, coalesce(v, case when z < lo then a end, case when z > hi then 0.0 end) as v from e join b using (l_orderkey)""",
    ),
    "shifted_series": (
        lambda s, d: r6(S.shifted(events(s, d), "value", 1.5, 3600.0, 2.0, 10.0).select("event_id", "ts", "value"), "value"), "select event_id, ts + interval 1 hour as ts, round((value - 10) * 1.5::double + 12, 6) as value from events"),
    "subsets": (lambda s, d: reshape.subsets(table(s, d, "nation").where("n_regionkey < 3"), "n_regionkey", 1, 2).select(F.element_at("members", 1).alias("a"), F.size("members").cast("long").alias("n")).groupBy("a", "n").agg(F.count("*").alias("many")), "with v as (select distinct n_regionkey as k from nation where n_regionkey < 3), s as (select k as a, 1 as n from v union all select x.k, 2 from v x join v y on x.k < y.k) select a, cast(n as bigint) as n, count(*) as many from s group by 1, 2"),
    "harmonic_stage": (
        lambda s, d: r6(tides.harmonic_stage(events(s, d), [("M2", 1.2, 30.0), ("K1", 0.4, 200.0)], mean=0.5).select("event_id", "stage"), "stage"),
        "select event_id, round(0.5 + 1.2::double * cos(radians(28.984104::double) / 3600 * (epoch_us(ts) / 1e6::double) - radians(30.0::double)) + 0.4::double * cos(radians(15.041069::double) / 3600 * (epoch_us(ts) / 1e6::double) - radians(200.0::double)), 6) as stage from events",
    ),
    "missing_values": (lambda s, d: events(s, d).withColumn("v", F.when(F.col("event_type") == "view", F.lit(float("nan"))).when(F.col("event_type") == "click", F.col("value"))).groupBy("user_id").agg(F.sum(select.missing(F.col("v")).cast("long")).alias("n")), "select user_id, count(*) filter (event_type <> 'click') as n from events group by 1"),
    "crossing_sides": (
        lambda s, d: points(s, d).select("pid", lines.crossing_side((F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y")), (F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.5))).alias("side")), f"select pid, cast(sign(1.0::double * y - 0.5::double * x) as double) as side from ({_PTS})"),
    "points_in_box_bounds": (lambda s, d: r6(spatial.bounds(select.within_box(points(s, d), (-0.1, 0.1, -0.1, 0.1))), "xmin", "xmax", "ymin", "ymax"), f"select round(min(x), 6) as xmin, round(max(x), 6) as xmax, round(min(y), 6) as ymin, round(max(y), 6) as ymax from ({_PTS}) where x between -0.1 and 0.1 and y between -0.1 and 0.1"),
    "nan_rms": (lambda s, d: r6(metrics.nan_rms(events(s, d).withColumn("v", F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.col("value"))), ["user_id"], "v"), "rms"), "select user_id, round(sqrt(avg(value * value)), 6) as rms from events where event_type <> 'view' group by 1"),
    "unit_vectors": (
        lambda s, d: points(s, d).select("pid", G.to_unit(F.array("x", "y")).alias("u"), G.mag(F.array("x", "y")).alias("m")).select("pid", F.round(F.col("u")[0], 6).alias("ux"), F.round("m", 6).alias("length")), f"select pid, round(x / sqrt(x * x + y * y), 6) as ux, round(sqrt(x * x + y * y), 6) as length from ({_PTS})"),
}
