"""Selections, meshes, rasters, lines, transects and reshapes over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import geometry as G
from fathomline.functions import time as T
from fathomline.operators import filters, graph, lines, mesh, mesh_joins, metrics, raster, reshape, select, spatial, tides, transect
from fathomline.operators import temporal as S
from fathomline.plans.series_queries import _BIN, events, r6, table
from fathomline.plans.space_queries import _GRID, _PTS, _transect, grid, points, supply_edges
from fathomline.session import shuffled
from fathomline.sources import observations as O

BOX = (-0.1, 0.2, -0.2, 0.1)


def lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as the nodes of a lattice 40 wide, shifted a little by size and number, and its quadrangles."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    nodes = p.select(n.alias("node"), (n % 40 + F.col("p_size") / 200.0).alias("x"), (F.floor(n / 40) + (n % 7) / 20.0).alias("y"))
    last = p.select((n - 41).alias("cell"))
    cells = p.select(n.alias("cell")).where("cell % 40 < 39").join(shuffled(last), "cell", "left_semi")
    return nodes, cells.select("cell", F.posexplode(F.array(*(F.col("cell") + k for k in (0, 1, 41, 40)))).alias("pos", "node"))


def _lat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, ring = lattice(spark, sf_dir)
    return nodes, ring, mesh.edges_of(ring)


def _cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.max("l_quantity").alias("value"))


def _edge_values(edges: DataFrame) -> DataFrame:
    return edges.select("n1", "n2", ((F.col("n1") * 7 + F.col("n2") * 3) % 11).cast("double").alias("value"))


_LAT = """nodes as (select p_partkey as node, p_partkey % 40 + p_size / 200.0::double as x, p_partkey // 40 + (p_partkey % 7) / 20.0::double as y from part),
cells as (select p_partkey as cell from part where p_partkey % 40 < 39 and p_partkey + 41 in (select p_partkey from part)),
ring as (select cell, k.pos, cell + k.d as node from cells, (values (0, 0), (1, 1), (2, 41), (3, 40)) as k(pos, d)),
h as (select cell, pos, node as a, coalesce(lead(node) over (partition by cell order by pos), first_value(node) over (partition by cell order by pos)) as b from ring),
e as (select least(a, b) as n1, greatest(a, b) as n2, max(case when a < b then cell end) as l, max(case when a >= b then cell end) as r from h group by 1, 2),
g as (select cell, sum(p.x * q.y - q.x * p.y) / 2 as area, sum((p.x + q.x) * (p.x * q.y - q.x * p.y)) / (3 * sum(p.x * q.y - q.x * p.y)) as cx,
  sum((p.y + q.y) * (p.x * q.y - q.x * p.y)) / (3 * sum(p.x * q.y - q.x * p.y)) as cy from h join nodes p on p.node = a join nodes q on q.node = b group by cell),
eg as (select n1, n2, l, r, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) as len, (p.x + q.x) / 2 as ex, (p.y + q.y) / 2 as ey, (q.y - p.y) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) as nx,
  (p.x - q.x) / sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) as ny, cast((n1 * 7 + n2 * 3) % 11 as double) as value from e join nodes p on p.node = n1 join nodes q on q.node = n2),
cv as (select l_partkey as cell, max(l_quantity) as value from lineitem group by 1)"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points over the lattice."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") * 7 % 390 / 10.0 + 0.013).alias("x"), (F.col("s_suppkey") * 3 % 40 / 10.0 + 0.017).alias("y"))


_PROBES = "p as (select s_suppkey as pid, s_suppkey * 7 % 390 / 10.0::double + 0.013::double as x, s_suppkey * 3 % 40 / 10.0::double + 0.017::double as y from supplier)"
_HOLDS = """b as (select cell, min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb from ring join nodes using (node) group by cell),
m as (select pid, cell, p.x, p.y from p join b on p.x between xa and xb and p.y between ya and yb),
t as (select m.pid, m.cell, sum(case when ((u.y <= m.y) <> (v.y <= m.y)) and m.x < u.x + (m.y - u.y) * (v.x - u.x) / nullif(v.y - u.y, 0) then 1 else 0 end) as k
  from m join h using (cell) join nodes u on u.node = a join nodes v on v.node = b group by 1, 2),
held as (select pid, min(cell) as cell from t where k % 2 = 1 group by 1)"""


def _perot(s: SparkSession, d: str) -> DataFrame:
    nodes, ring, edges = _lat(s, d)
    return r6(mesh.perot(ring, nodes, edges, _edge_values(edges)), "u", "v")


def _normals(s: SparkSession, d: str) -> DataFrame:
    nodes, _, edges = _lat(s, d)
    return r6(mesh.edge_geometry(edges, nodes).select("n1", "n2", "nx", "ny"), "nx", "ny")


def _centroids(s: SparkSession, d: str) -> DataFrame:
    nodes, ring = lattice(s, d)
    return r6(mesh.cell_geometry(ring, nodes).select("cell", "area", "cx", "cy"), "area", "cx", "cy")


def _divergence(s: SparkSession, d: str) -> DataFrame:
    edges = _lat(s, d)[2]
    return mesh.divergence(edges, _edge_values(edges))


def _held(s: SparkSession, d: str) -> DataFrame:
    nodes, ring = lattice(s, d)
    return mesh_joins.points_to_cells(_probes(s, d), ring, nodes, 1.0)


def _nearest_cells(s: SparkSession, d: str) -> DataFrame:
    nodes, ring = lattice(s, d)
    return mesh_joins.cells_nearest(_probes(s, d), ring, nodes, 1.0)


def _matched(s: SparkSession, d: str) -> DataFrame:
    nodes = lattice(s, d)[0]
    moved = nodes.select((F.col("node") + 5000).alias("node"), (F.col("x") + F.when(F.col("node") % 3 == 0, 0.01).otherwise(0.3)).alias("x"), "y")
    return mesh_joins.match_nodes(nodes, moved, 0.05)


def _slopes(s: SparkSession, d: str) -> DataFrame:
    nodes, ring, edges = _lat(s, d)
    return r6(mesh_joins.edge_slopes(edges, ring, nodes, _cell_values(s, d)), "value")


def _islands(s: SparkSession, d: str) -> DataFrame:
    """Cells that stay joined where no edge between a multiple of 5 and its next column may be crossed."""
    _, ring, edges = _lat(s, d)
    cut = edges.where("right is not null and left is not null and (abs(left - right) = 1 and greatest(left, right) % 40 % 5 = 0)").select("n1", "n2")
    return mesh_joins.cell_components(edges, ring.select("cell").distinct(), cut)


def _owners(s: SparkSession, d: str) -> DataFrame:
    """Parts as global cells, suppliers as the processes that hold them; a shipment of one piece makes it a boundary cell."""
    li = table(s, d, "lineitem")
    held = li.groupBy(F.col("l_suppkey").alias("proc"), F.col("l_partkey").alias("cell")).agg(F.min("l_orderkey").alias("local_cell"), (F.min("l_quantity") <= 10).alias("boundary"))
    return mesh_joins.owners(held)


def _series(s: SparkSession, d: str, kind: str) -> DataFrame:
    return events(s, d).where(F.col("event_type") == kind).select("ts", "value")


def _combined(s: SparkSession, d: str) -> DataFrame:
    return r6(metrics.combine_sources({k: _series(s, d, k) for k in ("click", "view")}, 21600), "mean")


def _hourly(s: SparkSession, d: str) -> DataFrame:
    """A mean each hour of each event type that has one."""
    return S.bin_mean(events(s, d), ["event_type"], 3600).select("event_type", F.col("bin").alias("ts"), F.col("mean").alias("value"))


def _nmea(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as position sentences with checksums, each fifth of them wrong, read back."""
    n = F.col("s_suppkey")
    body = F.concat(F.lit("GPRMC,"), F.lpad((n % 24).cast("string"), 2, "0"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit("30.500,A,"), F.lpad((n % 80).cast("string"), 2, "0"), F.lit("30.0000,S,0"), F.lpad((n % 90).cast("string"), 2, "0"), F.lit("15.0000,E,1.0,2.0,0502"), F.lpad((n % 20).cast("string"), 2, "0"), F.lit(",,"))
    total = F.aggregate(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, c: a.bitwiseXOR(c))
    line = F.concat(F.lit("$"), body, F.lit("*"), F.lpad(F.hex(total.bitwiseXOR(F.when(n % 5 == 0, 1).otherwise(0))), 2, "0"))
    return O.fixes(table(s, d, "supplier").select("s_suppkey", line.alias("value"))).select("s_suppkey", "ts", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Events as the JSON answers of a tide station, one for each user, read back."""
    v = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("value").cast("string"))
    rows = events(s, d).groupBy("user_id").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), v.alias("v"))).alias("data"))
    said = rows.select("user_id", F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("id")).alias("metadata"), "data")).alias("j"))
    return O.station_readings(said, "j", ["user_id"]).groupBy("user_id", "station").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("last"))


def _line(s: SparkSession, d: str) -> DataFrame:
    return points(s, d).select(F.col("f").cast("int").alias("f"), F.col("pid").alias("pos"), "x", "y")


Q = {
    "within_half_open": (lambda s, d: select.within(events(s, d), "value", 50, 100, "left").select("event_id", "value"), "select event_id, value from events where value >= 50 and value < 100"),
    "within_box": (lambda s, d: select.within_box(points(s, d), BOX).select("pid", "x", "y"), f"select pid, x, y from ({_PTS}) where x between -0.1 and 0.2 and y between -0.2 and 0.1"),
    "grown_boxes": (
        lambda s, d: r6(select.grown_box(spatial.bounds(points(s, d), keys=["f"]), 0.5), "xmin", "xmax", "ymin", "ymax"),
        f"""with b as (select f, min(x) as a, max(x) as b, min(y) as c, max(y) as d from ({_PTS}) group by 1)
        select f, round(a - (b - a) / 4, 6) as xmin, round(b + (b - a) / 4, 6) as xmax, round(c - (d - c) / 4, 6) as ymin, round(d + (d - c) / 4, 6) as ymax from b""",
    ),
    "split_by_predicate": (
        lambda s, d: select.split_by(events(s, d), F.col("value") > 60)[0].groupBy("user_id").agg(F.count("*").alias("n")).withColumn("side", F.lit("yes")).unionByName(select.split_by(events(s, d), F.col("value") > 60)[1].groupBy("user_id").agg(F.count("*").alias("n")).withColumn("side", F.lit("no"))),
        "select user_id, case when value > 60 then 'yes' else 'no' end as side, count(*) as n from events group by 1, 2",
    ),
    "first_finite": (
        lambda s, d: select.first_finite(events(s, d).withColumn("v", F.when(F.col("event_type") == "view", F.lit(float("nan"))).when(F.col("event_type") != "click", F.col("value"))), ["user_id"], "event_id", "v"),
        "select user_id, arg_min(value, event_id) filter (event_type not in ('view', 'click')) as v from events group by 1",
    ),
    "until_step_back": (
        lambda s, d: select.until_step_back(events(s, d), ["user_id"], ["ts", "event_id"], "value").select("event_id"),
        """with a as (select *, case when value <= lag(value) over (partition by user_id order by ts, event_id) then 1 else 0 end as b from events),
        c as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from a) select event_id from c where s = 0""",
    ),
    "named_like": (lambda s, d: select.named_like(table(s, d, "part"), "p_brand", r"Brand#[12].?").select("p_partkey", "p_brand"), "select p_partkey, p_brand from part where regexp_full_match(p_brand, 'Brand#[12].?')"),
    "sliced": (lambda s, d: select.sliced(table(s, d, "lineitem"), l_linenumber=(2, 4), l_returnflag=["A", "R"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "select l_orderkey, l_linenumber, l_partkey, l_returnflag from lineitem where l_linenumber >= 2 and l_linenumber < 4 and l_returnflag in ('A', 'R')"),
    "trimmed_grid": (
        lambda s, d: select.trimmed(grid(s, d).withColumn("value", F.when(F.col("row").between(3, 30) & (F.col("col") > 5), F.col("value")))),
        f"""with g as (select row, col, case when row between 3 and 30 and col > 5 then value end as value from ({_GRID})), b as (select min(row) as a, max(row) as b, min(col) as c, max(col) as d from g where value is not null)
        select row, col, value from g, b where row between a and b and col between c and d""",
    ),
    "shortest_path": (lambda s, d: graph.shortest_path(supply_edges(s, d).withColumn("w", 1 + F.pmod(F.col("a") * 7 + F.col("b") * 3, F.lit(11)) / 4), 0, 40), None),
    "components_customers": (
        lambda s, d: graph.components(table(s, d, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b"))),
        "with c as (select o_custkey * 2 as a, o_orderkey * 2 + 1 as b from orders), r as (select a, least(a, min(b)) as component from c group by a) select distinct id, component from (select a as id, component from r union all select b, component from c join r using (a))",
    ),
    "dice_windows": (
        lambda s, d: S.dice_interval(events(s, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "a", "b", 432000, 0.5).select("user_id", "window_start", "window_end"),
        """with u as (select user_id, epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from events group by 1), n as (select *, cast(1 + trunc((b - a - 432000e6) / (432000e6 * 0.5::double)) as integer) as n from u),
        k as (select *, unnest(range(0, n)) as k, (b - a) / (n * 0.5::double + 0.5::double) as w from n where n >= 1)
        select user_id, make_timestamp(cast(round(a + k * w * 0.5::double) as bigint)) as window_start, make_timestamp(cast(round(a + k * w * 0.5::double + w) as bigint)) as window_end from k""",
    ),
    "hillshade": (
        lambda s, d: r6(raster.hillshade(grid(s, d).withColumn("value", F.col("value") / 1e5)), "shade"),
        f"""with g as (select row, col, value / 1e5 as v from ({_GRID})), n as (select a.row, a.col, a.v as v, r.v as r, l.v as l, u.v as u, o.v as o from g a left join g r on r.row = a.row and r.col = a.col + 1 left join g l on l.row = a.row and l.col = a.col - 1
          left join g u on u.col = a.col and u.row = a.row + 1 left join g o on o.col = a.col and o.row = a.row - 1),
        t as (select row, col, coalesce((r - l) / 2, r - v, v - l) as gx, coalesce((u - o) / 2, u - v, v - o) as gy from n)
        select row, col, round(cos(radians(45.0)) * cos(atan(10 * sqrt(gx * gx + gy * gy))) + sin(radians(45.0)) * sin(atan(10 * sqrt(gx * gx + gy * gy))) * cos(radians(225.0) - atan2(gy, -gx)), 6) as shade from t""",
    ),
    "solar_radiation": (
        lambda s, d: events(s, d).select("event_id", F.round(T.equation_of_time(F.col("ts")), 6).alias("minutes"), F.round(T.solar_radiation(F.col("ts")), 3).alias("radiation")),
        """with a as (select event_id, epoch_us(ts) as t, 6.24004077::double + 0.01720197::double * ((epoch_us(ts) - 946684800000000) / 86400000000.0::double) as q from events),
        b as (select *, -7.659::double * sin(q) + 9.863::double * sin(2 * q + 3.5932::double) as m from a), c as (select *, t + cast(trunc(m * 60e6::double) as bigint) as u from b),
        f as (select *, (u - epoch_us(date_trunc('year', make_timestamp(u)))) / 86400000000.0::double as day, (u + cast(trunc(86400 * -122.419::double / 360) as bigint) * 1000000) as w from c),
        h as (select *, pi() / 180 * 23.45::double * sin(2 * pi() / 365 * (day - 81)) as decl, (((w % 86400000000) + 86400000000) % 86400000000) / 3.6e9::double as hour from f)
        select event_id, round(m, 6) as minutes, round(greatest(0, 1000 * (sin(radians(37.775::double)) * sin(decl) + cos(radians(37.775::double)) * cos(decl) * cos((hour - 12) * (pi() / 12)))), 3) as radiation from h""",
    ),
    "idw_closest": (
        lambda s, d: r6(spatial.idw(points(s, d), points(s, d, "qid"), 0.02, "f", closest=3), "f"),
        f"""with p as ({_PTS}), j as (select a.pid, b.pid as qid, b.f, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from p a, p b),
        k as (select *, row_number() over (partition by pid order by d, qid) as rank, count(*) filter (d <= 0.02) over (partition by pid) as n from j)
        select pid, round(sum(f / greatest(d, 0.01::double * 0.02::double)) / sum(1 / greatest(d, 0.01::double * 0.02::double)), 6) as f, count(*) as n from k where d <= 0.02 and n >= 3 or rank <= 3 and n < 3 group by 1""",
    ),
    "mesh_centroids": (_centroids, f"with {_LAT} select cell, round(area, 6) as area, round(cx, 6) as cx, round(cy, 6) as cy from g"),
    "edge_normals": (_normals, f"with {_LAT} select n1, n2, round(nx, 6) as nx, round(ny, 6) as ny from eg"),
    "perot": (
        _perot,
        f"""with {_LAT}, s as (select l as cell, * from eg where l is not null union all select r, * from eg where r is not null),
        w as (select s.cell, s.nx, s.ny, s.value * abs((ex - cx) * nx + (ey - cy) * ny) * len / abs(area) as w from s join g on s.cell = g.cell) select cell, round(sum(w * nx), 6) as u, round(sum(w * ny), 6) as v from w group by 1""",
    ),
    "divergence": (_divergence, f"with {_LAT} select cell, sum(value) as net from (select l as cell, value from eg union all select r, -value from eg) where cell is not null group by 1"),
    "edge_to_cell": (lambda s, d: r6(mesh_joins.edge_to_cell(_lat(s, d)[2], _edge_values(_lat(s, d)[2])), "value"), f"with {_LAT} select cell, round(avg(value), 6) as value from (select l as cell, value from eg union all select r, value from eg) where cell is not null group by 1"),
    "edge_slopes": (_slopes, f"with {_LAT}, c as (select g.*, cv.value from g join cv using (cell)) select n1, n2, round(coalesce((b.value - a.value) / sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2), 0), 6) as value from e left join c a on a.cell = l left join c b on b.cell = r"),
    "contour_edges": (lambda s, d: mesh_joins.contour_edges(_lat(s, d)[2], _cell_values(s, d), 47.0), f"with {_LAT} select n1, n2 from e join cv a on a.cell = l join cv b on b.cell = r where (a.value < 47) <> (b.value < 47)"),
    "node_neighbours": (lambda s, d: mesh_joins.node_neighbours(_lat(s, d)[2]), f"with {_LAT} select n1 as node, n2 as other from e union select n2, n1 from e"),
    "boundary_rings": (lambda s, d: mesh_joins.boundary_rings(_lat(s, d)[2]).groupBy("ring").agg(F.count("*").alias("n")), f"with {_LAT}, b as (select n1, n2 from e where l is null or r is null) select (select min(least(n1, n2)) from b) as ring, count(*) as n from b"),
    "cell_components": (_islands, f"with {_LAT} select cell, min(cell) over (partition by cell % 40 // 5) as component from cells"),
    "points_to_cells": (_held, f"with {_LAT}, {_PROBES}, {_HOLDS} select pid, cell from p left join held using (pid)"),
    "cells_nearest": (_nearest_cells, f"with {_LAT}, {_PROBES}, n as (select pid, cell, row_number() over (partition by pid order by sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)), cell) as k from p, g) select pid, cell from n where k = 1"),
    "match_nodes": (
        _matched,
        f"""with {_LAT}, o as (select node + 5000 as node, x + case when node % 3 = 0 then 0.01::double else 0.3::double end as x, y from nodes),
        n as (select a.node, b.node as into_, row_number() over (partition by a.node order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.node) as k from nodes a join o b on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05)
        select nodes.node, coalesce(into_, -1) as "into" from nodes left join n on n.node = nodes.node and k = 1""",
    ),
    "cell_owners": (
        _owners,
        """with h as (select l_suppkey as proc, l_partkey as cell, min(l_orderkey) as local_cell, min(l_quantity) <= 10 as boundary from lineitem group by 1, 2),
        k as (select *, row_number() over (partition by cell order by boundary, proc) as k from h) select cell, proc, local_cell from k where k = 1""",
    ),
    "edges_in_box": (
        lambda s, d: mesh_joins.edges_clipped(_lat(s, d)[2], _lat(s, d)[0], (3.0, 11.5, 1.0, 3.5)).select("n1", "n2"), f"with {_LAT} select n1, n2 from eg where ex between 3.0 and 11.5 and ey between 1.0 and 3.5"),
    "angle_errors": (
        lambda s, d: r6(mesh_joins.angle_errors(_lat(s, d)[2], _lat(s, d)[1], _lat(s, d)[0]), "error"),
        f"with {_LAT} select n1, n2, round((-ny * (b.cx - a.cx) + nx * (b.cy - a.cy)) / sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2), 6) as error from eg join g a on a.cell = l join g b on b.cell = r",
    ),
    "bilinear": (
        lambda s, d: r6(raster.bilinear(grid(s, d), _probes(s, d).select("pid", (F.col("x") * 0.7).alias("x"), (F.col("y") * 9).alias("y"))), "value"),
        f"""with {_PROBES}, q as (select pid, x * 0.7::double as x, y * 9 as y from p), g as ({_GRID}), s as (select max(row) + 1 as rs, max(col) + 1 as cs from g),
        a as (select pid, x, y, cast(trunc(y) as bigint) as r0, cast(trunc(x) as bigint) as c0, cast(trunc(y + 0.49::double) as bigint) as rn, cast(trunc(x + 0.49::double) as bigint) as cn from q),
        k as (select a.*, r0 >= 0 and c0 >= 0 and r0 < rs - 1 and c0 < cs - 1 as inside from a, s),
        w as (select pid, case when inside then r0 + i.i else rn end as row, case when inside then c0 + j.j else cn end as col,
          case when inside then (case when i.i = 1 then y - r0 else 1 - (y - r0) end) * (case when j.j = 1 then x - c0 else 1 - (x - c0) end) else 1 end as w
          from k, (values (0), (1)) as i(i), (values (0), (1)) as j(j) where inside or i.i + j.j = 0)
        select pid, round(case when count(*) = count(value) then sum(w * value) end, 6) as value from w left join g on g.row = w.row and g.col = w.col group by 1""",
    ),
    "nearest_cell": (
        lambda s, d: raster.nearest_cell(_probes(s, d).select("pid", F.floor("x").alias("x"), (F.floor(F.col("y") * 9) + 0.5).alias("y")), grid(s, d)),
        f"with {_PROBES}, g as ({_GRID}) select pid, value from p left join g on g.row = floor(y * 9) and g.col = floor(x)",
    ),
    "raster_sum": (
        lambda s, d: r6(raster.combined(grid(s, d), raster.masked(grid(s, d), (0, 9, 0, 99), 0.0), "+"), "value"),
        f"select row, col, round(value + case when col between 0 and 9 and row between 0 and 99 then value else 0 end, 6) as value from ({_GRID})",
    ),
    "raster_decimated": (lambda s, d: raster.decimated(grid(s, d), 3), f"select row // 3 as row, col // 3 as col, value from ({_GRID}) where row % 3 = 0 and col % 3 = 0"),
    "raster_upsampled": (
        lambda s, d: r6(raster.upsampled(grid(s, d)), "value"),
        f"""with g as ({_GRID}), t as (select 2 * row + i.i as row, 2 * col + j.j as col, value from g, (values (-1), (0), (1)) as i(i), (values (-1), (0), (1)) as j(j))
        select row, col, round(avg(value), 6) as value from t group by 1, 2 having count(*) = (1 + abs(row % 2)) * (1 + abs(col % 2))""",
    ),
    "raster_blended": (
        lambda s, d: r6(raster.blended(table(s, d, "lineitem").select((F.col("l_partkey")).alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_extendedprice") * 1.4142135623).alias("value"), F.col("l_discount").alias("weight"))), "value"),
        "select l_partkey as row, l_linenumber as col, round(sum(l_extendedprice * 1.4142135623::double * l_discount) / sum(l_discount), 6) as value from lineitem where l_discount > 0 group by 1, 2",
    ),
    "combine_sources": (
        _combined,
        f"""with p as (select max(a) as a, min(b) as b from (select min(ts) as a, max(ts) as b from events where event_type in ('click', 'view') group by event_type))
        select event_type as source, {_BIN} as bin, round(avg(value), 6) as mean from events, p where event_type in ('click', 'view') and ts between a and b group by 1, 2""",
    ),
    "sigma_median": (
        lambda s, d: r6(metrics.sigma_median(events(s, d), ["user_id"], "event_id", "value"), "sigma"),
        """with c as (select user_id, value, sum(value) over w as c, sum(value) over (partition by user_id) as t, count(*) over (partition by user_id) as n, row_number() over w as i from events window w as (partition by user_id order by event_id rows unbounded preceding))
        select user_id, round(arg_min((i - (c - t / 2) / value) / n, i), 6) as sigma from c where c >= t / 2 group by 1""",
    ),
    "mean_time": (lambda s, d: metrics.mean_time(events(s, d), ["event_type"]), "select event_type, make_timestamp(cast(sum(epoch_us(ts)) // count(*) as bigint)) as mean_ts from events group by 1"),
    "kernel_density": (
        lambda s, d: r6(metrics.kernel_density(table(s, d, "lineitem"), [5.0, 20.0, 45.0], "l_quantity", "l_extendedprice", 4.0), "density"),
        "select p as at, round(sum(exp(-0.5::double * ((p - l_quantity) / 4.0::double) ** 2) * l_extendedprice) / sum(l_extendedprice) / (4.0::double * sqrt(2 * pi())), 6) as density from lineitem, (select unnest([5.0, 20.0, 45.0]::double[]) as p) group by 1",
    ),
    "bandwidth": (
        lambda s, d: r6(metrics.bandwidth(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "n_effective", "spread", "width"),
        """with s as (select sum(l_extendedprice) as w, sum(l_extendedprice * l_extendedprice) as w2, sum(l_extendedprice * l_quantity) as s, sum(l_extendedprice * l_quantity * l_quantity) as q from lineitem),
        t as (select w * w / w2 as n, sqrt((q / w - (s / w) ** 2) / (1 - w2 / (w * w))) as d from s) select round(n, 6) as n_effective, round(d, 6) as spread, round(d * n ** -0.2::double, 6) as width from t""",
    ),
    "rotated_to_principal": (
        lambda s, d: r6(metrics.rotated_to_principal(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount", 3.0).select("l_orderkey", "l_linenumber", "along", "across"), "along", "across"),
        """with t as (select l_suppkey, 0.5 * atan2(2 * covar_samp(l_quantity, l_discount), var_samp(l_quantity) - var_samp(l_discount)) as t from lineitem group by 1),
        u as (select l_suppkey, case when abs(t - 3.0 + pi() - 2 * pi() * floor((t - 3.0 + pi()) / (2 * pi())) - pi()) > pi() / 2 then t + pi() else t end as t from t)
        select l_orderkey, l_linenumber, round(cos(t) * l_quantity + sin(t) * l_discount, 6) as along, round(cos(t) * l_discount - sin(t) * l_quantity, 6) as across from lineitem join u using (l_suppkey)""",
    ),
    "autocorrelation": (
        lambda s, d: r6(metrics.autocorrelation(events(s, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))), ["user_id"], "i", "value", 4), "r"),
        """with e as (select user_id, value, row_number() over (partition by user_id order by ts) as i from events)
        select a.user_id, cast(b.i - a.i as integer) as lag, round(corr(a.value, b.value), 6) as r, count(*) as n from e a join e b on a.user_id = b.user_id and b.i - a.i between 0 and 4 group by 1, 2""",
    ),
    "windowed_median": (
        lambda s, d: r6(metrics.windowed_median(events(s, d), ["user_id"], "value", 30.0), "median"),
        "with m as (select user_id, median(value) as m from events group by 1) select user_id, round(median(value), 6) as median from events join m using (user_id) where abs(value - m) <= 30 group by 1",
    ),
    "nearest_mean": (
        lambda s, d: r6(filters.nearest_mean(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("y")), ["o_custkey"], "x", "y", 5), "mean"),
        """with k as (select a.o_custkey, a.o_orderkey as x, a.o_totalprice as y, b.o_totalprice as v, row_number() over (partition by a.o_orderkey order by abs(a.o_orderkey - b.o_orderkey), b.o_orderkey) as k from orders a join orders b on a.o_custkey = b.o_custkey)
        select o_custkey, cast(x as double) as x, any_value(y) as y, round(avg(v), 6) as mean from k where k <= 5 group by 1, x""",
    ),
    "thinned": (lambda s, d: filters.thinned(events(s, d), ["user_id"], ["ts", "event_id"], "value", 4, False).select("event_id", "value"), "select event_id, value from (select *, row_number() over (partition by user_id order by ts, event_id) as i from events) where i % 4 = 1"),
    "lowpass": (lambda s, d: r6(filters.lowpass(_hourly(s, d), ["event_type"], ["ts"], "value", 1.0, 12.0).select("event_type", "ts", "filtered"), "filtered"), None),
    "windowed_slope": (lambda s, d: r6(filters.windowed_slope(events(s, d).withColumn("t", T.to_dnum(F.col("ts")) - 19723), ["user_id"], ["ts", "event_id"], "t", "value", 12).select("event_id", "slope"), "slope"), None),
    "tidal_datums": (lambda s, d: tides.tidal_datum(_hourly(s, d), ["event_type"], "value", "min", True).withColumnRenamed("datum", "mllw").join(tides.tidal_datum(_hourly(s, d), ["event_type"], "value", "max").withColumnRenamed("datum", "mhw"), "event_type"), None),
    "slack_water": (lambda s, d: tides.slack_water(_hourly(s, d), ["event_type"], "value", 1.0), None),
    "tidal_hours": (lambda s, d: r6(tides.tidal_hour(_hourly(s, d), tides.slack_water(_hourly(s, d), ["event_type"], "value", 1.0), ["event_type"]), "hour"), None),
    "filled_tide": (lambda s, d: r6(tides.filled_tide(_hourly(s, d), ["event_type"], "value", 3600.0, tides.select_omegas(20 * 86400.0)), "value"), None),
    "named_omegas": (
        lambda s, d: tides.named_omegas(table(s, d, "part").select("p_partkey", (F.col("p_size") * 2.9e-6).alias("omega"))).select("p_partkey", "constituent"),
        "with c as (select * from (values " + ", ".join(f"({k}, '{n}', {v!r}::double)" for k, (n, v) in enumerate(tides.SPEEDS.items())) + """) as c(k, n, v)),
        d as (select p_partkey, n, row_number() over (partition by p_partkey order by abs(p_size * 2.9e-6::double - v * pi() / 180 / 3600), k) as r from part, c) select p_partkey, n as constituent from d where r = 1""",
    ),
    "line_normals": (
        lambda s, d: r6(lines.left_normals(_line(s, d), ["f"]).select("pos", "nx", "ny"), "nx", "ny"),
        f"""with p as (select *, coalesce(lead(x) over w, x) - coalesce(lag(x) over w, x) as dx, coalesce(lead(y) over w, y) - coalesce(lag(y) over w, y) as dy from ({_PTS}) window w as (partition by f order by pid))
        select pid as pos, round(-dy / nullif(sqrt(dx * dx + dy * dy), 0), 6) as nx, round(dx / nullif(sqrt(dx * dx + dy * dy), 0), 6) as ny from p""",
    ),
    "line_resampled": (
        lambda s, d: lines.resampled(_line(s, d), ["f"], 1.7).select("f", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y")),
        f"""with s as (select cast(f as integer) as f, pid, x, y, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as d from ({_PTS}) window w as (partition by f order by pid)),
        a as (select *, sum(d) over (partition by f order by pid rows unbounded preceding) as a from s), b as (select *, lead(a) over w as l, lead(x) over w as x1, lead(y) over w as y1 from a window w as (partition by f order by pid)),
        k as (select *, unnest(case when l is null then [a] else list_transform(range(cast(ceil(a / 1.7::double) as bigint), cast(ceil(l / 1.7::double) as bigint)), lambda i: i * 1.7::double) end) as pt from b)
        select f, row_number() over (partition by f order by pt) - 1 as pos, round(x + coalesce((pt - a) / nullif(l - a, 0), 0) * coalesce(x1 - x, 0), 5) as x, round(y + coalesce((pt - a) / nullif(l - a, 0), 0) * coalesce(y1 - y, 0), 5) as y from k""",
    ),
    "total_average": (
        lambda s, d: r6(transect.total_avg(_transect(s, d), "u", ["sample"]), "mean", "total"),
        "select l_suppkey as sample, round(sum(l_extendedprice * l_quantity / 10 * l_tax * 100) / sum(l_quantity / 10 * l_tax * 100), 6) as mean, round(sum(l_extendedprice * l_quantity / 10 * l_tax * 100), 6) as total from lineitem group by 1",
    ),
    "lateral_integral": (lambda s, d: r6(transect.lateral_int(_transect(s, d), "z", ["sample"]), "total"), "select l_suppkey as sample, round(sum(l_discount * l_tax * 100), 6) as total from lineitem group by 1"),
    "discharge_left": (
        lambda s, d: r6(transect.discharge_left(_transect(s, d).withColumns({"n": F.lit(0.6), "m": F.lit(-0.8)}), "z", "dx", ("n", "m"), ["sample"]), "q"),
        "select l_suppkey as sample, round(sum((l_discount * 0.6::double + l_tax * 100 * -0.8::double) * l_quantity / 10 * l_tax * 100), 6) as q from lineitem group by 1",
    ),
    "mean_direction": (lambda s, d: r6(transect.mean_direction(_transect(s, d), "z", "dx", ["sample"]), "theta"), "select l_suppkey as sample, round(atan2(sum(l_tax * 100 * l_quantity / 10), sum(l_discount * l_quantity / 10)), 6) as theta from lineitem group by 1"),
    "transect_levels": (
        lambda s, d: r6(transect.resampled_z(table(s, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("z")), "v", "z", [10.0, 25.5], ["l_orderkey"]).withColumn("v", F.col("v") * 1.4142135623), "v"),
        """with p as (select l_orderkey, l_quantity as z, avg(l_extendedprice) as v from lineitem group by 1, 2), q as (select *, lead(z) over w as z1, lead(v) over w as v1 from p window w as (partition by l_orderkey order by z)),
        e as (select o.l_orderkey, k.level from (select distinct l_orderkey from lineitem) o, (values (10.0::double), (25.5::double)) as k(level))
        select e.l_orderkey, e.level, round(1.4142135623::double * case when q.z1 is null then q.v else q.v + (v1 - v) * (e.level - z) / (z1 - z) end, 6) as v from e left join q on q.l_orderkey = e.l_orderkey and e.level >= z and (e.level < z1 or (z1 is null and e.level = z))""",
    ),
    "bed_masked": (lambda s, d: transect.bed_masked(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("z"), F.lit(40.0).alias("bed")), "v", "z", "bed").select("l_orderkey", "l_linenumber", "v"), "select l_orderkey, l_linenumber, case when l_quantity <= 36 then l_extendedprice end as v from lineitem"),
    "center_to_edge": (
        lambda s, d: r6(S.center_to_edge(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("x")), ["o_custkey"], "x").withColumn("place", F.col("place").cast("long")), "edge"),
        """with w as (select o_custkey, cast(o_orderkey as double) as x, row_number() over w as i, lead(o_orderkey) over w as n, lag(o_orderkey) over w as p from orders window w as (partition by o_custkey order by o_orderkey))
        select o_custkey, i as place, round(coalesce((x + n) / 2, x + (x - p) / 2), 6) as edge from w union all select o_custkey, 0, round(x - (n - x) / 2, 6) from w where p is null and n is not null""",
    ),
    "slack_times": (
        lambda s, d: S.slack_times(events(s, d).withColumn("u", F.col("value") - 40), ["user_id"], "u").select("user_id", "slack", "rising"),
        """with e as (select user_id, epoch_us(ts) as t, value - 40 as v, lead(epoch_us(ts)) over w as t1, lead(value) over w - 40 as v1 from events window w as (partition by user_id order by ts))
        select user_id, make_timestamp(cast(round(t - v * (t1 - t) / (v1 - v)) as bigint)) as slack, v1 > v as rising from e where v * v1 < 0 or (v = 0 and v1 <> 0)""",
    ),
    "release_log": (
        lambda s, d: S.release_log(table(s, d, "orders"), "o_orderdate", ["o_orderkey", "o_custkey"]),
        'select o_orderdate, count(*) as "count", min(o_orderkey) as o_orderkey_min, max(o_orderkey) as o_orderkey_max, min(o_custkey) as o_custkey_min, max(o_custkey) as o_custkey_max from orders group by 1',
    ),
    "regular_series": (
        lambda s, d: r6(S.regular(events(s, d), ["user_id"], 86400.0, "value").select("user_id", "ts", "value"), "value"),
        """with e as (select user_id, epoch_us(ts) as t, value as v, lead(epoch_us(ts)) over w as t1, lead(value) over w as v1, min(epoch_us(ts)) over (partition by user_id) as z from events window w as (partition by user_id order by ts)),
        k as (select *, unnest(range(cast(ceil((t - z) / 86400e6::double) as bigint), case when t1 is null then cast(floor((t - z) / 86400e6::double) as bigint) + 1 else cast(ceil((t1 - z) / 86400e6::double) as bigint) end)) as k from e)
        select user_id, make_timestamp(z + k * 86400000000) as ts, round(case when t1 is null then v else v + (v1 - v) * (z + k * 86400000000 - t) / (t1 - t) end, 6) as value from k""",
    ),
    "merged_gages": (
        lambda s, d: r6(S.merged_gages(events(s, d).where("event_type = 'click'"), events(s, d).where("event_type <> 'click'"), ["user_id"], 2.0, 3600.0), "value"),
        """with a as (select user_id, ts, value from events where event_type = 'click'), b as (select user_id, ts + interval 1 hour as ts, value * 2 as value from events where event_type <> 'click')
        select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.ts, b.ts) as ts, round(coalesce(a.value, b.value), 6) as value from a full join b on a.user_id = b.user_id and a.ts = b.ts""",
    ),
    "rounded_times": (
        lambda s, d: events(s, d).select("event_id", T.round_time(F.col("ts"), 900).alias("near"), T.formatted(F.col("ts")).alias("said"), T.matlab_to_time(F.floor(T.to_dnum(F.col("ts"))) + 719529).alias("day"), T.from_unix(F.floor(T.to_unix(F.col("ts")))).alias("second")),
        """select event_id, make_timestamp(cast(round_even(epoch_us(ts) / 900000000.0::double, 0) as bigint) * 900000000) as near, strftime(ts, '%Y-%m-%d %H:%M') as said, date_trunc('day', ts) as day, date_trunc('second', ts) as second from events""",
    ),
    "parsed_intervals": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", *(c.alias(n) for c, n in zip(T.parsed_interval(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 2 == 0, ":+36h").otherwise("")), F.lit("2020-01-01").cast("timestamp_ntz"), F.lit("2020-01-08").cast("timestamp_ntz")), ("a", "b")))),
        "select o_orderkey, date_trunc('day', o_orderdate)::timestamp as a, date_trunc('day', o_orderdate)::timestamp + case when o_orderkey % 2 = 0 then interval 36 hour else interval 7 day end as b from orders",
    ),
    "cf_times": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.cf_time(F.concat(F.col("p_size").cast("string"), F.lit(" hours since 2020-01-01 00:00:00Z"))).alias("at")),
        "select p_partkey, timestamp '2020-01-01' + to_hours(p_size) as at from part",
    ),
    "utm": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", *(F.round(c, 3).alias(n) for c, n in zip(G.to_utm(F.col("s_suppkey") % 50 / 10.0 - 125, F.col("s_suppkey") % 70 + 0.5, -123.0), ("east", "north")))),
        """with z as (select *, 1 / 298.257223563::double as fl from supplier), n as (select s_suppkey, fl / (2 - fl) as n, sin(radians(s_suppkey % 70 + 0.5::double)) as s, radians(s_suppkey % 50 / 10.0::double - 125 + 123) as o from z),
        t as (select *, sinh(atanh(s) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * s)) as t, 6378137.0::double * 0.9996::double / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as a from n),
        u as (select *, atan2(t, cos(o)) as x, atanh(sin(o) / sqrt(1 + t * t)) as e from t),
        c as (select *, unnest([{'j': 1, 'c': n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180}, {'j': 2, 'c': 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440}, {'j': 3, 'c': 61 * n ** 3 / 240 - 103 * n ** 4 / 140}, {'j': 4, 'c': 49561 * n ** 4 / 161280}]) as k from u)
        select s_suppkey, round(500000 + any_value(a) * (any_value(e) + sum(k.c * cos(2 * k.j * x) * sinh(2 * k.j * e))), 3) as east, round(any_value(a) * (any_value(x) + sum(k.c * sin(2 * k.j * x) * cosh(2 * k.j * e))), 3) as north from c group by 1""",
    ),
    "triangle_tests": (
        lambda s, d: r6(points(s, d).select("pid", G.orientation(F.col("x"), F.col("y"), F.lit(0.1), F.lit(0.2), F.lit(-0.1), F.lit(0.0)).alias("side"), (G.in_circle((F.lit(0.0), F.lit(0.0)), (F.lit(0.2), F.lit(0.0)), (F.lit(0.0), F.lit(0.2)), (F.col("x"), F.col("y"))) * 1000).alias("inside"), *(c.alias(n) for c, n in zip(G.rotated(F.lit(0.5), F.col("x"), F.col("y")), ("rx", "ry")))), "side", "inside", "rx", "ry"),
        f"""select pid, round((x + 0.1::double) * 0.2::double - (y - 0) * 0.2::double, 6) as side, round(1000 * ((x * x + y * y) * ((0.2::double - x) * (0.2::double - y) - (-x) * (-y)) - ((0.2::double - x) ** 2 + y * y) * ((-x) * (0.2::double - y) - (-x) * (-y)) + (x * x + (0.2::double - y) ** 2) * ((-x) * (-y) - (0.2::double - x) * (-y))), 6) as inside,
        round(cos(0.5::double) * x - sin(0.5::double) * y, 6) as rx, round(sin(0.5::double) * x + cos(0.5::double) * y, 6) as ry from ({_PTS})""",
    ),
    "segment_crossings": (
        lambda s, d: r6(points(s, d).select("pid", G.segment_intersection((F.col("x"), F.col("y"), -F.col("x"), -F.col("y") + 0.1), (F.lit(-0.3), F.lit(0.0), F.lit(0.3), F.lit(0.05))).alias("p")).where("p is not null").select("pid", "p.x", "p.y"), "x", "y"),
        f"""with q as (select pid, x, y, -2 * x as ux, -2 * y + 0.1::double as uy from ({_PTS})), r as (select *, ux * 0.05::double - uy * 0.6::double as det from q),
        t as (select *, ((-0.3::double - x) * 0.05::double - (0 - y) * 0.6::double) / nullif(det, 0) as s, ((-0.3::double - x) * uy - (0 - y) * ux) / nullif(det, 0) as t from r)
        select pid, round(x + s * ux, 6) as x, round(y + s * uy, 6) as y from t where s between 0 and 1 and t between 0 and 1""",
    ),
    "combinations3": (
        lambda s, d: reshape.combinations(table(s, d, "nation"), "n_regionkey", 3), "with v as (select distinct n_regionkey as k from nation) select a.k as v1, b.k as v2, c.k as v3 from v a join v b on a.k < b.k join v c on b.k < c.k"),
    "pivoted": (
        lambda s, d: reshape.wide(events(s, d), ["user_id"], "event_type", "value", ["click", "view"]),
        "select user_id, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'view' then value end) as view from events group by 1",
    ),
    "padded_sort": (
        lambda s, d: reshape.padded_sort(table(s, d, "orders"), ["o_custkey"], "o_orderdate", "place").groupBy("o_custkey", "o_orderdate").agg(F.min("place").cast("long").alias("place")),
        "select o_custkey, o_orderdate, min(i) - 1 as place from (select *, row_number() over (partition by o_custkey order by o_orderdate) as i from orders) group by 1, 2",
    ),
    "filled_records": (
        lambda s, d: reshape.records([table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("nation")), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).cast("long").alias("flag"))]),
        "select c_custkey as key, cast(c_nationkey as bigint) as nation, cast(-99 as bigint) as flag from customer union all select s_suppkey, -99, 1 from supplier",
    ),
    "interpolated_dimension": (
        lambda s, d: r6(reshape.interpolated(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("v")), ["o_custkey"], "x", "v", table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 7.0).alias("x")), 5000.0), "v"),
        """with q as (select c_custkey, c_custkey * 7.0::double as x from customer), c as (select q.c_custkey as o_custkey, q.x, max(case when o_orderkey <= x then o_orderkey end) as a, min(case when o_orderkey >= x then o_orderkey end) as b,
          arg_max(o_totalprice, o_orderkey) filter (o_orderkey <= x) as va, arg_min(o_totalprice, o_orderkey) filter (o_orderkey >= x) as vb from q left join orders o on o.o_custkey = q.c_custkey group by 1, 2)
        select o_custkey, x, round(case when b - a <= 5000 then case when b = a then va else va + (vb - va) * (x - a) / (b - a) end end, 6) as v from c""",
    ),
    "nmea_fixes": (
        _nmea,
        """select s_suppkey, make_timestamp(2000 + s_suppkey % 20, 2, 5, s_suppkey % 24, s_suppkey % 60, 30.5) as ts, round(-(s_suppkey % 80 + 0.5::double), 6) as lat, round(s_suppkey % 90 + 0.25::double, 6) as lon from supplier where s_suppkey % 5 <> 0""",
    ),
    "station_answers": (
        _answers,
        """select user_id, cast(user_id as varchar) as station, count(*) as n, count(*) filter (event_type <> 'view') as n_values, round(sum(value) filter (event_type <> 'view'), 2) as total, max(date_trunc('second', ts)) as last from events group by 1""",
    ),
}
