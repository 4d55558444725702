"""Points, rasters, meshes and graphs made of the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geometry as G
from fathomline.operators import graph, mesh, raster, reshape, spatial, transect
from fathomline.operators import temporal as S
from fathomline.plans.series_queries import events, r6, table
from fathomline.session import dealt_by


def points(spark: SparkSession, sf_dir: str, pid: str = "pid") -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias(pid), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("double").alias("f"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.max("l_extendedprice").alias("value"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as nodes, linked where a supplier shipped a part, once for each time; to graph operators repeats are nothing."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Triangles over points: three following parts of a line number's parts make a ring; nodes by price and size."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p")).where(F.size("p") >= 3)
    ring = li.select(F.col("l_orderkey").alias("cell"), F.posexplode("p").alias("pos", "node"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"), (F.col("p_size") + F.col("p_partkey") % 7).cast("double").alias("y"))
    return nodes, ring


_PTS = "select vec_id as pid, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(label as double) as f from embeddings"
_GRID = "select l_partkey as row, l_suppkey as col, max(l_extendedprice) as value from lineitem group by 1, 2"
_RING = """o as (select l_orderkey as cell, l_partkey as node, row_number() over (partition by l_orderkey order by l_partkey) - 1 as pos, count(*) over (partition by l_orderkey) as n from (select distinct l_orderkey, l_partkey from lineitem)),
ring as (select cell, pos, node from o where n >= 3),
h as (select cell, pos, node as a, coalesce(lead(node) over (partition by cell order by pos), first_value(node) over (partition by cell order by pos)) as b from ring),
nodes as (select p_partkey as node, p_retailprice as x, cast(p_size + p_partkey % 7 as double) as y from part),
e as (select least(a, b) as n1, greatest(a, b) as n2, max(case when a < b then cell end) as "left", max(case when a >= b then cell end) as "right" from h group by 1, 2)"""


def _cell_geometry(s: SparkSession, d: str) -> DataFrame:
    nodes, ring = cells(s, d)
    g = mesh.cell_geometry(ring, nodes)
    return g.select("cell", F.round("area", 4).alias("area"), "sides")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return mesh.edges_of(cells(s, d)[1], more="last")


def _layers(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_linenumber").alias("priority"), "l_quantity", "l_discount")
    return dealt_by(li, "row", "col").groupBy("row", "col", "priority").agg(F.max("l_quantity").alias("value"), (F.max("l_discount") * 5).alias("alpha"))


def _transect(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_quantity") / 10).alias("dz"), (F.col("l_tax") * 100).alias("dx"), F.col("l_extendedprice").alias("u"), F.col("l_discount").alias("z"))


Q = {
    "radius_join": (
        lambda s, d: r6(spatial.within_radius(points(s, d), points(s, d, "qid"), 0.02), "d"),
        f"with p as ({_PTS}) select a.pid, b.pid as qid, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as d from p a join p b on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02",
    ),
    "idw": (
        lambda s, d: r6(spatial.idw(points(s, d), points(s, d, "qid"), 0.05, "f"), "f"),
        f"""with p as ({_PTS}), j as (select a.pid, b.f, 1 / greatest(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 0.01::double * 0.05::double) as w from p a join p b on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05)
        select pid, round(sum(f * w) / sum(w), 6) as f, count(*) as n from j group by 1""",
    ),
    "knn": (
        lambda s, d: r6(spatial.knn(points(s, d), points(s, d, "qid"), 3, 0.05).withColumn("rank", F.col("rank").cast("long")), "d"),
        f"""with p as ({_PTS}), j as (select a.pid, b.pid as qid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from p a, p b),
        k as (select *, row_number() over (partition by pid order by d, qid) as rank from j) select pid, qid, round(d, 6) as d, rank from k where rank <= 3""",
    ),
    "bounds_by_label": (
        lambda s, d: spatial.bounds(points(s, d), keys=["f"]),
        f"select f, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax from ({_PTS}) group by 1",
    ),
    "rect_overlaps": (
        lambda s, d: spatial.rect_overlaps(*(points(s, d, k).select(k, F.col("x").alias("xa"), (F.col("x") + 0.02).alias("xb"), F.col("y").alias("ya"), (F.col("y") + 0.02).alias("yb")) for k in ("lid", "rid")), 0.05),
        f"with p as ({_PTS}) select a.pid as lid, b.pid as rid from p a join p b on a.x <= b.x + 0.02::double and b.x <= a.x + 0.02::double and a.y <= b.y + 0.02::double and b.y <= a.y + 0.02::double",
    ),
    "haversine": (
        lambda s, d: r6(points(s, d).select("pid", G.haversine(F.col("x") * 100, F.col("y") * 50, F.lit(-122.0), F.lit(37.0)).alias("km")), "km"),
        f"""select pid, round(2 * 6367.0 * asin(sqrt(pow(sin(radians(37.0 - y * 50) / 2), 2) + cos(radians(y * 50)) * cos(radians(37.0)) * pow(sin(radians(-122.0 - x * 100) / 2), 2))), 6) as km from ({_PTS})""",
    ),
    "segment_distance": (
        lambda s, d: r6(points(s, d).select("pid", G.point_segment_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(0.2), F.lit(0.1)).alias("d"), G.point_line_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(0.2), F.lit(0.1)).alias("line")), "d", "line"),
        f"""with p as (select *, greatest(0.0, least(1.0, (x * 0.2::double + y * 0.1::double) / (0.2::double * 0.2::double + 0.1::double * 0.1::double))) as a from ({_PTS}))
        select pid, round(sqrt((x - a * 0.2::double) ** 2 + (y - a * 0.1::double) ** 2), 6) as d, round(abs(0.2::double * (0 - y) - (0 - x) * 0.1::double) / sqrt(0.05::double), 6) as line from p""",
    ),
    "path_length": (
        lambda s, d: r6(S.dist_along(points(s, d), ["f"], ["pid"], "x", "y").select("pid", "along"), "along"),
        f"""with p as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as s from ({_PTS}) window w as (partition by f order by pid))
        select pid, round(sum(coalesce(s, 0)) over (partition by f order by pid rows unbounded preceding), 6) as along from p""",
    ),
    "raster_block_mean": (
        lambda s, d: r6(raster.downsample(grid(s, d), 4), "value").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"),
        f"select cast(floor(row / 4) as bigint) as row, cast(floor(col / 4) as bigint) as col, round(avg(value), 6) as value from ({_GRID}) group by 1, 2",
    ),
    "raster_gradient": (
        lambda s, d: r6(raster.gradient(grid(s, d)), "gx", "gy"),
        f"""with g as ({_GRID}), n as (select a.row, a.col, a.value as v, r.value as r, l.value as l, u.value as u, o.value as o from g a
          left join g r on r.row = a.row and r.col = a.col + 1 left join g l on l.row = a.row and l.col = a.col - 1
          left join g u on u.col = a.col and u.row = a.row + 1 left join g o on o.col = a.col and o.row = a.row - 1)
        select row, col, round(coalesce((r - l) / 2, r - v, v - l), 6) as gx, round(coalesce((u - o) / 2, u - v, v - o), 6) as gy from n""",
    ),
    "raster_smooth": (
        lambda s, d: r6(raster.smooth(grid(s, d)), "value"),
        f"with g as ({_GRID}) select a.row, a.col, round(sum(b.value) / count(*), 6) as value from g a join g b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2",
    ),
    "raster_composite": (
        lambda s, d: raster.composite(_layers(s, d)).withColumns({c: F.round(F.col(c) * 1.4142135623, 6) for c in ("value", "alpha")}),
        """with recursive l as (select l_partkey as row, l_suppkey as col, l_linenumber as priority, max(l_quantity) as value, max(l_discount) * 5 as alpha from lineitem group by 1, 2, 3),
        k as (select *, row_number() over (partition by row, col order by priority) as i, count(*) over (partition by row, col) as n from l),
        f as (select row, col, i, n, case when alpha > 1e-10 then value else 0 end as v, alpha as a from k where i = 1
          union all select k.row, k.col, k.i, k.n, case when f.a * (1 - k.alpha) + k.alpha > 1e-10 then (f.v * f.a * (1 - k.alpha) + k.value * k.alpha) / (f.a * (1 - k.alpha) + k.alpha) else 0 end, f.a * (1 - k.alpha) + k.alpha
          from f join k on k.row = f.row and k.col = f.col and k.i = f.i + 1)
        select row, col, round(case when a > 1e-10 then v end * 1.4142135623::double, 6) as value, round(a * 1.4142135623::double, 6) as alpha from f where i = n""",
    ),
    "first_valid_layer": (
        lambda s, d: raster.first_valid(_layers(s, d)),
        "select row, col, arg_min(value, priority) as value from (select l_partkey as row, l_suppkey as col, l_linenumber as priority, max(l_quantity) as value from lineitem group by 1, 2, 3) group by 1, 2",
    ),
    "label_average": (
        lambda s, d: r6(raster.average_by_label(grid(s, d).withColumn("value", F.when(F.col("row") % 5 != 0, F.col("value"))), grid(s, d).withColumn("label", (F.col("row") + F.col("col")) % 9)), "value"),
        f"select (row + col) % 9 as label, round(sum(case when row % 5 <> 0 then value else 0 end) / count(*), 6) as value from ({_GRID}) group by 1",
    ),
    "cell_area": (_cell_geometry, f"with {_RING} select cell, round(sum(p.x * q.y - q.x * p.y) / 2, 4) as area, count(*) as sides from h join nodes p on p.node = a join nodes q on q.node = b group by cell"),
    "mesh_edges": (_edges, f'with {_RING} select n1, n2, "left", "right" from e'),
    "boundary_edges": (lambda s, d: mesh.boundary_edges(_edges(s, d)), f'with {_RING} select n1, n2, "left", "right" from e where "left" is null or "right" is null'),
    "cell_neighbours": (
        lambda s, d: mesh.cell_neighbours(_edges(s, d)),
        f'with {_RING}, b as (select * from e where "left" is not null and "right" is not null) select "left" as cell, "right" as other from b union select "right", "left" from b',
    ),
    "node_degree": (lambda s, d: mesh.node_degree(_edges(s, d)), f"with {_RING} select node, count(*) as degree from (select n1 as node from e union all select n2 from e) group by 1"),
    "edge_geometry": (
        lambda s, d: r6(mesh.edge_geometry(_edges(s, d), cells(s, d)[0]).select("n1", "n2", "length", "ex", "ey"), "length", "ex", "ey"),
        f"with {_RING} select n1, n2, round(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2), 6) as length, round((p.x + q.x) / 2, 6) as ex, round((p.y + q.y) / 2, 6) as ey from e join nodes p on p.node = n1 join nodes q on q.node = n2",
    ),
    "node_to_cell": (
        lambda s, d: r6(mesh.node_to_cell(cells(s, d)[1], cells(s, d)[0].select("node", F.when(F.col("node") % 50 != 0, F.col("x")).alias("value"))), "value"),
        f"with {_RING} select cell, round(case when count(case when node % 50 <> 0 then x end) = count(*) then avg(x) end, 6) as value from ring join nodes using (node) group by 1",
    ),
    "cell_to_node": (
        lambda s, d: r6(mesh.cell_to_node(cells(s, d)[1], table(s, d, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_totalprice") * 1.4142135623).alias("value"))), "value"),
        f"with {_RING} select node, round(avg(o_totalprice * 1.4142135623::double), 6) as value from ring join orders on o_orderkey = cell group by 1",
    ),
    "renumber": (
        lambda s, d: mesh.renumbered(table(s, d, "orders"), "o_custkey"),
        "select o_custkey, row_number() over (order by o_custkey) - 1 as number from (select distinct o_custkey from orders)",
    ),
    "components": (
        lambda s, d: graph.components(supply_edges(s, d)),
        """with recursive e as (select distinct l_partkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem), u as materialized (select a, b from e union all select b, a from e),
        r(id, root) using key (id) as (select distinct a, a from u union select u.b, min(r.root) from r join u on u.a = r.id join recurring.r as o on o.id = u.b where r.root < o.root group by u.b)
        select id, root as component from r""",
    ),
    "distance_transform": (
        lambda s, d: graph.distances(supply_edges(s, d).withColumn("w", F.lit(1.0)), s.createDataFrame([(3,)], "node bigint")),
        """with recursive e as (select distinct l_partkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem), u as materialized (select a, b from e union all select b, a from e),
        r(node, k) using key (node) as (select 3::bigint, 0 union select u.b, min(r.k) + 1 from r join u on u.a = r.node where u.b not in (select node from recurring.r) group by u.b)
        select node, cast(k as double) as distance from r""",
    ),
    "redimension_rank": (
        lambda s, d: reshape.redimension(events(s, d), ["user_id", "event_type"], "place", ["ts", "event_id"]).select("event_id", F.col("place").cast("long").alias("place")),
        "select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as place from events",
    ),
    "last_wins": (
        lambda s, d: reshape.last_wins(events(s, d), ["user_id", "event_type"], ["ts", "event_id"]),
        "select user_id, event_type, event_id, ts, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1",
    ),
    "concat_permissive": (
        lambda s, d: reshape.concat_permissive([table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))]),
        "select c_custkey as key, c_acctbal as bal, c_mktsegment as seg from customer union all select s_suppkey, s_acctbal, null from supplier",
    ),
    "depth_average": (
        lambda s, d: r6(transect.depth_avg(_transect(s, d), "u", ["sample"]), "mean"),
        "select l_suppkey as sample, round(sum(l_extendedprice * l_quantity / 10) / sum(l_quantity / 10), 6) as mean from lineitem group by 1",
    ),
    "vertical_slope": (
        lambda s, d: r6(transect.vertical_slope(_transect(s, d), "u", "z", ["sample"]), "slope"),
        "select l_suppkey as sample, round(case when count(*) >= 2 then regr_slope(l_extendedprice, l_discount) end, 6) as slope from lineitem group by 1",
    ),
}
