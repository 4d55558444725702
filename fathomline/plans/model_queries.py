"""Spectra, gradients and texts of flow models over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import time as T
from fathomline.operators import mesh_joins, raster, spectra, transect
from fathomline.plans.more_queries import _LAT, _cell_values, _lat
from fathomline.plans.series_queries import events, r6, table
from fathomline.plans.space_queries import _GRID, grid
from fathomline.sources import models

LAG, BINS = 6, 16


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    numbered = events(s, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return r6(spectra.spectrum(numbered, ["user_id"], "i", "value", LAG, BINS, 2.0), "power")


def _period(s: SparkSession, d: str) -> DataFrame:
    days = events(s, d).withColumn("t", T.to_dnum(F.col("ts")) - 19723)
    return spectra.dominant_period(days, ["event_type"], "t", "value", [1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 13.0])


def _gradient(s: SparkSession, d: str) -> DataFrame:
    nodes, ring, edges = _lat(s, d)
    return r6(mesh_joins.cell_gradient(edges, ring, nodes, _cell_values(s, d)), "u", "v")


def _forcing(s: SparkSession, d: str) -> DataFrame:
    """Orders as a file a customer: a block each with two quantities, and a row an order."""
    o = table(s, d, "orders")
    text = ["[forcing]", "Name = place", "Quantity = number", "Unit = -", "Quantity = price", "Unit = dollars", ""]
    head = o.select("o_custkey").distinct().select("o_custkey", F.posexplode(F.array(*map(F.lit, text))).alias("n", "value"))
    rows = o.select("o_custkey", (F.col("o_orderkey") + len(text)).alias("n"), F.concat_ws("  ", "o_orderkey", "o_totalprice").alias("value"))
    found = models.forcing_values(head.withColumn("n", F.col("n").cast("long")).unionByName(rows), "o_custkey")
    return found.select("file", "block", "row", F.element_at("named", "name").alias("place"), "quantity", "unit", "value")


def _polylines(s: SparkSession, d: str) -> DataFrame:
    return models.polyline_lines(table(s, d, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_custkey"], "o_orderstatus")


def _three_files(s: SparkSession, d: str) -> DataFrame:
    """The lattice written as three files, quadrangles in even cells and the triangle of their first corners in odd ones, and read back."""
    nodes, ring, edges = _lat(s, d)
    points = nodes.select(F.col("node").alias("n"), F.concat_ws(" ", "x", "y", F.lit(0)).alias("value"))
    sides = edges.select((F.col("n1") * 1000 + F.col("n2") - F.col("n1")).alias("n"), F.concat_ws(" ", "n1", "n2", F.lit(1), F.coalesce("left", F.lit(-1)), F.coalesce("right", F.lit(-1))).alias("value"))
    each = ring.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"].cast("string")).alias("r"))
    four = F.concat_ws(" ", F.lit("4"), F.lit("0.5"), F.lit("0.25"), F.array_join("r", " "), F.lit("-1 -1 -1 -1"))
    three = F.concat_ws(" ", F.lit("0.5"), F.lit("0.25"), F.array_join(F.slice("r", 1, 3), " "), F.lit("-1 -1 -1"))
    cells = each.select(F.col("cell").alias("n"), F.when(F.col("cell") % 2 == 0, four).otherwise(three).alias("value"))
    n, e, c, r = models.three_file_mesh(points, sides, cells)
    inner = e.select(F.explode(F.array("left", "right")).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count("*").alias("sides"))
    found = r.join(n, "node").groupBy("cell").agg(F.count("*").alias("corners"), F.sum((F.col("pos") + 1) * F.col("node")).alias("places"), F.sum("x").alias("x"))
    return r6(found.join(inner, "cell").join(c, "cell").select("cell", "corners", "places", "x", "sides", "cx", "cy"), "x")


def _errors(s: SparkSession, d: str) -> DataFrame:
    nodes, ring, _ = _lat(s, d)
    return r6(mesh_joins.circumcentre_errors(ring, nodes), "error")


def _clearance(s: SparkSession, d: str) -> DataFrame:
    nodes, ring, edges = _lat(s, d)
    return r6(mesh_joins.edge_clearance(edges, ring, nodes), "clearance")


def _secondary(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_quantity") - 25) * 1.4142135623).alias("v"), F.lit(0.5).alias("dz"))
    return r6(transect.secondary_strength(t, "v", "l_linenumber", ["l_orderkey"]), "strength")


_CENTRES = """t as (select p.cell, a.x as ax, a.y as ay, b.x - a.x as bx, b.y - a.y as b_y, c.x - a.x as cx, c.y - a.y as c_y from h p join h q on q.cell = p.cell and q.a = p.b join nodes a on a.node = p.a join nodes b on b.node = p.b join nodes c on c.node = q.b),
cc as (select cell, avg(ax + (c_y * (bx * bx + b_y * b_y) - b_y * (cx * cx + c_y * c_y)) / (2 * (bx * c_y - b_y * cx))) as x, avg(ay + (bx * (cx * cx + c_y * c_y) - cx * (bx * bx + b_y * b_y)) / (2 * (bx * c_y - b_y * cx))) as y from t group by 1)"""

Q = {
    "spectrum": (
        _spectrum,
        f"""with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
        f as (select user_id, i, value - avg(value) over w - (covar_pop(value, i) over w / var_pop(i) over w) * (i - avg(i) over w) as v from e window w as (partition by user_id)),
        c as (select a.user_id, b.i - a.i as lag, avg(a.v * b.v) as cov from f a join f b on a.user_id = b.user_id and b.i - a.i between 0 and {LAG} group by 1, 2),
        p as (select user_id, bin, sum(cov * case when lag = 0 then 1.0 else 1 + cos(lag * {math.pi / LAG!r}::double) end * cos(bin * lag * {2 * math.pi / BINS!r}::double)) as power from c, (select unnest(range(0, {BINS // 2 + 1})) as bin) group by 1, 2)
        select user_id, bin / {2.0 * BINS}::double as frequency, round(abs(power) * case when bin in (0, {BINS // 2}) then 2.0 else 4.0 end, 6) as power from p""",
    ),
    "dominant_period": (_period, None),
    "cell_gradient": (
        _gradient,
        f"""with {_LAT}, c as (select g.*, cv.value from g join cv using (cell)),
        sl as (select n1, n2, coalesce((b.value - a.value) / sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2), 0) as slope from e left join c a on a.cell = l left join c b on b.cell = r),
        s as (select l as cell, eg.*, slope from eg join sl using (n1, n2) where l is not null union all select r, eg.*, slope from eg join sl using (n1, n2) where r is not null),
        w as (select s.cell, s.nx, s.ny, s.slope * abs((ex - cx) * nx + (ey - cy) * ny) * len / abs(area) as w from s join g on s.cell = g.cell) select cell, round(sum(w * nx), 6) as u, round(sum(w * ny), 6) as v from w group by 1""",
    ),
    "forcing_values": (
        _forcing,
        """with o as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as row from orders)
        select o_custkey as file, 1 as block, row, 'place' as place, 'number' as quantity, '-' as unit, cast(o_orderkey as double) as value from o union all select o_custkey, 1, row, 'place', 'price', 'dollars', o_totalprice from o""",
    ),
    "polyline_lines": (
        _polylines,
        """select o_custkey, 0 as n, cast(o_custkey as varchar) as value from orders group by 1 union all select o_custkey, 1, printf('  %d     %d', count(*), 2) from orders group by 1
        union all select o_custkey, 1 + row_number() over (partition by o_custkey order by o_orderkey), printf('%s  %s   %s', cast(o_orderkey as varchar), lpad(cast(o_custkey as varchar), 15, ' '), o_orderstatus) from orders""",
    ),
    "three_file_mesh": (
        _three_files,
        f"""with {_LAT}, k as (select * from ring where cell % 2 = 0 or pos < 3), f as (select cell, count(*) as corners, cast(sum((pos + 1) * node) as bigint) as places, round(sum(x), 6) as x from k join nodes using (node) group by 1)
        select cell, corners, places, x, 4 as sides, 0.5::double as cx, 0.25::double as cy from f""",
    ),
    "circumcentre_errors": (_errors, f"with {_LAT}, {_CENTRES} select cell, round(stddev_pop(sqrt((n.x - cc.x) ** 2 + (n.y - cc.y) ** 2)), 6) as error from ring join nodes n using (node) join cc using (cell) group by 1"),
    "edge_clearance": (
        _clearance,
        f"""with {_LAT}, {_CENTRES}, c as (select cc.*, sqrt(greatest(area, 1e-5::double)) as size from cc join g using (cell))
        select n1, n2, round(least(((ex - a.x) * nx + (ey - a.y) * ny) / a.size, ((b.x - ex) * nx + (b.y - ey) * ny) / b.size), 6) as clearance from eg left join c a on a.cell = l left join c b on b.cell = r""",
    ),
    "cell_edges": (
        lambda s, d: r6(raster.cell_edges(grid(s, d), 8, 60000.0, 2.0, 1.0), "length", "value"),
        f"""with g as (select * from ({_GRID}) where value <= 60000), q as (select a.row as r, a.col as c, a.value + b.value + x.value + y.value as total from g a join g b on b.row = a.row + 1 and b.col = a.col + 1 join g x on x.row = a.row and x.col = a.col + 1 join g y on y.row = a.row + 1 and y.col = a.col)
        select r as a_row, c as a_col, r + 1 as b_row, c + 1 as b_col, round(sqrt(5.0::double), 6) as length, round(total / 4, 6) as value from q union all select r, c + 1, r + 1, c, round(sqrt(5.0::double), 6), round(total / 4, 6) from q
        union all select a.row, a.col, b.row, b.col, case when a.row = b.row then 2.0::double else 1.0::double end, round((a.value + b.value) / 2, 6) from g a join g b on (b.row = a.row + 1 and b.col = a.col) or (b.row = a.row and b.col = a.col + 1)""",
    ),
    "secondary_strength": (
        _secondary,
        """with t as (select l_orderkey, l_linenumber as k, max((l_quantity - 25) * 1.4142135623::double) as v from lineitem group by 1, 2), m as (select *, row_number() over (partition by l_orderkey order by k) as i, count(*) filter (v < 0) over (partition by l_orderkey) as m from t)
        select l_orderkey, round(coalesce(avg(v) filter (i <= m), 0), 6) + 0.0::double as strength from m group by 1""",
    ),
}
