"""Joins over quadtrees, faces, rings, bottlenecks, solves and clips over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators import mesh, overlay, quadtree, rings, solve, spanning, tiles
from fathomline.plans.more_queries import _LAT, lattice
from fathomline.plans.series_queries import r6, table


def crowded(s: SparkSession, d: str) -> DataFrame:
    """Orders as points that crowd towards a corner."""
    u, v = F.col("o_totalprice") / 500000.0, F.col("o_orderkey") % 1000 / 1000.0
    return table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), (u * u * u * 100).alias("x"), (v * v * v * 100).alias("y"))


def posts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") % 41 + 0.25).alias("x"), (F.col("s_suppkey") * 7 % 53 + 0.75).alias("y"))


def stars(s: SparkSession, d: str) -> DataFrame:
    """A concave ring of customers for each nation, each customer a corner as far out as its balance."""
    w = Window.partitionBy("c_nationkey")
    c = table(s, d, "customer").withColumns({"pos": F.row_number().over(w.orderBy("c_custkey")) - 1, "n": F.count("*").over(w)})
    far = 4 + 14 * (F.col("c_acctbal") + 1000) / 11000
    turn = 2 * 3.141592653589793 * F.col("pos") / F.col("n")
    return c.select(F.col("c_nationkey").alias("poly"), "pos", (F.col("c_nationkey") % 5 * 20 + 10 + far * F.cos(turn)).alias("x"), (F.floor(F.col("c_nationkey") / 5) * 20 + 10 + far * F.sin(turn)).alias("y"))


_CROWDED = "q as (select o_orderkey as qid, u * u * u * 100 as x, v * v * v * 100 as y from (select o_orderkey, o_totalprice / 500000.0::double as u, (o_orderkey % 1000) / 1000.0::double as v from orders))"
_POSTS = "p as (select s_suppkey as pid, s_suppkey % 41 + 0.25::double as x, s_suppkey * 7 % 53 + 0.75::double as y from supplier)"
_STARS = """corner as (select c_nationkey as poly, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos, count(*) over (partition by c_nationkey) as n, 4 + 14 * (c_acctbal + 1000) / 11000::double as far from customer),
star as (select poly, pos, poly % 5 * 20 + 10 + far * cos(2 * 3.141592653589793::double * pos / n) as x, poly // 5 * 20 + 10 + far * sin(2 * 3.141592653589793::double * pos / n) as y from corner),
edge as (select poly, x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1 from star window w as (partition by poly order by pos)),
box as (select poly, min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb from star group by 1)"""
_NEAR = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"

def faces(s: SparkSession, d: str) -> DataFrame:
    """The lattice's cells from its edges alone."""
    nodes, ring = lattice(s, d)
    return rings.cells_from_edges(mesh.edges_of(ring).select("n1", "n2"), nodes, 4).select(F.col("cell.a").alias("cell"), "pos", "node")


def rims(s: SparkSession, d: str) -> DataFrame:
    """The lattice's boundaries where every 11th cell is left out."""
    nodes, ring = lattice(s, d)
    found = rings.ordered_boundaries(mesh.edges_of(ring.where("cell % 11 <> 5")), nodes)
    return r6(found.select(F.col("ring.a").alias("a"), F.col("ring.b").alias("b"), "pos", "node", "area"), "area")


def sizes(s: SparkSession, d: str) -> DataFrame:
    """Parts' sizes as a raster 40 wide."""
    n = F.col("p_partkey")
    return table(s, d, "part").select(F.floor(n / 40).alias("row"), (n % 40).alias("col"), F.col("p_size").cast("double").alias("value"))


def crossings(s: SparkSession, d: str) -> DataFrame:
    return r6(rings.contours(sizes(s, d), 30.5).select(F.col("h.kind").alias("kind"), F.col("h.row").alias("row"), F.col("h.col").alias("col"), "x", "y"), "x", "y")


def shipped(s: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as nodes, linked where a supplier shipped a part, at the least quantity."""
    li = table(s, d, "lineitem")
    return li.groupBy((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).agg(F.min("l_quantity").alias("w"))


def bottleneck(s: SparkSession, d: str) -> DataFrame:
    """From each supplier to five others."""
    k = table(s, d, "supplier").select("s_suppkey")
    n = k.agg(F.max("s_suppkey").alias("n"))
    pairs = k.crossJoin(F.broadcast(n)).select((F.col("s_suppkey") * 2 + 1).alias("u"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: ((F.col("s_suppkey") + i * 7 - 1) % F.col("n") + 1) * 2 + 1)).alias("v"))
    return spanning.bottlenecks(shipped(s, d), pairs)


def forest(s: SparkSession, d: str) -> DataFrame:
    return spanning.spanning_forest(shipped(s, d))


def levels(s: SparkSession, d: str) -> DataFrame:
    """Four by four raster points for each part, over the lattice."""
    nodes, ring = lattice(s, d)
    n, k = F.col("p_partkey"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")
    fine = table(s, d, "part").select(n, "p_size", k).select((F.floor(n / 40) * 4 + F.floor(F.col("k") / 4)).alias("row"), (n % 40 * 4 + F.col("k") % 4).alias("col"), ((F.col("p_size") * 7 + F.col("k") * 29) % 53).cast("double").alias("value"))
    return spanning.connection_levels(mesh.edges_of(ring), ring, nodes, fine, 0.013, 0.017, 0.25, 0.25)


def spread(s: SparkSession, d: str) -> DataFrame:
    """Each fourth cell's largest quantity, weighed by cell number, over the lattice."""
    nodes, ring = lattice(s, d)
    samples = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.max("l_quantity").alias("value")).where("cell % 4 = 0")
    samples = samples.join(ring.select("cell").distinct(), "cell").select("cell", "value", (1.0 + F.col("cell") % 3).alias("weight"))
    return r6(solve.extrapolated(mesh.edges_of(ring), ring, nodes, samples, 2.0, 1.0, tolerance=1e-13), "value", "weight")


def shares(s: SparkSession, d: str) -> DataFrame:
    """How much of each lattice cell lies in each nation's star."""
    nodes, ring = lattice(s, d)
    found = overlay.areas_in_regions(ring, nodes, quadtree.ring_edges(stars(s, d))).where("area > 1e-3")  # slivers are within the operator's shift, and whole cells' areas would be ties of rounding
    return found.select("cell", "region", F.round(F.col("area") + 0.00031, 3).alias("area"), F.round(F.col("share") + 0.00031, 3).alias("share"))


def cuts(s: SparkSession, d: str) -> DataFrame:
    return r6(overlay.halves(quadtree.ring_edges(stars(s, d)), 50.0, 50.0, 1.0, 2.0), "left", "right")


Q = {
    "quad_radius": (
        lambda s, d: quadtree.within(posts(s, d), crowded(s, d), 1.5, digits=6),
        f"with {_CROWDED}, {_POSTS} select pid, qid, round({_NEAR}, 6) as d from p join q on {_NEAR} <= 1.5",
    ),
    "quad_nearest": (
        lambda s, d: r6(quadtree.nearest(posts(s, d), crowded(s, d), 4), "d"),
        f"with {_CROWDED}, {_POSTS}, n as (select pid, qid, {_NEAR} as d, row_number() over (partition by pid order by {_NEAR}, qid) as rank from p, q) select pid, qid, round(d, 6) as d, cast(rank as int) as rank from n where rank <= 4",
    ),
    "quad_polygons": (
        lambda s, d: quadtree.in_polygons(crowded(s, d), quadtree.ring_edges(stars(s, d)), "qid"),
        f"""with {_CROWDED}, {_STARS}, m as (select qid, poly, q.x, q.y from q join box on q.x between xa and xb and q.y between ya and yb)
        select qid, m.poly from m join edge using (poly) group by 1, 2
        having sum(case when (y0 <= m.y) <> (y1 <= m.y) and m.x < x0 + (m.y - y0) * (x1 - x0) / (y1 - y0) then 1 else 0 end) % 2 = 1""",
    ),
    "faces_of_edges": (
        faces,
        f"""with {_LAT}, t as (select cell, min(node) as first from ring group by 1), s as (select ring.cell, ring.pos as start, first from ring join t using (cell) where node = first)
        select first as cell, (pos - start + 4) % 4 as pos, node from ring join s using (cell)""",
    ),
    "ordered_boundaries": (
        rims,
        f"""with recursive {_LAT}, ok as (select * from h where cell % 11 <> 5), b as (select a, b from ok where not exists (select 1 from ok as o where o.a = ok.b and o.b = ok.a)),
        turn as (select b.a as i, b.b as j, c.b as k, atan2(p.y - q.y, p.x - q.x) - atan2(r.y - q.y, r.x - q.x) as t from b join b as c on c.a = b.b join nodes p on p.node = b.a join nodes q on q.node = b.b join nodes r on r.node = c.b),
        nxt as (select i, j, arg_min(k, case when t <= 0 then t + 2 * pi() else t end) as k from turn group by 1, 2),
        walk as (select i as a, j as b, i, j, 0 as pos from nxt union all select w.a, w.b, n.i, n.j, w.pos + 1 from walk w join nxt m on m.i = w.i and m.j = w.j join nxt n on n.i = w.j and n.j = m.k
          where (n.i, n.j) <> (w.a, w.b) and (n.i > w.a or (n.i = w.a and n.j > w.b))),
        size as (select i, j, count(*) as n from (select a, b, i, j from walk) group by 1, 2),
        whole as (select w.a, w.b, max(w.pos) as last from walk w group by 1, 2),
        done as (select w.a, w.b from whole join walk w on w.a = whole.a and w.b = whole.b and w.pos = whole.last join nxt m on m.i = w.i and m.j = w.j where w.j = w.a and m.k = w.b),
        ring2 as (select w.* from walk w join done using (a, b)),
        area as (select w.a, w.b, sum(p.x * q.y - q.x * p.y) / 2 as area from ring2 w join nodes p on p.node = w.i join nodes q on q.node = w.j group by 1, 2)
        select w.a, w.b, w.pos, w.i as node, round(area, 6) as area from ring2 w join area using (a, b)""",
    ),
    "contour_crossings": (
        crossings,
        """with g as (select p_partkey // 40 as row, p_partkey % 40 as col, p_size as v from part),
        n as (select a.row, a.col, k.kind, a.v as v, b.v as w from g a, (values (0, 0, 1), (1, 1, 0)) as k(kind, i, j) join g b on b.row = a.row + k.i and b.col = a.col + k.j),
        sq as (select a.row, a.col from g a join g b on b.row = a.row and b.col = a.col + 1 join g c on c.row = a.row + 1 and c.col = a.col join g d on d.row = a.row + 1 and d.col = a.col + 1)
        select kind, row, col, round(case when kind = 0 then col + (30.5 - v) / (w - v)::double else col end, 6) as x, round(case when kind = 1 then row + (30.5 - v) / (w - v)::double else row end, 6) as y from n
        where (v >= 30.5) <> (w >= 30.5) and exists (select 1 from sq where (sq.row = n.row and sq.col = n.col) or (sq.row = n.row - (1 - kind) and sq.col = n.col - kind))""",
    ),
    "bottleneck_paths": (
        bottleneck,
        """with l as (select l_partkey as p, l_suppkey as s, min(l_quantity) as w from lineitem group by 1, 2),
        m0 as (select a.s as i, b.s as j, min(greatest(a.w, b.w)) as w from l a join l b on a.p = b.p group by 1, 2),
        """
        + ",\n        ".join(f"m{k + 1} as (select a.i, b.j, min(greatest(a.w, b.w)) as w from m{k} a join m{k} b on a.j = b.i group by 1, 2)" for k in range(7))
        + """,
        n as (select max(s_suppkey) as n from supplier), q as (select distinct s_suppkey as i, (s_suppkey + k.k * 7 - 1) % n + 1 as j from supplier, n, (values (1), (2), (3), (4), (5)) as k(k))
        select q.i * 2 + 1 as u, q.j * 2 + 1 as v, case when q.i <> q.j then w end as w from q left join m7 using (i, j)""",
    ),
    "spanning_forest": (forest, None),
    "connection_levels": (levels, None),
    "extrapolated": (
        spread,
        f"""with recursive {_LAT}, k as (select l as i, r as j, len / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) as k from eg join g a on a.cell = l join g b on b.cell = r),
        o as (select i, j, k from k union all select j, i, k from k), d as (select cell as i, 2 * area + coalesce((select sum(k) from o where o.i = g.cell), 0) as d from g),
        f as (select d.i, d, case when i % 4 = 0 then coalesce(value * (1 + i % 3), 0) else 0 end as b, case when i % 4 = 0 and value is not null then 1 + i % 3 else 0 end as c from d left join cv on cv.cell = d.i),
        x as (select 0 as n, i, b / d as v, c / d as w from f union all
          select any_value(x.n) + 1, f.i, (any_value(f.b) + coalesce(sum(o.k * y.v), 0)) / any_value(f.d), (any_value(f.c) + coalesce(sum(o.k * y.w), 0)) / any_value(f.d)
          from x join f using (i) left join o on o.i = f.i left join x y on y.i = o.j where x.n < 100 group by f.i)
        select i as cell, round(v / w, 6) as value, round(w, 6) as weight from x where n = 100""",
    ),
    "areas_in_regions": (
        shares,
        f"""with {_LAT}, {_STARS}, a as (select cell, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from h join nodes p on p.node = a join nodes q on q.node = b),
        a2 as (select cell, x0, y0, x1, y1, min(x0) over w as ox, min(y0) over w as oy, max(x0) over w as mx, max(y0) over w as my from a window w as (partition by cell)),
        b2 as (select edge.*, xa, xb, ya, yb from edge join box using (poly)),
        m as (select a2.*, poly, b2.x0 as u0, b2.y0 as v0, b2.x1 as u1, b2.y1 as v1 from a2 join b2 on ox <= xb and mx >= xa and oy <= yb and my >= ya),
        k as (select *, (u1 - u0) * (y1 - y0) - (v1 - v0) * (x1 - x0) as d, (x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy) as ca, (u0 - ox) * (v1 - oy) - (u1 - ox) * (v0 - oy) as cb from m),
        c as (select *, ((v0 - y0) * (u1 - u0) - (u0 - x0) * (v1 - v0)) / nullif(d, 0) as t, ((v0 - y0) * (x1 - x0) - (u0 - x0) * (y1 - y0)) / nullif(d, 0) as u from k),
        x as (select cell, poly, sum(sign(d) * ((1 - t) * ca - (1 - u) * cb)) as part from c where t >= 0 and t < 1 and u >= 0 and u < 1 group by 1, 2),
        pa as (select cell, poly, x0, y0, ca from k group by all having sum(case when (v0 <= y0) <> (v1 <= y0) and x0 < u0 + (y0 - v0) * (u1 - u0) / nullif(v1 - v0, 0) then 1 else 0 end) % 2 = 1),
        pb as (select cell, poly, u0, v0, cb from k group by all having sum(case when (y0 <= v0) <> (y1 <= v0) and u0 < x0 + (v0 - y0) * (x1 - x0) / nullif(y1 - y0, 0) then 1 else 0 end) % 2 = 1),
        s as (select cell, poly, part from x union all select cell, poly, ca from pa union all select cell, poly, cb from pb),
        t as (select cell, poly, sum(part) / 2 as area from s group by 1, 2)
        select t.cell, poly as region, round(t.area + 0.00031, 3) as area, round(t.area / g.area + 0.00031, 3) as share from t join g on g.cell = t.cell where t.area > 1e-3""",
    ),
    "polygon_halves": (
        cuts,
        f"""with {_STARS}, s as (select poly, (y0 - 50) - 2 * (x0 - 50) as s0, (y1 - 50) - 2 * (x1 - 50) as s1, (x0 - 50) * (y1 - 50) - (x1 - 50) * (y0 - 50) as c from edge),
        w as (select poly, c, case when s0 >= 0 and s1 >= 0 then 1 when s0 < 0 and s1 < 0 then 0 when s0 >= 0 then s0 / (s0 - s1) else s1 / (s1 - s0) end as w from s)
        select poly, round(sum(c * w) / 2, 6) as left, round(sum(c * (1 - w)) / 2, 6) as right from w group by 1""",
    ),
    "tiles_smoothed": (
        lambda s, d: r6(tiles.smoothed(sizes(s, d), size=32), "value"),
        """with g as (select p_partkey // 40 as row, p_partkey % 40 as col, cast(p_size as double) as v from part), m as (select max(row) as rs, max(col) as cs from g),
        k as (select g.row, g.col, least(greatest(g.row + i.i, 0), rs) as r, least(greatest(g.col + j.j, 0), cs) as c from g, m, (values (-1), (0), (1)) as i(i), (values (-1), (0), (1)) as j(j))
        select k.row, k.col, round(avg(v), 6) as value from k left join g on g.row = k.r and g.col = k.c group by 1, 2""",
    ),
    "tiles_filled": (
        lambda s, d: r6(tiles.filled(sizes(s, d).withColumn("value", F.when(F.col("value") < 45, F.col("value"))), iterations=1, size=32), "value"),
        """with g as (select p_partkey // 40 as row, p_partkey % 40 as col, case when p_size < 45 then cast(p_size as double) end as v from part), m as (select max(row) as rs, max(col) as cs from g),
        a as (select r.r as row, c.c as col, v from m, range(0, 100000) as r(r), range(0, 40) as c(c) left join g on g.row = r.r and g.col = c.c where r.r <= rs and c.c <= cs),
        k as (select a.row, a.col, a.v as own, least(greatest(a.row + i.i, 0), rs) as r, least(greatest(a.col + j.j, 0), cs) as c from a, m, (values (-1), (0), (1)) as i(i), (values (-1), (0), (1)) as j(j)),
        f as (select k.row, k.col, any_value(own) as own, avg(b.v) as near from k left join g as b on b.row = k.r and b.col = k.c group by 1, 2)
        select f.row, f.col, round(coalesce(own, near), 6) as value from f where coalesce(own, near) is not null or exists (select 1 from g where g.row = f.row and g.col = f.col)""",
    ),
}
