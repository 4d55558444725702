"""Exact areas in which two layers of polygons overlap, and polygons cut by lines, from crossings and corners alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.mesh import half_edges
from fathomline.operators.quadtree import in_polygons, quadtree
from fathomline.session import saved, shuffled

#: By so much of the longest edge the second layer is moved aside, so that no corner lies on an edge of the other.
ASIDE = (3.1e-12, 2.3e-12)


def cell_edges(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(poly, x0, y0, x1, y1)``: the sides of mesh cells."""
    a, b = (nodes.select(F.col("node").alias(n), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, n in enumerate("ab"))
    return half_edges(cell_nodes).join(shuffled(a), "a").join(shuffled(b), "b").select(F.col("cell").alias("poly"), "x0", "y0", "x1", "y1")


def areas(edges: DataFrame) -> DataFrame:
    """``(poly, area)``: signed, positive where the inside is at the left of ``edges(poly, x0, y0, x1, y1)``."""
    at = edges.groupBy("poly").agg(F.min("x0").alias("_ox"), F.min("y0").alias("_oy"))
    cross = (F.col("x0") - F.col("_ox")) * (F.col("y1") - F.col("_oy")) - (F.col("x1") - F.col("_ox")) * (F.col("y0") - F.col("_oy"))
    return edges.join(shuffled(at), "poly").groupBy("poly").agg((F.sum(cross) / 2).alias("area"))


def _apart(a: DataFrame, b: DataFrame) -> float | None:
    """The length of which ASIDE is taken: the longest edge, or a share of the coordinates where the layers can meet, as rounding grows with both."""
    far = lambda *of: F.max(F.greatest(*(F.abs(c) for c in of)))
    sizes = [t.where(" and ".join(f"abs({c}) < double('infinity')" for c in ("x0", "y0", "x1", "y1"))).agg(
        far(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("edge"), F.max(F.abs("x0")).alias("x"), F.max(F.abs("y0")).alias("y"),
        (F.max("x0") - F.min("x0") + F.max("y0") - F.min("y0")).alias("extent"),
    ).first() for t in (a, b)]
    if None in (sizes[0]["edge"], sizes[1]["edge"]):
        return None
    # of an edge longer than the first layer, only so much can meet it
    return max(sizes[0]["edge"], min(sizes[1]["edge"], sizes[0]["extent"]), 1e-3 * max(min(s[c] for s in sizes) for c in "xy"))


def overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(first, second, area)`` for each pair of polygons that overlap.

    Both layers are ``edges(poly, x0, y0, x1, y1)`` of closed rings with the inside at the left, concave or not, holes and
    islands as further rings.  Polygons within a layer may overlap or not; repeated edges count repeatedly.

    The border of what two polygons share is made of the parts of either's edges inside the other.  By Green's theorem its area is half the
    sum of those edges' cross products times the share of each that is inside: 1 if its start is, and from each crossing on 1 more
    or less.  So only starts within polygons and crossings of edges are found, both by quadtree, and summed up; no ring is put
    together, no polygon meets another that it doesn't touch, and neither long rings nor crowded places fill a task.

    The second layer is moved by ASIDE of the longest edge, so that edges which both layers share, or corners on edges, have one defined side;
    areas are exact but for that times the length of the border, and overlaps as thin as that are left out.  So neither depends on
    how far a layer reaches beyond the other.
    """
    number = lambda df, side: saved(df.select("poly", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x0 <> x1 or y0 <> y1").withColumn("e", F.monotonically_increasing_id())).select(F.col("poly").alias(side), "e", "x0", "y0", "x1", "y1")
    a, b = number(first, "first"), number(second, "second")
    size = _apart(a, b)
    if size is None:
        return first.select(F.col("poly").alias("first")).where("false").crossJoin(second.select(F.col("poly").alias("second")).where("false")).withColumn("area", F.lit(0.0))
    move = [size * v for v in ASIDE]
    b = b.select("second", "e", *((F.col(c) + move[c[0] == "y"]).alias(c) for c in ("x0", "y0", "x1", "y1")))
    tree = quadtree(*(t.select(F.col("x0").alias("x"), F.col("y0").alias("y")) for t in (a, b)))

    def dealt(t: DataFrame, p: str, side: str) -> DataFrame:
        t = tree.meets(t, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), segments=True)
        return t.select("leaf", side, F.col("e").alias(f"{p}e"), *(F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")))

    met = dealt(a, "a", "first").join(shuffled(dealt(b, "b", "second")), "leaf")
    dx, dy, ex, ey = F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0"), F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    turn = ex * dy - ey * dx  # positive where the first's edge comes into the second
    t = F.try_divide((F.col("by0") - F.col("ay0")) * ex - (F.col("bx0") - F.col("ax0")) * ey, turn)
    u = F.try_divide((F.col("by0") - F.col("ay0")) * dx - (F.col("bx0") - F.col("ax0")) * dy, turn)
    hit = met.withColumns({"t": t, "u": u, "s": F.signum(turn)}).where("t >= 0 and t < 1 and u >= 0 and u < 1").dropDuplicates(["ae", "be"])
    origin = a.groupBy("first").agg(F.min("x0").alias("ox"), F.min("y0").alias("oy"))
    cross = lambda p: (F.col(f"{p}x0") - F.col("ox")) * (F.col(f"{p}y1") - F.col("oy")) - (F.col(f"{p}x1") - F.col("ox")) * (F.col(f"{p}y0") - F.col("oy"))
    length = lambda p: F.hypot(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"))
    inside = lambda of: F.col("s") * ((1 - F.col("t")) * of("a") - (1 - F.col("u")) * of("b"))
    crossing = hit.join(shuffled(origin), "first").select("first", "second", inside(cross).alias("part"), inside(length).alias("border"))
    starts = lambda t: t.select(F.col("e").alias("pid"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    layer = lambda t, side: t.select(F.col(side).alias("poly"), "x0", "y0", "x1", "y1")
    in_b = in_polygons(starts(a), layer(b, "second"), tree=tree).join(shuffled(a.withColumnRenamed("e", "pid")), "pid").join(shuffled(origin), "first").select("first", F.col("poly").alias("second"), cross("").alias("part"), length("").alias("border"))
    in_a = in_polygons(starts(b), layer(a, "first"), tree=tree).join(shuffled(b.withColumnRenamed("e", "pid")), "pid").select(F.col("poly").alias("first"), "second", "x0", "y0", "x1", "y1")
    in_a = in_a.join(shuffled(origin), "first").select("first", "second", cross("").alias("part"), length("").alias("border"))
    total = crossing.unionByName(in_b).unionByName(in_a).groupBy("first", "second").agg((F.sum("part") / 2).alias("area"), F.sum("border").alias("border"))
    return total.where(F.col("area") > (move[0] + move[1]) * F.greatest("border", F.lit(size))).select("first", "second", "area")


def areas_in_regions(cell_nodes: DataFrame, nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """``(cell, region, area, share)``: how much of each mesh cell lies in each region, given as ``overlaps`` takes it."""
    cells = saved(cell_edges(cell_nodes, nodes))
    found = overlaps(cells, regions).join(shuffled(areas(cells).select(F.col("poly").alias("first"), F.col("area").alias("_whole"))), "first")
    return found.select(F.col("first").alias("cell"), F.col("second").alias("region"), "area", (F.col("area") / F.col("_whole")).alias("share"))


def halves(polygons: DataFrame, x: float, y: float, dx: float, dy: float) -> DataFrame:
    """``(poly, left, right)``: the areas of polygons, as ``overlaps`` takes them, on both sides of the line through (x, y) along (dx, dy)."""
    side = lambda k: F.lit(float(dx)) * (F.col(f"y{k}") - y) - F.lit(float(dy)) * (F.col(f"x{k}") - x)
    e = polygons.select("poly", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).withColumns({"s0": side(0), "s1": side(1)})
    # seen from a point of the line, the line itself adds nothing to an area
    cross = (F.col("x0") - x) * (F.col("y1") - y) - (F.col("x1") - x) * (F.col("y0") - y)
    share = F.when((F.col("s0") >= 0) & (F.col("s1") >= 0), 1.0).when((F.col("s0") < 0) & (F.col("s1") < 0), 0.0)
    share = F.coalesce(share, F.when(F.col("s0") >= 0, F.try_divide("s0", F.col("s0") - F.col("s1"))).otherwise(F.try_divide("s1", F.col("s1") - F.col("s0"))))
    return e.groupBy("poly").agg((F.sum(cross * share) / 2).alias("left"), (F.sum(cross * (1 - share)) / 2).alias("right"))
