"""Unstructured meshes as tables: nodes(node, x, y), cell_nodes(cell, pos, node), edges(edge, n1, n2, left, right)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.session import saved, shuffled


def rectilinear(spark: SparkSession, nx: int, ny: int, dx: float = 1.0, dy: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and cell nodes of nx by ny rectangles, each ring counter-clockwise."""
    k = spark.range((nx + 1) * (ny + 1))
    nodes = k.select(F.col("id").alias("node"), (F.col("id") % (nx + 1) * dx).alias("x"), (F.floor(F.col("id") / (nx + 1)) * dy).alias("y"))
    c = spark.range(nx * ny).select(F.col("id").alias("cell"), (F.col("id") % nx + F.floor(F.col("id") / nx) * (nx + 1)).alias("a"))
    ring = F.array(F.col("a"), F.col("a") + 1, F.col("a") + nx + 2, F.col("a") + nx + 1)
    return nodes, c.select("cell", F.posexplode(ring).alias("pos", "node"))


def half_edges(cell_nodes: DataFrame) -> DataFrame:
    """``(cell, pos, a, b)``: each side of each ring in its direction."""
    w = Window.partitionBy("cell").orderBy("pos")
    first = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cell_nodes.select("cell", "pos", F.col("node").alias("a"), F.coalesce(F.lead("node").over(w), first).alias("b"))


def edges_of(cell_nodes: DataFrame, more: str = "error") -> DataFrame:
    """``(n1, n2, left, right)``, n1 < n2: the cell whose ring runs n1 to n2 is left; null beyond the boundary.

    More than one cell on a side of an edge is no mesh and an error; with ``more='last'`` the one of the largest number counts.
    """
    if more not in ("error", "last"):
        raise ValueError("more is error or last")
    h = half_edges(cell_nodes).select(F.least("a", "b").alias("n1"), F.greatest("a", "b").alias("n2"), (F.col("a") < F.col("b")).alias("ahead"), "cell")
    sides = {"left": F.when(F.col("ahead"), F.col("cell")), "right": F.when(~F.col("ahead"), F.col("cell"))}
    e = h.groupBy("n1", "n2").agg(*(f(c).alias(n + s) for n, c in sides.items() for f, s in ((F.max, ""), (F.count, "_held"))))
    if more == "error":
        many = F.raise_error(F.concat_ws(" ", F.lit("several cells on a side of edge"), "n1", "n2"))
        e = e.withColumns({n: F.when(F.col(f"{n}_held") > 1, many.cast("bigint")).otherwise(F.col(n)) for n in sides})
    return e.select("n1", "n2", "left", "right")


def boundary_edges(edges: DataFrame) -> DataFrame:
    return edges.where("left is null or right is null")


def cell_neighbours(edges: DataFrame) -> DataFrame:
    both = edges.where("left is not null and right is not null")
    return both.select(F.col("left").alias("cell"), F.col("right").alias("other")).union(both.select("right", "left")).distinct()


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("n1", "n2")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _sides(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    h = half_edges(cell_nodes)
    a = nodes.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    s = h.join(shuffled(a), "a").join(shuffled(b), "b")
    # Seen from a corner of the cell, so that products of large coordinates don't cancel.
    own = Window.partitionBy("cell")
    s = s.withColumn("_o", F.min(F.struct("pos", "ax", "ay")).over(own)).withColumns({"x0": F.col("_o.ax"), "y0": F.col("_o.ay")}).drop("_o")
    s = s.withColumns({"ax": F.col("ax") - F.col("x0"), "ay": F.col("ay") - F.col("y0"), "bx": F.col("bx") - F.col("x0"), "by": F.col("by") - F.col("y0")})
    return s.withColumn("cross", F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))


def cell_geometry(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cell, area, cx, cy, sides)``: signed area (counter-clockwise positive) and area-weighted centroid."""
    s = _sides(cell_nodes, nodes).groupBy("cell").agg(
        (F.sum("cross") / 2).alias("area"), F.sum((F.col("ax") + F.col("bx")) * F.col("cross")).alias("mx"), F.sum((F.col("ay") + F.col("by")) * F.col("cross")).alias("my"), F.count("*").alias("sides"), F.first("x0").alias("x0"), F.first("y0").alias("y0")
    )
    return s.select("cell", "area", (F.col("x0") + F.col("mx") / (6 * F.col("area"))).alias("cx"), (F.col("y0") + F.col("my") / (6 * F.col("area"))).alias("cy"), "sides")


def edge_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with length, centre (ex, ey) and unit normal (nx, ny) from left to right."""
    a = nodes.select(F.col("node").alias("n1"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("n2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = edges.join(shuffled(a), "n1").join(shuffled(b), "n2")
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    e = e.withColumn("length", length).withColumns({"ex": (F.col("ax") + F.col("bx")) / 2, "ey": (F.col("ay") + F.col("by")) / 2, "nx": (F.col("by") - F.col("ay")) / F.col("length"), "ny": (F.col("ax") - F.col("bx")) / F.col("length")})
    return e.drop("ax", "ay", "bx", "by")


def node_to_cell(cell_nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``(cell, value)``: mean over a cell's nodes, null if any node has none."""
    both = cell_nodes.join(shuffled(values.select("node", "value")), "node", "left")
    return both.groupBy("cell").agg(F.when(F.count("value") == F.count("*"), F.avg("value")).alias("value"))


def cell_to_node(cell_nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``(node, value)``: unweighted mean over the cells at a node."""
    return cell_nodes.join(shuffled(values.select("cell", "value")), "cell").groupBy("node").agg(F.avg("value").alias("value"))


def perot(cell_nodes: DataFrame, nodes: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(cell, u, v)``: vectors from normal components ``values(n1, n2, value)`` on edges: sums of v n d L / A, d from the cell's centre to the edge."""
    geo = cell_geometry(cell_nodes, nodes)
    e = edge_geometry(edges, nodes).join(shuffled(values.select("n1", "n2", "value")), ["n1", "n2"])
    side = e.where("left is not null").withColumn("cell", F.col("left")).unionByName(e.where("right is not null").withColumn("cell", F.col("right")))
    d = F.abs((F.col("ex") - F.col("cx")) * F.col("nx") + (F.col("ey") - F.col("cy")) * F.col("ny"))
    part = side.join(shuffled(geo), "cell").withColumn("w", F.col("value") * d * F.col("length") / F.abs("area"))
    return part.groupBy("cell").agg(F.sum(F.col("w") * F.col("nx")).alias("u"), F.sum(F.col("w") * F.col("ny")).alias("v"))


def divergence(edges: DataFrame, flux: DataFrame) -> DataFrame:
    """``(cell, net)``: flux out of each cell, ``flux(n1, n2, value)`` counted from left to right."""
    e = edges.join(shuffled(flux.select("n1", "n2", "value")), ["n1", "n2"])
    each = e.select(F.col("left").alias("cell"), "value").union(e.select("right", -F.col("value"))).where("cell is not null")
    return each.groupBy("cell").agg(F.sum("value").alias("net"))


def smoothed(edges: DataFrame, values: DataFrame, f: float = 0.5) -> DataFrame:
    """``(cell, value)``: (1 - f) of a cell's value and f of its neighbours' mean."""
    near = cell_neighbours(edges).join(shuffled(values.select(F.col("cell").alias("other"), F.col("value").alias("_o"))), "other").groupBy("cell").agg(F.avg("_o").alias("_m"))
    return values.join(shuffled(near), "cell", "left").select("cell", ((1 - f) * F.col("value") + f * F.coalesce("_m", "value")).alias("value"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """``(node, into)``: nodes of equal coordinates become the smallest."""
    return nodes.select("node", F.min("node").over(Window.partitionBy("x", "y")).alias("into"))


def renumbered(df: DataFrame, key: str, partitions: int = 64) -> DataFrame:
    """``(key, number)``: distinct keys numbered from 0 in order, by ranges so that no task sorts them all."""
    keys = df.select(key).distinct().repartitionByRange(partitions, key).select(key, F.spark_partition_id().alias("_p"))
    keys = saved(keys)
    size = keys.groupBy("_p").agg(F.count("*").alias("_n"))
    size = size.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each range
    numbered = keys.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    return numbered.join(F.broadcast(size), "_p").select(key, (F.col("_before") + F.col("_i") - 1).alias("number"))
