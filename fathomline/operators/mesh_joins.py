"""Joins of points, regions and other meshes with a mesh, and tables of a mesh that is kept in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.geometry import circumcentre
from fathomline.operators.graph import components
from fathomline.operators.mesh import cell_geometry, cell_neighbours, edge_geometry, perot
from fathomline.operators.spatial import knn, points_in_polygons, within_radius
from fathomline.session import dealt_by, saved, shuffled


def rings(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cell, pos, x, y)``."""
    return cell_nodes.join(shuffled(nodes.select("node", "x", "y")), "node").select("cell", "pos", "x", "y")


def points_to_cells(points: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, size: float, pid: str = "pid") -> DataFrame:
    """``(pid, cell)`` for every point: the cell that holds it, the smallest of several, null for none.  ``size`` is about that of a cell."""
    hits = points_in_polygons(points, rings(cell_nodes, nodes), size, pid, "cell").groupBy(pid).agg(F.min("cell").alias("cell"))
    return points.select(pid).join(shuffled(hits), pid, "left")


def cells_nearest(points: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, size: float, inside: bool = False, pid: str = "pid") -> DataFrame:
    """``(pid, cell)``: the cell with the nearest centroid; with ``inside`` the cell that holds a point comes first."""
    centres = cell_geometry(cell_nodes, nodes).select("cell", F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = knn(points, centres, 1, size, pid, "cell").select(pid, F.col("cell").alias("_near"))
    if not inside:
        return near.select(pid, F.col("_near").alias("cell"))
    return near.join(shuffled(points_to_cells(points, cell_nodes, nodes, size, pid)), pid, "left").select(pid, F.coalesce("cell", "_near").alias("cell"))


def nodes_clipped(nodes: DataFrame, box: tuple[float, float, float, float], invert: bool = False) -> DataFrame:
    """Nodes in ``(xmin, xmax, ymin, ymax)``, edges included, or with ``invert`` those outside."""
    held = F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3])
    return nodes.where(~held if invert else held)


def edges_clipped(edges: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], ends: bool = False) -> DataFrame:
    """Edges whose centre lies in the box, or with ``ends`` both of whose ends do."""
    if ends:
        held = nodes_clipped(nodes, box).select("node")
        return edges.join(shuffled(held.withColumnRenamed("node", "n1")), "n1", "left_semi").join(shuffled(held.withColumnRenamed("node", "n2")), "n2", "left_semi")
    at = edge_geometry(edges, nodes).where(F.col("ex").between(box[0], box[1]) & F.col("ey").between(box[2], box[3])).select("n1", "n2")
    return edges.join(shuffled(at), ["n1", "n2"], "left_semi")


def cells_clipped(cell_nodes: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], by_centre: bool = True) -> DataFrame:
    """``(cell)``: cells whose centroid lies in the box, or any of whose nodes does."""
    if by_centre:
        return cell_geometry(cell_nodes, nodes).where(F.col("cx").between(box[0], box[1]) & F.col("cy").between(box[2], box[3])).select("cell")
    return cell_nodes.join(shuffled(nodes_clipped(nodes, box).select("node")), "node", "left_semi").select("cell").distinct()


def cells_in_polygons(cell_nodes: DataFrame, nodes: DataFrame, polygons: DataFrame, size: float, poly: str = "poly") -> DataFrame:
    """``(cell, poly)``: cells whose centroid lies in a polygon ``(poly, pos, x, y)``."""
    centres = cell_geometry(cell_nodes, nodes).select("cell", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return points_in_polygons(centres, polygons, size, "cell", poly)


def area_by_region(cell_nodes: DataFrame, nodes: DataFrame, polygons: DataFrame, size: float, poly: str = "poly") -> DataFrame:
    """``(poly, area, cells)``: area of the cells whose centroid lies in each polygon."""
    held = cells_in_polygons(cell_nodes, nodes, polygons, size, poly)
    return held.join(shuffled(cell_geometry(cell_nodes, nodes)), "cell").groupBy(poly).agg(F.sum(F.abs("area")).alias("area"), F.count("*").alias("cells"))


def volume_at(cells: DataFrame, level: float) -> DataFrame:
    """``(volume, wet_area)`` of cells (area, depth; depth is the bed's height) under a water level."""
    deep = F.greatest(F.lit(0.0), F.lit(level) - F.col("depth"))
    return cells.agg(F.sum(F.col("area") * deep).alias("volume"), F.sum(F.when(deep > 0, F.col("area")).otherwise(0.0)).alias("wet_area"))


def cell_mean_of_pixels(pixels: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, size: float) -> DataFrame:
    """``(cell, mean, n)``: mean of the pixels ``(pid, x, y, value)`` whose centre lies in each cell."""
    held = points_to_cells(pixels, cell_nodes, nodes, size).where("cell is not null")
    return held.join(shuffled(pixels.select("pid", "value")), "pid").groupBy("cell").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def match_nodes(nodes: DataFrame, other: DataFrame, tolerance: float) -> DataFrame:
    """``(node, into)``: the nearest node of the other mesh within ``tolerance``, the smallest of equally near ones; -1 for none."""
    a, b = nodes.select("node", "x", "y"), other.select(F.col("node").alias("into"), "x", "y")
    near = within_radius(a, b, tolerance, "node", "into").groupBy("node").agg(F.min(F.struct("d", "into"))["into"].alias("into"))
    return nodes.select("node").join(shuffled(near), "node", "left").select("node", F.coalesce("into", F.lit(-1)).alias("into"))


def match_cells(cell_nodes: DataFrame, other_cells: DataFrame, node_map: DataFrame) -> DataFrame:
    """``(cell, into)``: the cell of the other mesh with the same set of nodes, -1 for none."""
    mine = cell_nodes.join(shuffled(node_map), "node").groupBy("cell").agg(F.sort_array(F.collect_list("into")).alias("k"))
    other = other_cells.groupBy(F.col("cell").alias("into")).agg(F.sort_array(F.collect_list("node")).alias("k"))
    best = mine.join(shuffled(other), "k").groupBy("cell").agg(F.min("into").alias("into"))
    return cell_nodes.select("cell").distinct().join(shuffled(best), "cell", "left").select("cell", F.coalesce("into", F.lit(-1)).alias("into"))


def added(nodes: DataFrame, cell_nodes: DataFrame, more_nodes: DataFrame, more_cells: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two meshes as one: nodes, cell nodes, and ``(node, into)`` of the second's nodes, which take a node of the first within ``tolerance`` or a new number."""
    tops = nodes.agg(F.max("node").alias("n")).first()["n"], cell_nodes.agg(F.max("cell").alias("n")).first()["n"]
    top_n, top_c = (-1 if t is None else t for t in tops)
    found = match_nodes(more_nodes, nodes, tolerance)
    new = F.lit(top_n + 1) + F.col("node")
    mapping = saved(found.select("node", F.when(F.col("into") < 0, new).otherwise(F.col("into")).alias("into"), (F.col("into") < 0).alias("new")))
    fresh = more_nodes.join(shuffled(mapping.where("new")), "node").select(F.col("into").alias("node"), "x", "y")
    moved = more_cells.join(shuffled(mapping.select("node", "into")), "node").select((F.col("cell") + top_c + 1).alias("cell"), "pos", F.col("into").alias("node"))
    return nodes.select("node", "x", "y").unionByName(fresh), cell_nodes.select("cell", "pos", "node").unionByName(moved), mapping.select("node", "into")


def owners(local: DataFrame) -> DataFrame:
    """``(cell, proc, local_cell)``: of the parts that hold a global cell, ``(proc, local_cell, cell, boundary)``, the one that owns it.

    A cell at a part's boundary may be a ghost, so a part that holds it inside comes first, then the lowest part.
    """
    return local.groupBy("cell").agg(F.min(F.struct(F.col("boundary").cast("int").alias("b"), "proc", "local_cell")).alias("o")).select("cell", "o.proc", "o.local_cell")


def gathered(values: DataFrame, owned: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """``(cell, value)`` for all global cells: the value ``(proc, local_cell, value)`` of the part that owns each; null for none."""
    held = owned.join(shuffled(values.select("proc", "local_cell", value)), ["proc", "local_cell"]).select("cell", value)
    return cells.select("cell").join(shuffled(held), "cell", "left")


def gathered_last(values: DataFrame, mapping: DataFrame, value: str = "value") -> DataFrame:
    """``(node, value)``: of the values ``(proc, local, value)`` of a global node or edge that of the highest part, by ``mapping(proc, local, node)``."""
    return mapping.join(shuffled(values), ["proc", "local"]).groupBy("node").agg(F.max_by(value, "proc").alias(value))


def edge_to_cell(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(cell, value)``: mean over a cell's edges of ``values(n1, n2, value)``."""
    e = edges.join(shuffled(values.select("n1", "n2", "value")), ["n1", "n2"])
    return e.select(F.explode(F.array("left", "right")).alias("cell"), "value").where("cell is not null").groupBy("cell").agg(F.avg("value").alias("value"))


def edge_slopes(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``(n1, n2, value)``: from the left cell to the right the change of ``values(cell, value)`` over the distance of their centroids; 0 at the boundary."""
    c = cell_geometry(cell_nodes, nodes).join(shuffled(values.select("cell", "value")), "cell").select("cell", "cx", "cy", "value")
    a, b = (c.select(F.col("cell").alias(s), *(F.col(x).alias(f"{s[0]}_{x}") for x in ("cx", "cy", "value"))) for s in ("left", "right"))
    e = edges.join(shuffled(a), "left", "left").join(shuffled(b), "right", "left")
    far = F.sqrt(F.pow(F.col("r_cx") - F.col("l_cx"), 2) + F.pow(F.col("r_cy") - F.col("l_cy"), 2))
    return e.select("n1", "n2", F.coalesce((F.col("r_value") - F.col("l_value")) / far, F.lit(0.0)).alias("value"))


def cell_gradient(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``(cell, u, v)``: the gradient of ``values(cell, value)``: slopes across edges as normal components, see ``mesh.perot``; edges without two values have slope 0."""
    return perot(cell_nodes, nodes, edges, edge_slopes(edges, cell_nodes, nodes, values))


def contour_edges(edges: DataFrame, values: DataFrame, level: float) -> DataFrame:
    """``(n1, n2)`` of the edges between a cell below a level and one at or above it."""
    v = values.select("cell", F.col("value").alias("v"))
    e = edges.join(shuffled(v.withColumnsRenamed({"cell": "left", "v": "a"})), "left").join(shuffled(v.withColumnsRenamed({"cell": "right", "v": "b"})), "right")
    return e.where((F.col("a") < level) != (F.col("b") < level)).select("n1", "n2")


def node_neighbours(edges: DataFrame) -> DataFrame:
    """``(node, other)``, each edge both ways."""
    return edges.select(F.col("n1").alias("node"), F.col("n2").alias("other")).union(edges.select("n2", "n1")).distinct()


def boundary_rings(edges: DataFrame) -> DataFrame:
    """``(n1, n2, ring)``: boundary edges and the connected ring they belong to, named by its smallest node."""
    out = edges.where("left is null or right is null").select("n1", "n2")
    found = components(out, "n1", "n2")
    return out.join(shuffled(found.select(F.col("id").alias("n1"), F.col("component").alias("ring"))), "n1")


def cell_components(edges: DataFrame, cells: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """``(cell, component)``: cells that edges join, without the edges ``cut(n1, n2)``; the name is the smallest cell."""
    open_ = edges if cut is None else edges.join(shuffled(cut), ["n1", "n2"], "left_anti")
    found = components(cell_neighbours(open_), "cell", "other")
    return cells.select("cell").join(shuffled(found.withColumnRenamed("id", "cell")), "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"))


def main_component(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells of the component that has most, of equal ones that with the smallest cell."""
    found = saved(cell_components(edges, cells))
    size = found.groupBy("component").agg(F.count("*").alias("n"))
    best = size.agg(F.min(F.struct(-F.col("n"), "component"))["component"].alias("component"))  # one row
    return found.join(F.broadcast(best), "component", "left_semi").select("cell")


def linear_strings(edges: DataFrame) -> DataFrame:
    """``(n1, n2, string)``: edges ``(n1, n2)`` that meet at nodes of two edges are one string, named by its smallest edge, a struct of its nodes."""
    e = edges.select("n1", "n2", F.struct("n1", "n2").alias("e"))
    end = e.select(F.explode(F.array("n1", "n2")).alias("node"), "e")
    two = end.groupBy("node").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where("n = 2")
    found = components(two.select("a", "b"))
    return e.join(shuffled(found.withColumnRenamed("id", "e")), "e", "left").select("n1", "n2", F.coalesce("component", "e").alias("string"))


def nodes_rewritten(cell_nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cell nodes with nodes replaced by ``mapping(node, into)``."""
    return cell_nodes.join(shuffled(mapping), "node", "left").select("cell", "pos", F.coalesce("into", "node").alias("node"))


def dual(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dual mesh: nodes at the cells' centroids, and an edge ``(n1, n2)`` between cells that share one."""
    centres = cell_geometry(cell_nodes, nodes).select(F.col("cell").alias("node"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    between = edges.where("left is not null and right is not null")
    return centres, between.select(F.least("left", "right").alias("n1"), F.greatest("left", "right").alias("n2")).distinct()


def angle_errors(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(n1, n2, error)``: for inner edges the cosine between the edge and the line of its cells' centroids; 0 where they are at right angles."""
    c = cell_geometry(cell_nodes, nodes)
    a, b = (c.select(F.col("cell").alias(s), F.col("cx").alias(f"{s[0]}x"), F.col("cy").alias(f"{s[0]}y")) for s in ("left", "right"))
    e = edge_geometry(edges, nodes).join(shuffled(a), "left").join(shuffled(b), "right")
    dx, dy = F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")
    along = (-F.col("ny") * dx + F.col("nx") * dy) / F.sqrt(dx * dx + dy * dy)
    return e.select("n1", "n2", along.alias("error"))


def _corners(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cell, x, y, cx, cy, whole)``, dealt by cell: each node of a ring and the circumcentre of it and the next two, if all three are ``whole``, that is known.

    Rings get their places by one join, and windows in a cell do the rest.
    """
    at = nodes.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(True).alias("_in"))
    ring = dealt_by(cell_nodes.select("cell", "pos", "node"), "node").join(shuffled(at), "node", "left")
    w = Window.partitionBy("cell").orderBy("pos")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct("x", "y", F.coalesce("_in", F.lit(False)).alias("known"))
    ring = dealt_by(ring.select("cell", "pos", p.alias("a")), "cell").withColumns({"_b": F.lead("a").over(w), "_c": F.lead("a", 2).over(w), "_1": F.first("a").over(all_), "_2": F.nth_value("a", 2).over(all_)})
    ring = ring.withColumns({"b": F.coalesce("_b", "_1"), "c": F.coalesce("_c", F.when(F.col("_b").isNull(), F.col("_2")), F.col("_1"))})
    whole = F.col("a.known") & F.col("b.known") & F.col("c.known")
    x, y = circumcentre(*(F.when(whole, F.col(f"{n}.{k}")) for n in "abc" for k in "xy"))
    return ring.where("a.known").select("cell", "a.x", "a.y", x.alias("cx"), y.alias("cy"), whole.alias("whole"))


def polygon_circumcentre(cell_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cell, x, y)``: mean of the circumcentres of each three consecutive nodes of a ring."""
    return _corners(cell_nodes, nodes).where("whole").groupBy("cell").agg(F.avg("cx").alias("x"), F.avg("cy").alias("y"))


def circumcentre_errors(cell_nodes: DataFrame, nodes: DataFrame, by_radius: bool = False) -> DataFrame:
    """``(cell, error)``: population deviation of the distances from ``polygon_circumcentre`` to a cell's nodes, ``by_radius`` over their mean; 0 for triangles."""
    own = Window.partitionBy("cell")
    each = _corners(cell_nodes, nodes).withColumns({"_x": F.avg("cx").over(own), "_y": F.avg("cy").over(own), "_n": F.count_if("whole").over(own)}).where("_n > 0")
    each = each.select("cell", F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)).alias("_d"))
    error = F.stddev_pop("_d") / F.avg("_d") if by_radius else F.stddev_pop("_d")
    return each.groupBy("cell").agg(F.when(F.count("*") > 3, error).otherwise(0.0).alias("error"))


def edge_clearance(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, both: bool = False, least_area: float = 1e-5) -> DataFrame:
    """``(n1, n2, clearance)``: how far the circumcentres of an edge's cells lie on their own side of the edge's centre, over the root of their areas.

    The smaller of the two, and at the boundary that of the only cell; with ``both`` the mean of the two, null at the boundary.
    Areas count as at least ``least_area``.
    """
    size = cell_geometry(cell_nodes, nodes).select("cell", F.sqrt(F.greatest("area", F.lit(least_area))).alias("size"))
    c = polygon_circumcentre(cell_nodes, nodes).join(shuffled(size), "cell")
    a, b = (c.select(F.col("cell").alias(s), *(F.col(x).alias(f"_{s}_{x}") for x in ("x", "y", "size"))) for s in ("left", "right"))
    e = edge_geometry(edges, nodes).join(shuffled(a), "left", "left").join(shuffled(b), "right", "left")
    own = lambda s, sign: sign * ((F.col(f"_{s}_x") - F.col("ex")) * F.col("nx") + (F.col(f"_{s}_y") - F.col("ey")) * F.col("ny")) / F.col(f"_{s}_size")
    left, right = own("left", -1), own("right", 1)
    return e.select("n1", "n2", ((left + right) / 2 if both else F.least(left, right)).alias("clearance"))
