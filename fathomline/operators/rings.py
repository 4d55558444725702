"""Faces, ordered rings, nested polygons and contours: the next half-edge at each node, and positions by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.quadtree import in_polygons
from fathomline.session import laid_by, shuffled, written

#: Doublings at most: a chain of 2 ** ROUNDS links.
ROUNDS = 40


def ranked(links: DataFrame) -> DataFrame:
    """``(h, ring, pos, closed)`` of ``links(h, nxt)``: chains and cycles, named by their first link, with positions from 0.

    Every h has one row, ``nxt`` is null at the end of a chain, and no two rows have the same ``nxt``.  A cycle starts at its
    smallest h.  Each round joins every link with that which its pointer leads to and doubles the pointer; each round is written to
    the shared folder.  A link leaves the rounds once it knows its cycle, so a cycle of n links takes part in log n rounds
    whatever the longest needs; chains then take log n rounds back to their start.
    """
    first = written(links.select("h", F.col("nxt").alias("p"), F.col("h").alias("least"), F.lit(0).cast("long").alias("off"), F.lit(False).alias("done")))
    state, cycles, ended = first, [], first.where("p is null")
    for k in range(ROUNDS):
        open_ = state.where("not done and p is not null")
        rows = open_.count()
        if not rows:
            break
        # links of a cycle find out in two rounds that follow, so those that left in the last one are still met
        met = (state if k == 0 else state.unionByName(ended)).select(F.col("h").alias("_h"), F.col("p").alias("_p"), F.col("least").alias("_least"), F.col("off").alias("_off"))
        to = laid_by(open_, rows, "p").join(shuffled(laid_by(met, rows, "_h")), F.col("p") == F.col("_h"))
        # the links that this one and its pointer cover are as many and follow each other: a least one that both have is met again
        off = F.when(F.col("_least") < F.col("least"), F.col("_off") + (1 << k)).otherwise(F.col("off"))
        moved = written(to.select("h", F.col("_p").alias("p"), F.least("least", "_least").alias("least"), off.alias("off"), (F.col("least") == F.col("_least")).alias("done")))
        if k > 0:
            ended = ended.unionByName(state.where("not done and p is null"))
        state = moved
        cycles.append(moved.where("done").select("h", F.col("least").alias("ring"), "off"))
    else:
        raise RuntimeError(f"a chain has more than 2 ** {ROUNDS} links")
    if state is not first:
        ended = ended.unionByName(state.where("not done and p is null"))
    found = [_chains(first, ended)]
    if cycles:
        held = reduce(DataFrame.unionByName, cycles)
        size = held.groupBy("ring").agg((F.max("off") + 1).alias("_n"))
        found.append(held.join(shuffled(size), "ring").select("h", "ring", ((F.col("_n") - F.col("off")) % F.col("_n")).alias("pos"), F.lit(True).alias("closed")))
    return reduce(DataFrame.unionByName, found)


def _chains(links: DataFrame, held: DataFrame) -> DataFrame:
    """``(h, ring, pos, closed)`` of the links ``(h, p)`` that are ``held(h)``, all in chains: pointers back double until the start."""
    back = links.where("p is not null").select(F.col("p").alias("_to"), F.col("h").alias("_from"))
    state = held.select("h").join(shuffled(back), F.col("h") == F.col("_to"), "left")
    state = written(state.select("h", F.col("_from").alias("p"), F.when(F.col("_from").isNotNull(), 1).otherwise(0).cast("long").alias("pos"), F.coalesce("_from", "h").alias("ring")))
    for _ in range(ROUNDS):
        if state.where("p is not null").isEmpty():
            return state.select("h", "ring", "pos", F.lit(False).alias("closed"))
        seen = state.select(F.col("h").alias("_h"), F.col("p").alias("_p"), F.col("pos").alias("_pos"), F.col("ring").alias("_ring"))
        # what has come to its start only waits to be met
        on = state.join(shuffled(seen), F.col("p") == F.col("_h")).select("h", F.col("_p").alias("p"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_ring").alias("ring"))
        state = written(on.unionByName(state.where("p is null").select("h", "p", "pos", "ring")))
    raise RuntimeError(f"a chain has more than 2 ** {ROUNDS} links")


def _links(half: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(h, nxt)`` of directed edges ``(a, b)``: at b the first edge that leaves it, clockwise from the way back to a.

    So a face, or the domain, stays at the left.  A node's edges are put in order by one window; nodes of a mesh have few.
    """
    at = lambda n: nodes.select(F.col("node").alias(n), F.col("x").alias(f"_{n}x"), F.col("y").alias(f"_{n}y"))
    e = half.join(shuffled(at("a")), "a").join(shuffled(at("b")), "b")
    turn = lambda i, j: F.atan2(F.col(f"_{j}y") - F.col(f"_{i}y"), F.col(f"_{j}x") - F.col(f"_{i}x"))
    leaves = e.select(F.col("a").alias("node"), turn("a", "b").alias("angle"), F.lit(1).alias("kind"), F.col("b").alias("other"))
    comes = e.select(F.col("b").alias("node"), turn("b", "a").alias("angle"), F.lit(0).alias("kind"), F.col("a").alias("other"))
    # an edge back the same way sorts after the arrival, so it is taken last of all
    w = Window.partitionBy("node").orderBy("angle", "kind", "other")
    out = F.when(F.col("kind") == 1, F.col("other"))
    before = F.last(out, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.last(out, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = leaves.unionByName(comes).withColumn("to", F.coalesce(before, last)).where("kind = 0")
    nxt = F.when(F.col("to").isNotNull(), F.struct(F.col("node").alias("a"), F.col("to").alias("b")))
    return met.select(F.struct(F.col("other").alias("a"), F.col("node").alias("b")).alias("h"), nxt.alias("nxt"))


def signed_areas(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ring, n, area)`` of ``rings(ring, pos, node)``: positive counter-clockwise; seen from each ring's first node, so large coordinates don't cancel."""
    at = rings.join(shuffled(nodes.select("node", F.col("x").alias("_x"), F.col("y").alias("_y"))), "node")
    first = at.where("pos = 0").select("ring", F.col("_x").alias("_x0"), F.col("_y").alias("_y0"))
    size = rings.groupBy("ring").agg(F.count("*").alias("_n"))
    nxt = at.select("ring", F.col("pos").alias("_pos"), (F.col("_x")).alias("_u"), F.col("_y").alias("_v"))
    pair = at.join(shuffled(size), "ring").join(shuffled(first), "ring").withColumn("_pos", (F.col("pos") + 1) % F.col("_n")).join(shuffled(nxt), ["ring", "_pos"])
    x, y, u, v = F.col("_x") - F.col("_x0"), F.col("_y") - F.col("_y0"), F.col("_u") - F.col("_x0"), F.col("_v") - F.col("_y0")
    return pair.groupBy("ring").agg(F.count("*").alias("n"), (F.sum(x * v - u * y) / 2).alias("area"))


def face_rings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ring, pos, node)``: all faces of the plane graph of ``edges(n1, n2)``, each at the left of its half-edges.

    A ring is named by its smallest half-edge, a struct of its nodes, and starts there.  Edges with a null end, loops and repeats are
    left out.  The outside of each connected part is a ring too, clockwise.
    """
    one = edges.where("n1 is not null and n2 is not null and n1 <> n2").select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()
    half = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return ranked(_links(half, nodes)).select("ring", "pos", F.col("h.a").alias("node"))


def cells_from_edges(edges: DataFrame, nodes: DataFrame, max_sides: int | None = None) -> DataFrame:
    """``(cell, pos, node)``: the counter-clockwise faces of a plane graph with at most ``max_sides`` sides, or all of them.

    A cell is named by its smallest half-edge and starts there.  A face that is reached from both sides of an edge, as
    a dead end is, keeps that edge twice.
    """
    rings = written(face_rings(edges, nodes))
    held = signed_areas(rings, nodes).where(F.col("area") > 0)
    held = held.where(F.col("n") <= max_sides) if max_sides is not None else held
    return rings.join(shuffled(held.select("ring")), "ring", "left_semi").select(F.col("ring").alias("cell"), "pos", "node")


def outer_boundary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(pos, node)``: the outermost boundary of a graph, counter-clockwise from its smallest half-edge's end: the ring of the largest negative area, reversed."""
    rings = written(face_rings(edges, nodes))
    best = signed_areas(rings, nodes).where("area < 0").orderBy("area", "ring").limit(1)
    own = rings.join(F.broadcast(best.select("ring", "n")), "ring")
    return own.select((F.col("n") - 1 - F.col("pos")).alias("pos"), "node")


def ordered_boundaries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ring, pos, node, area)`` of ``edges(n1, n2, left, right)``: boundary rings with the cells at their left, in order.

    Outer rings so are counter-clockwise with positive area, and the rings of holes clockwise.  ``left`` is the cell at the left on the
    way from n1 to n2.  Where a mesh touches itself in a node, rings part there, so each encloses cells that share edges.
    """
    rim = edges.where(F.col("left").isNull() != F.col("right").isNull())
    here = F.col("left").isNotNull()
    half = rim.select(F.when(here, F.col("n1")).otherwise(F.col("n2")).alias("a"), F.when(here, F.col("n2")).otherwise(F.col("n1")).alias("b"))
    rings = written(ranked(_links(half, nodes)).select("ring", "pos", F.col("h.a").alias("node")))
    return rings.join(signed_areas(rings, nodes).select("ring", "area"), "ring")


def nested(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ring, depth, outer)`` of closed rings ``(ring, pos, node)`` that don't cross: how many rings hold each, and for those of odd depth, holes, the ring that they are cut from.

    Rings inside a hole are outer rings again.  The middle of a ring's first edge stands for it, so rings may touch in nodes.
    """
    at = rings.join(nodes.select("node", "x", "y"), "node")
    size = rings.groupBy("ring").agg(F.count("*").alias("n"))
    nxt = at.select("ring", F.col("pos").alias("_pos"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    edge = written(at.join(size, "ring").withColumn("_pos", (F.col("pos") + 1) % F.col("n")).join(nxt, ["ring", "_pos"]).select(F.col("ring").alias("poly"), "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1"))
    middle = edge.where("pos = 0").select(F.col("poly").alias("pid"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    holds = in_polygons(middle, edge).where("pid <> poly").select(F.col("pid").alias("ring"), "poly")
    size = signed_areas(rings, nodes).select(F.col("ring").alias("poly"), F.abs("area").alias("size"))
    found = holds.join(size, "poly").groupBy("ring").agg(F.count("*").alias("depth"), F.min(F.struct("size", "poly"))["poly"].alias("within"))
    out = middle.select(F.col("pid").alias("ring")).join(found, "ring", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return out.select("ring", "depth", F.when(F.col("depth") % 2 == 1, F.col("within")).alias("outer"))


def lines_to_polygons(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ring, pos, x, y)`` and ``(ring, depth, outer)`` of closed lines made of ``segments(x1, y1, x2, y2)`` in any order and sense.

    Rings run around the faces that the lines enclose, which are those with positive area; lines that end nowhere enclose nothing.
    """
    point = lambda k: F.struct(F.col(f"x{k}").cast("double").alias("x"), F.col(f"y{k}").cast("double").alias("y"))
    e = segments.select(point(1).alias("n1"), point(2).alias("n2")).where("n1.x is not null and n1.y is not null and n2.x is not null and n2.y is not null")
    nodes = written(e.select(F.col("n1").alias("node")).union(e.select("n2")).distinct().select("node", "node.x", "node.y"))
    rings = written(cells_from_edges(e, nodes).select(F.col("cell").alias("ring"), "pos", "node"))
    return rings.select("ring", "pos", "node.x", "node.y"), nested(rings, nodes)


def contours(grid: DataFrame, level: float) -> DataFrame:
    """``(line, pos, closed, x, y)`` where a raster ``(row, col, value)`` crosses ``level``, higher values at the left; x by col, y by row.

    Each square between four cells with values has a segment for each way in and out.  A crossing lies between two neighbours, one at
    least ``level`` and one below, and is the end of one segment and the start of the next, so segments need no search to
    be joined and each crossing is one point of one line.  In a saddle, the mean of the four decides: where it is at least ``level`` the
    higher corners are joined.  Lines end at the border and at cells without a value; a line is named by its first crossing.
    """
    v = grid.where(F.col("value").isNotNull() & ~F.isnan("value")).select("row", "col", F.col("value").cast("double").alias("value"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    corner = v.select((F.col("row")).alias("_r"), F.col("col").alias("_c"), "value", near.alias("k"))
    # a cell is the corner (i, j) of the square at (row - i, col - j)
    square = corner.groupBy((F.col("_r") - F.col("k.i")).cast("long").alias("row"), (F.col("_c") - F.col("k.j")).cast("long").alias("col")).agg(
        *(F.max(F.when((F.col("k.i") == i) & (F.col("k.j") == j), F.col("value"))).alias(f"v{i}{j}") for i in (0, 1) for j in (0, 1)), F.count("*").alias("n")
    )
    square = square.where("n = 4").where((F.greatest("v00", "v01", "v10", "v11") >= level) & (F.least("v00", "v01", "v10", "v11") < level))
    up = lambda c: F.col(c) >= level
    # sides counter-clockwise: along the row below, right column, row above, left column; kind 0 runs along a row, 1 along a column
    side = {
        "s": (0, F.col("row"), F.col("col"), "v00", "v01"), "e": (1, F.col("row"), F.col("col") + 1, "v01", "v11"),
        "n": (0, F.col("row") + 1, F.col("col"), "v10", "v11"), "w": (1, F.col("row"), F.col("col"), "v00", "v10"),
    }

    def crossing(s: str) -> Column:
        kind, row, col, a, b = side[s]
        share = (F.lit(float(level)) - F.col(a)) / (F.col(b) - F.col(a))
        return F.struct(
            F.struct(F.lit(kind).alias("kind"), row.alias("row"), col.alias("col")).alias("h"),
            (col + (share if kind == 0 else 0.0)).cast("double").alias("x"), (row + (share if kind == 1 else 0.0)).cast("double").alias("y"),
        )

    # around the square, low to high on the way counter-clockwise is where a line with the high side at its left leaves
    around = [("s", "v00", "v01"), ("e", "v01", "v11"), ("n", "v11", "v10"), ("w", "v10", "v00")]
    enters = {s: up(a) & ~up(b) for s, a, b in around}
    leaves = {s: ~up(a) & up(b) for s, a, b in around}
    saddle = F.size(F.filter(F.array(*(F.when(c, F.lit(1)) for c in enters.values())), lambda x: x.isNotNull())) == 2
    joined = (F.col("v00") + F.col("v01") + F.col("v10") + F.col("v11")) / 4 >= level
    order = ["s", "e", "n", "w"]

    def segment(s: str) -> Column:
        """From side s: in a saddle to the next side if the high corners are joined, to the one before if they are apart, else to the only way out."""
        after, ago = order[(order.index(s) + 1) % 4], order[(order.index(s) - 1) % 4]
        only = F.coalesce(*(F.when(leaves[t], crossing(t)) for t in order))
        to = F.when(saddle & joined, crossing(after)).when(saddle, crossing(ago)).otherwise(only)
        return F.when(enters[s], F.struct(crossing(s).alias("a"), to.alias("b")))

    parts = written(square.select(F.explode(F.array_compact(F.array(*(segment(s) for s in order)))).alias("p")).select("p.a", "p.b"))
    spots = parts.select(F.col("a.h").alias("h"), F.col("a.x").alias("x"), F.col("a.y").alias("y")).unionByName(parts.select(F.col("b.h").alias("h"), F.col("b.x").alias("x"), F.col("b.y").alias("y")))
    spots = spots.groupBy("h").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    to = parts.select(F.col("a.h").alias("_h"), F.col("b.h").alias("nxt"))
    found = ranked(spots.join(to, F.col("h") == F.col("_h"), "left").select("h", "nxt"))
    return found.join(spots, "h").select(F.col("ring").alias("line"), "pos", "closed", "x", "y", "h")
