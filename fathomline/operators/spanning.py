"""Minimum spanning forests in Borůvka rounds, and bottlenecks: the least level at which two nodes are joined."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.mesh import cell_neighbours
from fathomline.operators.quadtree import in_polygons, ring_edges
from fathomline.session import shuffled, written


#: Raster points of two neighbouring cells that one task may join, and of the pairs of cells that it takes together.
PAIR_POINTS, TASK_POINTS = 1 << 12, 1 << 16


def _numbered(edges: DataFrame) -> DataFrame:
    """``(k, a, b, w)``, a < b: the edges without nulls, loops and repeats, ``k`` unique and rising with weight, then nodes.

    One number stands for an edge in all rounds, so they compare, group and shuffle nothing wider.
    """
    e = edges.where("a is not null and b is not null and w is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    e = e.groupBy("a", "b").agg(F.min("w").alias("w")).repartitionByRange("w", "a", "b").sortWithinPartitions("w", "a", "b")
    return written(e.select(F.monotonically_increasing_id().alias("k"), "a", "b", "w"))


def _merged(open_: DataFrame) -> DataFrame:
    """``(comp, k, into)``: each component's least edge and the component that it becomes part of.

    Edges are in one order for all, so the chosen ones form trees in which two components choose the same edge once; of the
    two the smaller is the root, found by doubling pointers.
    """
    both = open_.select(F.col("ca").alias("comp"), F.col("cb").alias("to"), "k").unionByName(open_.select(F.col("cb").alias("comp"), F.col("ca").alias("to"), "k"))
    best = written(both.groupBy("comp").agg(F.min("k").alias("k"), F.min_by("to", "k").alias("to")))
    back = best.select(F.col("comp").alias("to"), F.col("k").alias("_back"))
    root = (F.col("_back") == F.col("k")) & (F.col("comp") < F.col("to"))
    state = written(best.join(shuffled(back), "to").select("comp", "k", F.when(root, F.col("comp")).otherwise(F.col("to")).alias("into")))
    while True:
        on = state.select(F.col("comp").alias("into"), F.col("into").alias("_on"))
        moved = written(state.join(shuffled(on), "into").select("comp", "k", F.col("_on").alias("into"), (F.col("_on") != F.col("into")).alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def _rounds(numbered: DataFrame, rounds: int = 64):
    """Each round's ``(comp, k, into)``, until no edge joins two components; components without an edge have no row."""
    e = numbered.select("k", F.col("a").alias("ca"), F.col("b").alias("cb"))
    for _ in range(rounds):
        if e.isEmpty():
            return
        step = _merged(e)
        yield step
        names = [step.select(F.col("comp").alias(f"c{c}"), F.col("into").alias(f"_{c}")) for c in "ab"]
        e = e.join(shuffled(names[0]), "ca").join(shuffled(names[1]), "cb").where("_a <> _b")
        # of the edges between two components only the least can be in the forest
        e = written(e.groupBy(F.least("_a", "_b").alias("ca"), F.greatest("_a", "_b").alias("cb")).agg(F.min("k").alias("k")))
    raise RuntimeError(f"edges are left after {rounds} rounds")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``(a, b, w)``, a < b: the edges ``(a, b, w)``, in either direction, of the minimum spanning forest; of equal weights those of smaller nodes.

    Edges with nulls and loops are left out, of repeated ones the least counts.  Each round every component takes its least edge, so at
    least half of them vanish, and edges within a component and all but the least between two are dropped.
    """
    numbered = _numbered(edges)
    found = reduce(DataFrame.unionByName, [step.select("k") for step in _rounds(numbered)], numbered.select("k").where("false"))
    return numbered.join(shuffled(found), "k", "left_semi").select("a", "b", "w")


def bottlenecks(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(u, v, w)`` for each distinct pair: the least possible largest weight on a way from u to v along ``edges(a, b, w)``.

    Null where no way leads, and for a node and itself.  The largest edge between two nodes of the spanning forest is the
    largest that their components chose before they became one, so a pair follows its two components through the rounds, of
    which there are log n, and never walks a path.
    """
    numbered = _numbered(edges)
    none = F.lit(None).cast("bigint").alias("k")
    asked = pairs.select("u", "v").where("u is not null and v is not null").distinct()
    todo = written(asked.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), none))
    done = todo.where("cu = cv").select("u", "v", "k")
    todo = todo.where("cu <> cv")
    for step in _rounds(numbered):
        side = lambda c: step.select(F.col("comp").alias(f"c{c}"), F.col("k").alias(f"_k{c}"), F.col("into").alias(f"_{c}"))  # noqa: E731, B023
        on = todo.join(shuffled(side("u")), "cu", "left").join(shuffled(side("v")), "cv", "left")
        todo = written(on.select("u", "v", F.coalesce("_u", "cu").alias("cu"), F.coalesce("_v", "cv").alias("cv"), F.greatest("k", "_ku", "_kv").alias("k")))
        done = done.unionByName(todo.where("cu = cv").select("u", "v", "k"))
        todo = todo.where("cu <> cv")
    done = done.unionByName(todo.select("u", "v", none))
    return done.join(shuffled(numbered.select("k", "w")), "k", "left").select("u", "v", "w")


def connection_levels(edges: DataFrame, cell_nodes: DataFrame, nodes: DataFrame, grid: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``(n1, n2, level)`` for each edge between two cells: the lowest level at which their lowest raster points are joined within both cells.

    Raster points ``(row, col, value)`` at ``x0 + col * dx, y0 + row * dy`` belong to the cells that hold them and are joined with their
    four neighbours.  Of equally low points the first by row and column counts.  Exact, where a search by halves stops at
    some accuracy.  Null where a cell holds no point with a value or where no way leads within the two.

    Two cells are all that a level depends on, so tasks take many pairs at once, about TASK_POINTS points; pairs of more than
    PAIR_POINTS go through ``bottlenecks``, so no cell needs to fit a task.
    """
    pid = F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    at = grid.where(F.col("value").isNotNull() & ~F.isnan("value")).select(pid.alias("pid"), (F.lit(x0) + F.col("col") * dx).alias("x"), (F.lit(y0) + F.col("row") * dy).alias("y"))
    rings = cell_nodes.join(shuffled(nodes.select("node", "x", "y")), "node").select(F.col("cell").alias("poly"), "pos", "x", "y")
    held = written(in_polygons(at, ring_edges(rings)).select(F.col("poly").alias("cell"), "pid.row", "pid.col", "pid.value"))
    many = held.groupBy("cell").agg(F.count("*").alias("n"))
    inner = edges.where("left is not null and right is not null").select("n1", "n2", "left", "right")
    for c in ("left", "right"):
        inner = inner.join(shuffled(many.select(F.col("cell").alias(c), F.col("n").alias(f"_{c}"))), c, "left")
    inner = written(inner.select(F.monotonically_increasing_id().alias("e"), "n1", "n2", "left", "right", (F.col("_left") + F.col("_right")).alias("size")))

    def points(pairs: DataFrame) -> DataFrame:
        """``(e, row, col, value, one, two)``: the points of both cells, one or two being true for those of the left or right; a point may have several rows."""
        cell = F.array(F.struct(F.col("left").alias("cell"), F.lit(True).alias("one")), F.struct(F.col("right").alias("cell"), F.lit(False).alias("one")))
        return pairs.select("e", F.explode(cell).alias("c")).select("e", "c.*").join(shuffled(held), "cell").select("e", "row", "col", "value", "one", (~F.col("one")).alias("two"))

    small = inner.where(F.col("size") <= PAIR_POINTS)
    sizes = inner.agg(F.sum(F.when(F.col("size") <= PAIR_POINTS, F.col("size"))).alias("all"), F.max("size").alias("most")).first()
    buckets = -(-(sizes["all"] or 1) // TASK_POINTS)
    found = points(small).groupBy(F.pmod(F.xxhash64("e"), F.lit(buckets)).alias("bucket")).applyInArrow(_pair_levels, "e bigint, level double")
    if (sizes["most"] or 0) > PAIR_POINTS:
        found = found.unionByName(_large_levels(points(inner.where(F.col("size") > PAIR_POINTS))))
    return inner.join(shuffled(found), "e", "left").select("n1", "n2", "level")


def _pair_levels(points: pa.Table) -> pa.Table:
    """``(e, level)`` of whole pairs' points: from the first cell's lowest point, each point takes the lower of its levels until none changes."""
    e, row, col, value, one, two = (points[c].to_numpy() for c in ("e", "row", "col", "value", "one", "two"))
    order = np.lexsort((col, row, e))
    e, row, col = e[order], row[order], col[order]
    start = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])])
    e, row, col = e[start], row[start], col[start]
    value = np.minimum.reduceat(value[order], start)
    one, two = (np.logical_or.reduceat(v[order], start) for v in (one, two))
    heights, height = np.unique(value, return_inverse=True)
    across = np.flatnonzero((e[1:] == e[:-1]) & (row[1:] == row[:-1]) & (col[1:] == col[:-1] + 1))
    turned = np.lexsort((row, col, e))
    down = np.flatnonzero((e[turned][1:] == e[turned][:-1]) & (col[turned][1:] == col[turned][:-1]) & (row[turned][1:] == row[turned][:-1] + 1))
    links = [(across, across + 1), (turned[down], turned[down + 1])]
    links += [(b, a) for a, b in links]
    low = np.lexsort((height, e))  # stable, so equally low points are in order of row and column
    (_, first), (pair, second) = (np.unique(e[low[v[low]]], return_index=True) for v in (one, two))
    first, second = low[one[low]][first], low[two[low]][second]
    level = np.full(len(e), len(heights))
    level[first] = height[first]
    while True:
        before = level.sum()
        for a, b in links:  # no point is twice on one side of a direction's links
            level[b] = np.minimum(level[b], np.maximum(level[a], height[b]))
        if level.sum() == before:
            break
    reached = level[second] < len(heights)
    return pa.table({"e": pa.array(pair), "level": pa.array(heights[np.where(reached, level[second], 0)], mask=~reached)})


def _large_levels(points: DataFrame) -> DataFrame:
    """``(e, level)`` as by ``_pair_levels``, of pairs of any size."""
    points = points.groupBy("e", "row", "col").agg(F.min("value").alias("value"), F.max("one").alias("one"), F.max("two").alias("two"))
    points = written(points.select(F.monotonically_increasing_id().alias("p"), "*"))
    to = points.select("e", F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("p").alias("b"), F.col("value").alias("_value"))
    step = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(0).alias("j"))))
    by = points.withColumn("s", step).select("e", F.col("p").alias("a"), "value", (F.col("row") + F.col("s.i")).alias("_row"), (F.col("col") + F.col("s.j")).alias("_col"))
    links = by.join(shuffled(to), ["e", "_row", "_col"]).select("a", "b", F.greatest("value", "_value").alias("w"))
    lowest = lambda of: F.min(F.when(F.col(of), F.struct("value", "row", "col", "p")))
    ends = written(points.groupBy("e").agg(lowest("one").alias("u"), lowest("two").alias("v")).select("e", F.col("u.p").alias("u"), F.col("v.p").alias("v"), F.col("u.value").alias("own")))
    found = bottlenecks(links, ends)
    return ends.join(shuffled(found), ["u", "v"], "left").select("e", F.when(F.col("u") == F.col("v"), F.col("own")).otherwise(F.col("w")).alias("level"))


def neighbour_levels(edges: DataFrame, level: DataFrame) -> DataFrame:
    """``(a, b, w)``: neighbouring cells and the higher of their levels ``(cell, value)``, as edges for ``bottlenecks``."""
    a, b = (level.select(F.col("cell").alias(n), F.col("value").alias(f"_{n}")) for n in ("a", "b"))
    pair = cell_neighbours(edges).where("cell < other").select(F.col("cell").alias("a"), F.col("other").alias("b"))
    return pair.join(a, "a").join(b, "b").select("a", "b", F.greatest("_a", "_b").alias("w"))
