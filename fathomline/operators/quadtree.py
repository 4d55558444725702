"""Joins in the plane over a quadtree grown from a sample, whose leaves hold about equally many points however they crowd.

A leaf is a task's share: points go to the one leaf that holds them, and what meets them (circles, edges, boxes) to the
leaves that it touches.  The tree is bounded by the sample, so every task can hold it; its size never follows the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import laid_by, saved, shuffled, written

#: Points whose places shape a tree, halvings of each side at most, and points of a leaf.
SAMPLE, LEVELS, LEAF_POINTS = 1 << 17, 24, 4096
#: Sampled points of a leaf at least, so a tree has a few leaves for so many sampled points at most.
LEAST = 8
#: Ids of points in one place that a row holds on average, at most.
TOGETHER = 1024


def _spread(v: np.ndarray) -> np.ndarray:
    """Each bit of a number below 2 ** 32 at twice its place."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


def _gathered(v: np.ndarray) -> np.ndarray:
    """Every second bit of a number, moved together."""
    v = v.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


class Quadtree:
    """Leaves in the order of a Z curve: leaf i holds the codes from ``low[i]`` up to the next, a square of ``side[i]`` at ``xa[i], ya[i]``.

    ``parts[i]`` says how many tasks share leaf i: more than one where points that lie together can't be divided further.
    ``count`` is the number of points that it was grown for.
    """

    def __init__(self, x0: float, y0: float, size: float, low: np.ndarray, level: np.ndarray, parts: np.ndarray, count: int = 0) -> None:
        self.x0, self.y0, self.size, self.low, self.level, self.parts, self.count = x0, y0, size, low, level, parts, count
        self.side = size / np.exp2(level)
        unit = size / 2**LEVELS
        self.xa, self.ya = x0 + _gathered(low) * unit, y0 + _gathered(low >> 1) * unit

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places on the curve; what lies outside counts as at the border."""
        most = 2**LEVELS - 1
        cell = [np.clip(np.floor((np.nan_to_num(v) - at) / self.size * 2**LEVELS), 0, most).astype(np.int64) for v, at in ((x, self.x0), (y, self.y0))]
        return _spread(cell[0]) | (_spread(cell[1]) << 1)

    def leaves(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, self.codes(x, y), "right") - 1

    def touched(self, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, segments: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf) of boxes, or with ``segments`` of lines from a to b, and the leaves that they touch, by descent from the root."""
        lx, hx, ly, hy = np.minimum(xa, xb), np.maximum(xa, xb), np.minimum(ya, yb), np.maximum(ya, yb)
        # what lies outside the tree belongs to its border
        end = 2**LEVELS - 1
        cell = [np.clip(np.floor((v - at) / self.size * 2**LEVELS), 0, end) for v, at in ((lx, self.x0), (hx, self.x0), (ly, self.y0), (hy, self.y0))]
        row, code, found = np.arange(len(xa)), np.zeros(len(xa), np.int64), []
        for level in range(LEVELS + 1):
            at = np.searchsorted(self.low, code)
            at = np.minimum(at, len(self.low) - 1)
            leaf = (self.low[at] == code) & (self.level[at] == level)
            found.append((row[leaf], at[leaf]))
            row, code = row[~leaf], code[~leaf]
            if not len(row):
                break
            width = 1 << (LEVELS - level - 1)
            code = (code[:, None] + np.arange(4)[None, :] * (1 << 2 * (LEVELS - level - 1))).ravel()
            row = np.repeat(row, 4)
            cx, cy = _gathered(code), _gathered(code >> 1)
            near = (cell[0][row] < cx + width) & (cell[1][row] >= cx) & (cell[2][row] < cy + width) & (cell[3][row] >= cy)
            if segments:
                # corners on one side of the line don't touch it; the border leaves take whatever lies beyond them
                unit = self.size / 2**LEVELS
                bx, by = self.x0 + cx * unit, self.y0 + cy * unit
                ex, ey = xb[row] - xa[row], yb[row] - ya[row]
                side = [ex * (by + j * width * unit - ya[row]) - ey * (bx + i * width * unit - xa[row]) for i in (0, 1) for j in (0, 1)]
                slack = (np.abs(ex) + np.abs(ey)) * self.size * 1e-12
                apart = (np.min(side, axis=0) > slack) | (np.max(side, axis=0) < -slack)
                border = (cx == 0) | (cy == 0) | (cx + width > end) | (cy + width > end)
                near &= ~apart | border
            row, code = row[near], code[near]
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])

    def leaf(self, x: Column, y: Column) -> Column:
        """The leaf of a point."""
        return F.arrow_udf(lambda a, b: pa.array(self.leaves(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)).astype(np.int32)), "int")(x, y)

    def part(self, leaf: Column, by: Column) -> Column:
        """Which of the tasks that share the leaf takes a row, by a hash of ``by``."""
        return F.pmod(F.xxhash64(by), self._parts(leaf)).cast("int")

    def all_parts(self, leaf: Column) -> Column:
        return F.sequence(F.lit(0), self._parts(leaf) - 1)

    def _parts(self, leaf: Column) -> Column:
        shared = np.flatnonzero(self.parts > 1)
        if not len(shared):
            return F.lit(1)
        # a leaf is shared only where the tree can't be deeper, and such leaves hold a bounded share of the sample each
        return F.coalesce(F.element_at(F.create_map(*(F.lit(int(v)) for i in shared for v in (i, self.parts[i]))), leaf), F.lit(1))

    def meets(self, rows: DataFrame, xa: Column, ya: Column, xb: Column, yb: Column, segments: bool = False) -> DataFrame:
        """``rows`` with a column ``leaf``, once for each leaf that its box or line touches."""
        find = F.arrow_udf(lambda *v: self._lists(*(x.to_numpy(zero_copy_only=False) for x in v), segments), "array<int>")
        return rows.withColumn("leaf", F.explode(find(*(v.cast("double") for v in (xa, ya, xb, yb)))))

    def _lists(self, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, segments: bool) -> pa.Array:
        row, leaf = self.touched(xa, ya, xb, yb, segments)
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(len(xa) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(leaf[order].astype(np.int32)))

    def frame(self, df: DataFrame) -> DataFrame:
        """``(leaf, xa, ya, side)``."""
        rows = pa.table({"leaf": pa.array(np.arange(len(self.low), dtype=np.int32)), "xa": pa.array(self.xa), "ya": pa.array(self.ya), "side": pa.array(self.side)})
        return df.sparkSession.createDataFrame(rows)


def placed(points: DataFrame) -> DataFrame:
    """Points with two finite coordinates."""
    return points.where("abs(x) < double('infinity') and abs(y) < double('infinity')")


def quadtree(*tables: DataFrame, leaf_points: int = LEAF_POINTS) -> Quadtree:
    """A tree over the points ``(x, y)`` of all tables together, about ``leaf_points`` in a leaf.

    One pass counts and bounds the points; about SAMPLE of them, of each table alike, are counted in the squares of all levels that
    hold them, and a square with more than its share is divided.  Points are sampled, not places, so crowded places
    are seen as such.  The border lies off the points by odd fractions, so squares end where no lattice of points does.
    """
    points = reduce(DataFrame.unionByName, [placed(t).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")) for t in tables])
    r = points.agg(F.count("*").alias("n"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb")).first()
    n = r["n"]
    if not n:
        return Quadtree(0.0, 0.0, 1.0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    span = max(r["xb"] - r["xa"], r["yb"] - r["ya"]) or max(abs(r["xa"]), abs(r["ya"]), 1.0)
    tree = Quadtree(r["xa"] - span * 0.0137, r["ya"] - span * 0.0159, span * 1.0371, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    share = min(1.0, SAMPLE / n)
    most = max(LEAST, leaf_points * share)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.codes(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["code"])

    codes = (points if share == 1 else points.sample(share, 1)).mapInArrow(coded, "code bigint")
    codes = codes.groupBy("code").agg(F.count("*").alias("n"))
    each = codes.select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    square = F.expr(f"shiftleft(shiftright(code, ({LEVELS} - level) * 2), ({LEVELS} - level) * 2)")
    full = each.groupBy("level", square.alias("low")).agg(F.sum("n").alias("n")).where(F.col("n") > most)
    full = full.toArrow()  # at most LEVELS times the sample over LEAST
    level, low, count = (full[c].to_numpy().astype(np.int64) for c in ("level", "low", "n"))
    held = {(a, b) for a, b in zip(level.tolist(), low.tolist(), strict=True) if a < LEVELS}
    leaves = [(0, 0)] if (0, 0) not in held else []
    for a, b in held:
        leaves += [(a + 1, x) for x in (b + k * (1 << 2 * (LEVELS - a - 1)) for k in range(4)) if (a + 1, x) not in held]
    leaves.sort(key=lambda p: p[1])
    deep = {b: c for a, b, c in zip(level.tolist(), low.tolist(), count.tolist(), strict=True) if a == LEVELS}
    parts = [-(-deep[b] // int(most)) if a == LEVELS and b in deep else 1 for a, b in leaves]
    return Quadtree(tree.x0, tree.y0, tree.size, np.array([b for _, b in leaves], np.int64), np.array([a for a, _ in leaves], np.int64), np.array(parts, np.int64), n)


def dealt(points: DataFrame, tree: Quadtree, name: str) -> DataFrame:
    """``points`` with their leaf and the part of it that takes them; those without two finite coordinates are left out."""
    held = placed(points).withColumn("leaf", tree.leaf(F.col("x").cast("double"), F.col("y").cast("double")))
    return held.withColumn("part", tree.part(F.col("leaf"), F.col(name)))


def within(
    left: DataFrame, right: DataFrame, r: float | Column, tree: Quadtree | None = None, lid: str = "pid", rid: str = "qid", keep: tuple[str, ...] = (), digits: int | None = None, together: bool = True
) -> DataFrame:
    """``(lid, rid, *keep, d)`` for pairs at most ``r`` apart, a number or a column of the left side; d rounded to ``digits``.

    Right points lie in one leaf each, left ones go to the leaves that their circle's box touches.  A task so meets about
    ``LEAF_POINTS`` right points however crowded they are, and no pair is met twice.  Points without two finite coordinates are
    near nothing; ids may be null or repeat, then so do pairs.

    Left points of one place and radius meet right points once for all of them, and part when all else is done: pairs grow as the
    square of the points that crowd in a place, the rows that are shuffled and compared don't.  All pairs of a right point with
    a place follow each other, so files of them pack well.  The number of tasks follows the points, not the bytes that the planner
    merges by, which pairs outgrow; a task's right points are few enough that files number them in dictionaries.  Where few points share a
    place and pairs are few, ``together=False`` saves the gathering.
    """
    tree = tree or quadtree(left, right)
    radius = F.lit(float(r)) if not isinstance(r, Column) else r
    a = placed(left).select(F.col(lid).alias("_l"), F.col("x").cast("double").alias("_ax"), F.col("y").cast("double").alias("_ay"), radius.cast("double").alias("_r"))
    a = _ids_by_place(a) if together else a
    a = tree.meets(a, F.col("_ax") - F.col("_r"), F.col("_ay") - F.col("_r"), F.col("_ax") + F.col("_r"), F.col("_ay") + F.col("_r")).withColumn("part", F.explode(tree.all_parts(F.col("leaf"))))
    b = dealt(right, tree, rid).select("leaf", "part", F.col(rid).alias("_q"), F.col("x").cast("double").alias("_bx"), F.col("y").cast("double").alias("_by"), *(F.col(c).alias(f"_k_{c}") for c in keep))
    d = F.sqrt((F.col("_ax") - F.col("_bx")) * (F.col("_ax") - F.col("_bx")) + (F.col("_ay") - F.col("_by")) * (F.col("_ay") - F.col("_by")))
    if together:
        a, b = (laid_by(t, 4 * tree.count, "leaf", "part") for t in (a, b))
    met = a.join(shuffled(b), ["leaf", "part"]).withColumn("_d", d).where("_d <= _r")
    met = met if digits is None else met.withColumn("_d", F.round("_d", digits))
    return met.select((F.explode("_ls") if together else F.col("_l")).alias(lid), F.col("_q").alias(rid), *(F.col(f"_k_{c}").alias(c) for c in keep), F.col("_d").alias("d"))


def _ids_by_place(a: DataFrame) -> DataFrame:
    """``(_ax, _ay, _r, _ls)``: the ids ``_l`` of equal circles in lists of about TOGETHER at most; ids that repeat there do so in as many rows."""
    place = ["_ax", "_ay", "_r"]
    ids = a.groupBy(*place, "_l").agg(F.count("*").alias("_n"))
    crowd = ids.groupBy(*place).count().agg(F.max("count")).first()[0] or 1
    lists = ids.withColumn("_c", F.pmod(F.xxhash64("_l"), F.lit(-(-crowd // TOGETHER)))).groupBy(*place, "_n", "_c", F.isnull("_l").alias("_z")).agg(F.collect_list("_l").alias("_ls"))
    kept = F.when(F.col("_z"), F.array(F.lit(None).cast(ids.schema["_l"].dataType))).otherwise(F.col("_ls"))  # a list leaves nulls out
    return lists.select(*place, kept.alias("_ls"), F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("col")


def nearest(left: DataFrame, right: DataFrame, k: int, lid: str = "pid", rid: str = "qid") -> DataFrame:
    """``(lid, rid, d, rank)``: the k nearest right points of each left point, equal distances by rid.

    Each point starts with a circle in which its leaf's density would place 2 k points; those that find fewer than k double theirs,
    and at last it spans all points.  So dense and sparse regions take a round or two alike.  ``lid`` must be unique; fewer than k
    right points are all ranked, and points without two finite coordinates are left out.
    """
    tree = quadtree(right)
    have = placed(right).limit(k).count()
    crowd = dealt(right, tree, rid).groupBy("leaf").agg(F.count("*").alias("_n"))
    size = tree.frame(right).join(shuffled(crowd), "leaf", "left").select("leaf", F.sqrt(F.lit(2.0 * k) / F.greatest("_n", F.lit(1))).alias("_f"), "side")
    todo = placed(left).withColumn("leaf", tree.leaf(F.col("x").cast("double"), F.col("y").cast("double")))
    # a row for each leaf, bounded by the sample
    out = [F.greatest(F.lit(at) - F.col(c), F.col(c) - (at + tree.size), F.lit(0.0)) for c, at in (("x", tree.x0), ("y", tree.y0))]
    todo = todo.join(F.broadcast(size), "leaf").withColumn("_w", F.col("side") * F.least(F.col("_f"), F.lit(2.0)) + F.sqrt(out[0] * out[0] + out[1] * out[1]))
    todo = saved(todo.select(lid, "x", "y", "_w"))
    best = Window.partitionBy(lid).orderBy("d", rid)
    done = None
    while have:
        got = within(todo, right, F.col("_w"), tree, lid, rid, together=False).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        got = written(got)
        full = got.groupBy(lid).agg(F.count("*").alias("_m")).where(F.col("_m") >= have).select(lid)
        part = got.join(shuffled(full), lid, "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = written(todo.join(shuffled(full), lid, "left_anti").withColumn("_w", F.col("_w") * 2))
        if todo.isEmpty():
            break
    return done if done is not None else within(left, right, -1.0, tree, lid, rid).withColumn("rank", F.lit(1)).where("false")


def ring_edges(rings: DataFrame, poly: str = "poly") -> DataFrame:
    """``(poly, x0, y0, x1, y1)``: the edges of rings ``(poly, pos, x, y)``, the last one closing; a column ``ring`` parts rings of one polygon."""
    keys = [poly, "ring"] if "ring" in rings.columns else [poly]
    w = Window.partitionBy(*keys).orderBy("pos")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rings.select(F.col(poly).alias("poly"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), nxt("x").cast("double").alias("x1"), nxt("y").cast("double").alias("y1"))


def in_polygons(points: DataFrame, edges: DataFrame, pid: str = "pid", tree: Quadtree | None = None) -> DataFrame:
    """``(pid, poly)`` for points inside polygons of closed rings, given as ``edges(poly, x0, y0, x1, y1)`` in any order and sense.

    A point is inside if a ray to the right of it crosses an odd number of edges, each taken without its upper end; so of
    polygons that share an edge one holds a point on it, and holes and islands are just further rings.

    Edges go to the leaves that they touch.  Of each other leaf in a polygon's box one flag says whether it lies inside: the crossings of a ray
    from its lower right corner, found by the dyadic intervals of y that edges cover and corners lie in, so that a corner meets
    only edges that its ray's line crosses.  A point in a leaf without edges takes the leaf's flag.  In the
    others it meets the leaf's own edges: those right of it, and those that part the corner from the end of its ray at the leaf's right side.
    Edges shape the tree together with the points, so neither a crowd of points nor a polygon of very many edges fills a task.
    """
    edges = edges.select("poly", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x0 <> x1 or y0 <> y1")
    tree = tree or quadtree(points, edges.select(F.col("x0").alias("x"), F.col("y0").alias("y")))
    pieces = saved(tree.meets(edges, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), segments=True))
    box = edges.groupBy("poly").agg(F.min(F.least("x0", "x1")).alias("xa"), F.min(F.least("y0", "y1")).alias("ya"), F.max(F.greatest("x0", "x1")).alias("xb"), F.max(F.greatest("y0", "y1")).alias("yb"))
    spans = tree.meets(box, F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")).select("poly", "leaf", F.struct("xa", "ya", "xb", "yb").alias("box"))
    frame = F.broadcast(tree.frame(points))  # bounded by the sample
    corner = spans.join(shuffled(frame), "leaf").select("poly", "leaf", "box", (F.col("xa") + F.col("side")).alias("cx"), F.col("ya").alias("cy"))

    # An edge covers the levels' intervals of y that make up its own from lower to upper end; a corner lies in one of each level.
    unit = tree.size / 2**LEVELS
    row = lambda c: F.floor((c - tree.y0) / unit)
    lower, upper = F.least("y0", "y1"), F.greatest("y0", "y1")
    covers = F.arrow_udf(lambda a, b: _dyadic(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)), "array<struct<level: int, at: bigint>>")
    far = edges.where("y0 <> y1").withColumn("_i", F.explode(covers(row(lower), row(upper)))).select("poly", "x0", "y0", "x1", "y1", F.col("_i.level").alias("level"), F.col("_i.at").alias("at"))
    own = corner.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("at", F.floor(row(F.col("cy")) / F.pow(F.lit(2.0), F.col("level"))))
    cross = lambda y: (F.col("y0") <= y) != (F.col("y1") <= y)
    x_at = lambda y: F.col("x0") + F.try_divide((y - F.col("y0")) * (F.col("x1") - F.col("x0")), F.col("y1") - F.col("y0"))
    right = F.when(cross(F.col("cy")) & (x_at(F.col("cy")) > F.col("cx")), 1).otherwise(0)
    flags = own.join(shuffled(far), ["poly", "level", "at"]).groupBy("poly", "leaf").agg((F.sum(right) % 2).alias("flag"))
    flags = saved(corner.join(shuffled(flags), ["poly", "leaf"], "left").select("poly", "leaf", "box", "cx", "cy", F.coalesce("flag", F.lit(0)).alias("flag")))

    held = dealt(points, tree, pid).select("leaf", "part", F.col(pid).alias("_p"), F.monotonically_increasing_id().alias("_row"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    held = saved(held)
    touched = pieces.select("poly", "leaf").distinct()
    whole = flags.join(shuffled(touched), ["poly", "leaf"], "left_anti").where("flag = 1").select("poly", "leaf").withColumn("part", F.explode(tree.all_parts(F.col("leaf"))))
    inside = held.join(shuffled(whole), ["leaf", "part"]).select(F.col("_p").alias(pid), "poly")
    cut = pieces.join(shuffled(flags), ["poly", "leaf"]).withColumn("part", F.explode(tree.all_parts(F.col("leaf"))))
    px, py = F.col("px"), F.col("py")
    hit = F.when(cross(py) & (x_at(py) > px) & (x_at(py) <= F.col("cx")), 1).otherwise(0)
    y_at = F.col("y0") + F.try_divide((F.col("cx") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("x1") - F.col("x0"))
    parts = F.when(((F.col("x0") <= F.col("cx")) != (F.col("x1") <= F.col("cx"))) & (y_at > F.col("cy")) & (y_at <= py), 1).otherwise(0)
    # only polygons whose box holds a point are counted for it, else each point of a leaf would take a group for every polygon there
    met = held.join(shuffled(cut), ["leaf", "part"]).where(px.between(F.col("box.xa"), F.col("box.xb")) & py.between(F.col("box.ya"), F.col("box.yb")))
    counted = met.groupBy("_row", "_p", "poly").agg((F.first("flag") + F.sum(hit + parts)).alias("_n"))
    return inside.unionByName(counted.where("_n % 2 = 1").select(F.col("_p").alias(pid), "poly"))


def _dyadic(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """For whole numbers a <= b, as far as they are places of the tree, the intervals [at 2^level, (at + 1) 2^level) that make up a to b, b among them."""
    lo, hi = (np.clip(v, 0, 2**LEVELS - 1).astype(np.int64) for v in (a, b))
    hi += 1
    live, found = np.arange(len(lo)), []
    for level in range(LEVELS + 1):
        odd = live[lo[live] & 1 == 1]
        found.append((odd, level, lo[odd]))
        lo[odd] += 1
        live = live[lo[live] < hi[live]]
        odd = live[hi[live] & 1 == 1]
        hi[odd] -= 1
        found.append((odd, level, hi[odd]))
        live = live[lo[live] < hi[live]]
        lo[live] >>= 1
        hi[live] >>= 1
    row = np.concatenate([r for r, _, _ in found])
    level = np.concatenate([np.full(len(r), v, np.int32) for r, v, _ in found])
    at = np.concatenate([v for _, _, v in found])
    order = np.argsort(row, kind="stable")
    cut = np.searchsorted(row[order], np.arange(len(lo) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(level[order]), pa.array(at[order])], ["level", "at"]))
