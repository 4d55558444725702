"""Rasters as rows of (row, col, value), optionally with keys of tiles or times before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathomline.session import dealt_by, saved

#: Cells along the side of a tile.
TILE = 64


def downsample(grid: DataFrame, n: int) -> DataFrame:
    """Means over blocks of n by n cells that have values."""
    return grid.groupBy(F.floor(F.col("row") / n).alias("row"), F.floor(F.col("col") / n).alias("col")).agg(F.avg("value").alias("value"))


def gradient(grid: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``(row, col, gx, gy)``: central differences between neighbours, one-sided at edges and holes."""

    def along(by: str, over: str, step: float):
        w = Window.partitionBy(by).orderBy(over)
        up = F.when(F.lead(over).over(w) == F.col(over) + 1, F.lead("value").over(w))
        down = F.when(F.lag(over).over(w) == F.col(over) - 1, F.lag("value").over(w))
        return F.coalesce((up - down) / (2 * step), (up - F.col("value")) / step, (F.col("value") - down) / step)

    return grid.select("row", "col", along("row", "col", dx).alias("gx"), along("col", "row", dy).alias("gy"))


def hillshade(grid: DataFrame, azimuth: float = 225.0, zenith: float = 45.0, factor: float = 10.0) -> DataFrame:
    """``(row, col, shade)``: cosine of the angle between the slope, made ``factor`` times steeper, and light from ``azimuth``; negative in the shade."""
    g = gradient(grid)
    slope = F.atan(factor * F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(F.col("gy"), -F.col("gx"))
    z, a = F.radians(F.lit(zenith)), F.radians(F.lit(azimuth))
    return g.select("row", "col", (F.cos(z) * F.cos(slope) + F.sin(z) * F.sin(slope) * F.cos(a - aspect)).alias("shade"))


def _tiled(grid: DataFrame, reach: int) -> DataFrame:
    """``grid`` with ``_t``, the tile of a cell and each other one that a cell at most ``reach`` away lies in, dealt by tile.

    So cells meet their neighbours within a task, and only those along a tile's sides are sent twice.  ``home`` marks a cell's own tile.
    """
    tile = lambda r, c: F.struct(F.floor(r / TILE).alias("r"), F.floor(c / TILE).alias("c"))
    steps = (-reach, 0, reach)
    near = F.array_distinct(F.array(*(tile(F.col("row") + i, F.col("col") + j) for i in steps for j in steps)))
    each = grid.select("row", "col", "value", tile(F.col("row"), F.col("col")).alias("_own"), F.explode(near).alias("_t"))
    return dealt_by(each.select("row", "col", "value", "_t", F.col("_own").eqNullSafe(F.col("_t")).alias("home")), "_t")


def _in_columns(grid: DataFrame, reach: int, columns: list[int]) -> tuple[DataFrame, WindowSpec, Column]:
    """``grid`` in tiles, each cell in every column ``_c`` that sees it ``j`` of ``columns`` further on; the window over such a column by row; and whether a row is the cell itself."""
    each = _tiled(grid, reach).select("*", F.explode(F.array(*map(F.lit, columns))).alias("j")).withColumn("_c", F.col("col") - F.col("j"))
    return each, Window.partitionBy("_t", "_c").orderBy("row"), F.col("home") & (F.col("j") == 0)


def _means_around(grid: DataFrame) -> DataFrame:
    """``(row, col, value, _mean)``: each cell and the mean of the values in its 3 by 3 cells."""
    each, w, own = _in_columns(grid, 1, [-1, 0, 1])
    w = w.rangeBetween(-1, 1)
    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    found = each.withColumn("_mean", F.when(placed, F.try_divide(F.sum("value").over(w), F.count("value").over(w))))
    return found.where(own).select("row", "col", "value", "_mean")


def smooth(grid: DataFrame) -> DataFrame:
    """Each cell with a value becomes the mean of the values in its 3 by 3 cells."""
    return _means_around(grid).select("row", "col", F.when(F.col("value").isNotNull(), F.col("_mean")).alias("value"))


def fill(grid: DataFrame, iterations: int = 7) -> DataFrame:
    """Cells without a value take the mean of those around them, as often as ``iterations``."""
    for _ in range(iterations):
        grid = saved(_means_around(grid).select("row", "col", F.coalesce("value", "_mean").alias("value")))
        if grid.where("value is null").isEmpty():
            break
    return grid


def bilinear(grid: DataFrame, points: DataFrame, pid: str = "pid") -> DataFrame:
    """``(pid, value)`` at points in cell coordinates (x by col, y by row), between the four cells around a point.

    A missing corner gives no value.  Points beyond the last row or column, or before the first by a cell or more, take the cell
    at their coordinates plus 0.49, rounded towards 0, if the raster has it; less than a cell before the first, the line
    through the first two goes on.  The raster ends at its largest row and column.
    """
    ends = grid.agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))  # one row
    at = points.select(pid, "x", "y", F.col("x").cast("bigint").alias("c0"), F.col("y").cast("bigint").alias("r0")).crossJoin(F.broadcast(ends))
    inside = (F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r0") < F.col("_rows") - 1) & (F.col("c0") < F.col("_cols") - 1)
    dx, dy = F.col("x") - F.col("c0"), F.col("y") - F.col("r0")
    corner = lambda i, j: F.struct((F.col("r0") + i).alias("row"), (F.col("c0") + j).alias("col"), ((dy if i else 1 - dy) * (dx if j else 1 - dx)).alias("w"))
    near = F.struct((F.col("y") + 0.49).cast("bigint").alias("row"), (F.col("x") + 0.49).cast("bigint").alias("col"), F.lit(1.0).alias("w"))
    each = at.select(pid, F.explode(F.when(inside, F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).otherwise(F.array(near))).alias("k")).select(pid, "k.row", "k.col", "k.w")
    each = each.join(grid.select("row", "col", "value"), ["row", "col"], "left")
    return each.groupBy(pid).agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def composite(layers: DataFrame) -> DataFrame:
    """``(row, col, value, alpha)`` of layers ``(row, col, priority, value, alpha)`` laid over each other, low priority first.

    A layer over a result: alpha A = Ar (1 - As) + As, value (Vr Ar (1 - As) + Vs As) / A.
    """
    stack = F.array_sort(F.collect_list(F.struct("priority", "value", "alpha")))
    none = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a"))

    def over(s, x):
        a = s["a"] * (1 - x["alpha"]) + x["alpha"]
        v = F.when(a > 1e-10, (s["v"] * s["a"] * (1 - x["alpha"]) + x["value"] * x["alpha"]) / a).otherwise(0.0)
        return F.struct(v.alias("v"), a.alias("a"))

    laid = layers.where("value is not null and alpha is not null").groupBy("row", "col").agg(F.aggregate(stack, none, over).alias("s"))
    return laid.select("row", "col", F.when(F.col("s.a") > 1e-10, F.col("s.v")).alias("value"), F.col("s.a").alias("alpha"))


def first_valid(layers: DataFrame) -> DataFrame:
    """``(row, col, value)``: of layers in order of priority the first that has a value."""
    return layers.where("value is not null").groupBy("row", "col").agg(F.min_by("value", "priority").alias("value"))


def average_by_label(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, value)``: means per label; cells without a value count as 0."""
    both = labels.select("row", "col", "label").join(grid.select("row", "col", "value"), ["row", "col"], "left")
    return both.groupBy("label").agg((F.sum(F.coalesce("value", F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1))).alias("value"))


def rotated(grid: DataFrame, quarter_turns: int, rows: int, cols: int) -> DataFrame:
    """Turned counter-clockwise by quarters; rows count upwards."""
    for _ in range(quarter_turns % 4):
        grid = grid.select(F.col("col").alias("row"), (F.lit(rows - 1) - F.col("row")).alias("col"), "value")
        rows, cols = cols, rows
    return grid


def to_points(grid: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    return grid.where("value is not null").select((F.lit(x0) + F.col("col") * dx).alias("x"), (F.lit(y0) + F.col("row") * dy).alias("y"), "value")


def decimated(grid: DataFrame, n: int) -> DataFrame:
    """Each n-th row and column."""
    return grid.where((F.col("row") % n == 0) & (F.col("col") % n == 0)).select((F.col("row") / n).cast("long").alias("row"), (F.col("col") / n).cast("long").alias("col"), "value")


def combined(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``(row, col, value)``: the sum (``+``), difference (``-``) or product (``*``) of two rasters where both have cells."""
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}
    if op not in ops:
        raise ValueError("op is +, - or *")
    both = a.select("row", "col", F.col("value").alias("_a")).join(b.select("row", "col", F.col("value").alias("_b")), ["row", "col"])
    return both.select("row", "col", ops[op](F.col("_a"), F.col("_b")).alias("value"))


def upsampled(grid: DataFrame) -> DataFrame:
    """Twice the resolution: each cell's value at even places, means of the two or four cells around at odd ones, where all of them exist."""
    own, v = _ahead(grid.where("value is not null"), [(i, j) for i in (0, 1) for j in (0, 1)])
    made = []
    for i, j in v:
        met = [v[a, b] for a in range(i + 1) for b in range(j + 1)]
        value = sum(met[1:], met[0]) / len(met)  # null where one of them is missing
        made.append(F.struct((2 * F.col("row") + i).alias("row"), (2 * F.col("col") + j).alias("col"), value.alias("value")))
    return own.select(F.inline(F.filter(F.array(*made), lambda x: x["value"].isNotNull())))


def _ahead(grid: DataFrame, steps: list[tuple[int, int]]) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """``grid``, and of each of its cells the value so many rows on and columns beside as a column, null where there is none."""
    each, w, own = _in_columns(grid.where("row is not null and col is not null"), max(abs(k) for step in steps for k in step), sorted({j for _, j in steps}))
    at = {f"_v{k}": F.max(F.when(F.col("j") == j, F.col("value").cast("double"))).over(w.rangeBetween(i, i)) for k, (i, j) in enumerate(steps)}
    return each.withColumns(at).where(own), {step: F.col(f"_v{k}") for k, step in enumerate(steps)}


def rectified(points: DataFrame, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``(row, col, value)``: points ``(x, y, value)`` of a regular lattice as cells; several in one cell give their mean."""
    row, col = F.bround((F.col("y") - y0) / dy, 0).cast("long"), F.bround((F.col("x") - x0) / dx, 0).cast("long")
    return points.groupBy(row.alias("row"), col.alias("col")).agg(F.avg("value").alias("value"))


def nearest_cell(points: DataFrame, grid: DataFrame, pid: str = "pid") -> DataFrame:
    """``(pid, value)`` of the nearest cell to points in cell coordinates; halves go down, as 0.49 and not 0.5 is added before the fraction is cut."""
    at = points.select(pid, F.floor(F.col("y") + 0.49).alias("row"), F.floor(F.col("x") + 0.49).alias("col"))
    return at.join(grid.select("row", "col", "value"), ["row", "col"], "left").select(pid, "value")


def masked(grid: DataFrame, box: tuple[float, float, float, float], value: float | None = None, invert: bool = False) -> DataFrame:
    """Cells outside ``(col, col, row, row)`` bounds, or with ``invert`` those inside, get ``value``."""
    held = F.col("col").between(box[0], box[1]) & F.col("row").between(box[2], box[3])
    return grid.select("row", "col", F.when(~held if invert else held, F.col("value")).otherwise(F.lit(value).cast("double")).alias("value"))


def ordered_hits(rasters: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rasters ``(name, priority, resolution, xmin, xmax, ymin, ymax)`` that touch a box, with their ``place`` by priority, resolution and name."""
    hit = rasters.where((F.col("xmin") <= box[1]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[2]))
    return hit.withColumn("place", F.row_number().over(Window.orderBy("priority", "resolution", "name")) - 1)  # a row for each file


def blended(layers: DataFrame) -> DataFrame:
    """``(row, col, value)``: mean of overlapping layers ``(row, col, value, weight)`` by weight."""
    ok = layers.where("value is not null and weight > 0")
    return ok.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def growing_scale(points: DataFrame, sites: DataFrame, rate: float, pid: str = "pid") -> DataFrame:
    """``(pid, value)``: the least over ``sites(x, y, value)`` of a site's value and ``rate - 1`` times the distance to it.  Sites are few and broadcast."""
    s = F.broadcast(sites.agg(F.collect_list(F.struct("x", "y", "value")).alias("s")))  # one row
    far = F.transform("s", lambda a: a["value"] + (rate - 1) * F.sqrt(F.pow(F.col("x") - a["x"], 2) + F.pow(F.col("y") - a["y"], 2)))
    return points.join(s).select(pid, F.array_min(far).alias("value"))


#: The steps from a cell to a neighbour of a graph, by degree: two ends, then the other cells that must have values too.
STEPS = {
    4: [((0, 0), (1, 0)), ((0, 0), (0, 1))],
    8: [((0, 0), (1, 1), (0, 1), (1, 0)), ((0, 1), (1, 0), (0, 0), (1, 1))],
    16: [((0, 0), (2, 1), (1, 0), (1, 1)), ((0, 1), (2, 0), (1, 0), (1, 1)), ((0, 0), (1, 2), (0, 1), (1, 1)), ((0, 2), (1, 0), (0, 1), (1, 1))],
}


def cell_edges(grid: DataFrame, degree: int = 8, highest: float | None = None, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``(a_row, a_col, b_row, b_col, length, value)``: a raster as a graph: links of cells that have values, none of them above ``highest``.

    Degree 4 links the next cells in rows and columns, 8 diagonals too, 16 also the jumps of a knight.  All cells that a link
    touches have values, and their mean is the link's.  Each link is found at its first end, which sees the others within its tile.
    """
    links = [[(i - s[0][0], j - s[0][1]) for i, j in s] for d in STEPS if d <= degree for s in STEPS[d]]
    held = grid.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.lit(True) if highest is None else F.col("value") <= highest))
    own, v = _ahead(held, sorted({x for cells in links for x in cells}))
    made = []
    for cells in links:
        i, j = cells[1]
        value = sum((v[x] for x in cells[1:]), v[cells[0]]) / len(cells)  # null where one of them is missing
        length = F.sqrt(F.pow(F.lit(i * float(dy)), 2) + F.pow(F.lit(j * float(dx)), 2))
        made.append(F.struct(F.col("row").alias("a_row"), F.col("col").alias("a_col"), (F.col("row") + i).alias("b_row"), (F.col("col") + j).alias("b_col"), length.alias("length"), value.alias("value")))
    return own.select(F.inline(F.filter(F.array(*made), lambda x: x["value"].isNotNull())))
