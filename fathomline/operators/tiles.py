"""Rasters in tiles with halos: a kernel sees a whole array and what lies around it, and no task holds a raster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import components
from fathomline.session import saved


def tiled(grid: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], halo: int, size: int = 512) -> DataFrame:
    """``(row, col, value)`` of ``kernel`` on tiles of ``size`` by ``size`` cells that see ``halo`` cells around them.

    Cells go to their own tile and to those whose halo they lie in.  The kernel gets an array without values where the raster has
    none, as large as tile and halo but not beyond the raster's largest row and column or below row and column 0, and returns one of the same
    shape; where it depends on nothing beyond the halo, the result doesn't depend on ``size``.  Cells are returned where the kernel gives a value or
    the raster has a row.
    """
    if halo > size:
        raise ValueError("a halo is no wider than a tile")
    ends = grid.agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))  # one row
    own = lambda c, d: F.floor((F.col(c) + d) / size)
    near = lambda c, last: F.filter(F.array_distinct(F.array(own(c, -halo), own(c, 0), own(c, halo))), lambda x: (x >= 0) & (x <= F.floor(F.col(last) / size)))
    at = grid.select("row", "col", F.col("value").cast("double").alias("value")).crossJoin(F.broadcast(ends))
    dealt = at.select("*", F.explode(near("row", "_rows")).alias("_i")).select("*", F.explode(near("col", "_cols")).alias("_j"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        i, j, rows, cols = (int(x[c].iloc[0]) for c in ("_i", "_j", "_rows", "_cols"))
        r0, c0 = max(0, i * size - halo), max(0, j * size - halo)
        shape = min(rows, (i + 1) * size + halo - 1) - r0 + 1, min(cols, (j + 1) * size + halo - 1) - c0 + 1
        v, there = np.full(shape, np.nan), np.zeros(shape, bool)
        at = x["row"].to_numpy() - r0, x["col"].to_numpy() - c0
        v[at], there[at] = x["value"].to_numpy(), True
        out = kernel(v)
        r, c = np.nonzero(~np.isnan(out) | there)
        inside = (r + r0 >= i * size) & (r + r0 < (i + 1) * size) & (c + c0 >= j * size) & (c + c0 < (j + 1) * size)
        r, c = r[inside], c[inside]
        return pd.DataFrame({"row": r + r0, "col": c + c0, "value": out[r, c]})

    found = dealt.groupBy("_i", "_j").applyInPandas(run, "row bigint, col bigint, value double")
    return found.select("row", "col", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def _mirrored(v: np.ndarray, reach: int) -> np.ndarray:
    return np.pad(v, reach, mode="symmetric")


def box_mean(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values in ``width`` by ``width`` cells around each cell, and their number, the array mirrored at its borders."""
    reach = width // 2
    ok = ~np.isnan(v)
    out = []
    for a in (np.where(ok, v, 0.0), ok.astype(float)):
        a = _mirrored(a, reach)
        rows = sum(a[k : k + v.shape[0]] for k in range(width))
        out.append(sum(rows[:, k : k + v.shape[1]] for k in range(width)))
    return out[0], out[1]


def smoothed(grid: DataFrame, width: int = 3, iterations: int = 1, size: int = 512) -> DataFrame:
    """Each cell with a value becomes the mean of those in ``width`` by ``width`` cells, as often as ``iterations``; the raster is mirrored at its borders."""

    def run(v: np.ndarray) -> np.ndarray:
        for _ in range(iterations):
            s, n = box_mean(v, width)
            v = np.where(np.isnan(v), np.nan, s / np.maximum(n, 1))
        return v

    return tiled(grid, run, (width // 2) * iterations, max(size, (width // 2) * iterations))


def filled(grid: DataFrame, width: int = 3, iterations: int = 7, smoothing: int = 0, size: int = 512) -> DataFrame:
    """Cells without a value take the mean of those around them, growing by a ring an iteration; then ``smoothing`` more means, without growing.

    Cells that lack in each iteration are all taken anew, so they settle, while given values stay.  The raster is mirrored at its borders.
    """

    def run(v: np.ndarray) -> np.ndarray:
        given, v = ~np.isnan(v), v.copy()
        for k in range(iterations + smoothing):
            s, n = box_mean(v, width)
            grow = ~given & (n > 0) if k < iterations else ~given & ~np.isnan(v)
            v = np.where(grow, s / np.maximum(n, 1), v)
        return v

    reach = (width // 2) * (iterations + smoothing)
    return tiled(grid, run, reach, max(size, reach))


def holes(grid: DataFrame) -> DataFrame:
    """``(row, col, hole)``: cells of the raster's rows without a value, named by the smallest (row, col) that they join to along rows and columns."""
    lack = saved(grid.where(F.col("value").isNull() | F.isnan("value")).select(F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).alias("c")))
    step = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(0).alias("j"))))
    to = lack.select("c", step.alias("s")).select("c", F.struct((F.col("c.row") + F.col("s.i")).alias("row"), (F.col("c.col") + F.col("s.j")).alias("col")).alias("d"))
    pair = to.join(lack.select(F.col("c").alias("d")), "d", "left_semi")
    found = components(pair, "c", "d")
    return lack.join(found, F.col("c") == F.col("id"), "left").select("c.row", "c.col", F.coalesce("component", "c").alias("hole"))


def filled_locally(grid: DataFrame, width: int = 3, iterations: int = 7, largest: int = 1 << 20, size: int = 512) -> DataFrame:
    """``filled`` for holes whose box has at most ``largest`` cells, where other holes' cells count as without a value; larger holes stay.

    A hole sees its own box and one cell around it, mirrored at that border, whatever tile it lies in: each is one small array, a task takes many.
    """
    own = saved(holes(grid))
    box = own.groupBy("hole").agg(F.min("row").alias("ra"), F.max("row").alias("rb"), F.min("col").alias("ca"), F.max("col").alias("cb"))
    ends = grid.agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    box = box.where((F.col("rb") - F.col("ra") + 1) * (F.col("cb") - F.col("ca") + 1) <= largest).crossJoin(F.broadcast(ends))
    box = box.select("hole", *(F.greatest(F.col(c) - 1, F.lit(0)).alias(c) for c in ("ra", "ca")), *(F.least(F.col(c) + 1, F.col(e)).alias(c) for c, e in (("rb", "_rows"), ("cb", "_cols"))))
    near = box.select("*", F.explode(F.sequence("ra", "rb")).alias("row")).select("*", F.explode(F.sequence("ca", "cb")).alias("col"))
    lacks = own.select(F.col("row"), F.col("col"), F.col("hole").alias("_own"))
    cells = near.join(grid.select("row", "col", F.col("value").cast("double").alias("value")), ["row", "col"], "left").join(lacks, ["row", "col"], "left")
    cells = cells.select("hole", "ra", "ca", "rb", "cb", "row", "col", "value", (F.col("hole") == F.col("_own")).alias("mine"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        ra, ca = int(x["ra"].iloc[0]), int(x["ca"].iloc[0])
        v = np.full((int(x["rb"].iloc[0]) - ra + 1, int(x["cb"].iloc[0]) - ca + 1), np.nan)
        at = x["row"].to_numpy() - ra, x["col"].to_numpy() - ca
        v[at] = x["value"].to_numpy()
        given, out = ~np.isnan(v), v.copy()
        for _ in range(iterations):
            s, n = box_mean(out, width)
            out = np.where(~given & (n > 0), s / np.maximum(n, 1), out)
        mine = x["mine"].fillna(False).to_numpy(dtype=bool)
        return pd.DataFrame({"row": x["row"][mine], "col": x["col"][mine], "value": out[at][mine]})

    got = cells.groupBy("hole").applyInPandas(run, "row bigint, col bigint, value double").select("row", "col", F.when(~F.isnan("value"), F.col("value")).alias("_filled"))
    return grid.join(got, ["row", "col"], "left").select("row", "col", F.coalesce(F.when(~F.isnan("value"), F.col("value").cast("double")), "_filled").alias("value"))
