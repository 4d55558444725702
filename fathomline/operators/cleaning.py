"""Cleaning of loggers' series: time in the water, spikes, positions by ensemble and clocks that are whole hours off.

A series is rows of keys, an order and a value; null keys make a series too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.time import from_micros, micros
from fathomline.operators.keyed import joined


def in_water(df: DataFrame, keys: list[str], order: str, value: str, limit: float = 0.5) -> DataFrame:
    """Rows from the first to before the last that lies within ``limit`` population deviations of its series' median.

    ``limit`` is 0.5 for conductivity and 0.1 for pressure.  The last such row itself goes, and so does any at its order.
    Null and NaN values and null orders are never within; a constant series has no row within and goes whole.  Three
    aggregations that combine before their shuffle; a task holds the distinct values of a series for its median.
    """
    seen = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    level = df.groupBy(*keys).agg(F.median(seen).alias("_m"), F.stddev_pop(seen).alias("_s"))
    near = joined(df.select(*keys, order, seen.alias("_v")), level, keys).where(F.abs(F.col("_v") - F.col("_m")) < limit * F.col("_s"))
    ends = near.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    return joined(df, ends, keys).where((F.col(order) >= F.col("_a")) & (F.col(order) < F.col("_b"))).drop("_a", "_b")


def spikes_of(v: np.ndarray, threshold: float, rounds: int | None) -> np.ndarray:
    """Positions in ``v`` of spikes, largest first; see ``without_spikes``.

    A second difference changes only by going missing, so one order of sizes serves all rounds, and sums are corrected by what goes.
    """
    bend = np.diff(v, 2)
    alive = np.isfinite(bend)
    found: list[int] = []
    for at in np.argsort(-np.abs(np.where(alive, bend, 0.0)), kind="stable"):
        if rounds is not None and len(found) == rounds:
            break
        if not alive[at]:
            continue
        if not abs(bend[at]) > threshold * bend[alive].std():
            break
        found.append(at + 1)
        alive[max(at - 1, 0) : at + 2] = False
    return np.array(found, dtype=int)


def without_spikes(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float = 30.0, rounds: int | None = 1, into: str = "clean") -> DataFrame:
    """``df`` with ``into``: ``value`` as double, null where its second difference is over ``threshold`` of their population deviations.

    Each round takes the largest of a series, of equal ones the first, and goes on without the differences that it touched, until none is
    over; ``rounds`` is how many a series loses at most, None for all.  Null and NaN values stay null and bend nothing.
    Only orders and values go to Python; a task holds one series.  ``order`` tells rows of a series apart: of rows that tie, any may be the spike.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    named = df.withColumn("_i", F.row_number().over(w))
    thin = named.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_i").alias("_at"), F.col(value).cast("double").alias("_v"))
    parts = [f"_k{i}" for i in range(len(keys))]

    def clean(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_at", ignore_index=True)
        v = g["_v"].to_numpy(dtype=float, copy=True)
        v[spikes_of(v, threshold, rounds)] = np.nan
        return g.assign(_v=pd.Series(v).astype(object).where(~np.isnan(v), None))

    done = thin.groupBy(*parts).applyInPandas(clean, thin.schema)
    back = done.select(*(F.col(p).alias(k) for p, k in zip(parts, keys)), F.col("_at").alias("_i"), F.col("_v").alias(into))
    return joined(named, back, [*keys, "_i"], "left").drop("_i")


def fixes(sentences: DataFrame, keys: list[str], order: list[str], fix: str, ensemble: str, time: str) -> DataFrame:
    """The rows of ``sentences`` where ``fix`` holds, with the last ``ensemble`` and ``time`` that came after the fix before.

    Both are null where none came: what is known is forgotten with each fix.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    told = sentences.withColumn("_g", F.sum(F.coalesce(F.col(fix).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.col(fix).cast("int"), F.lit(0)))
    since = Window.partitionBy(*keys, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumns({c: F.last(c, True).over(since) for c in (ensemble, time)}).where(fix).drop("_g")


def positioned(ensembles: DataFrame, found: DataFrame, keys: list[str], order: list[str], number: str, values: list[str]) -> DataFrame:
    """``ensembles`` with ``values`` of ``found`` (as of ``fixes``) on the line between the fixes around their ``number``.

    Null before the first fix of a series and after the last; fixes without a number don't count, of several with one number
    the last by ``order`` does, and each value is taken between the fixes that have it.  One shuffle takes both tables.
    """
    last = found.where(F.col(number).isNotNull()).groupBy(*keys, number).agg(*(F.max_by(v, F.struct(*order)).cast("double").alias(v) for v in values))
    right = last.select(*keys, F.col(number).alias("_x"), F.lit(0).alias("_side"), *(F.when(F.col(v).isNotNull(), F.struct(F.col(number).cast("double").alias("x"), F.col(v).alias("v"))).alias(f"_f_{v}") for v in values), F.lit(None).alias("_row"))
    row = F.struct(*(c for c in ensembles.columns if c not in keys))
    left = ensembles.select(*keys, F.col(number).alias("_x"), F.lit(1).alias("_side"), row.alias("_row"))
    both = right.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)).unionByName(left, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.col("_x").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"_p_{v}": F.last(f"_f_{v}", True).over(w) for v in values}).withColumns({f"_n_{v}": F.last(f"_f_{v}", True).over(back) for v in values})
    x = F.col("_x").cast("double")

    def on(v: str):
        p, n = F.col(f"_p_{v}"), F.col(f"_n_{v}")
        return F.when(p.x == n.x, p.v).otherwise(p.v + (n.v - p.v) * (x - p.x) / F.nullif(n.x - p.x, F.lit(0.0)))

    return both.where("_side = 1").select(*keys, "_row.*", *(F.when(F.col("_x").isNotNull(), on(v)).alias(v) for v in values))


def hours_set(df: DataFrame, keys: list[str], ts: str, true: str, into: str = "set") -> DataFrame:
    """``df`` with ``into``: ``ts`` moved by the whole hours nearest to a series' median of ``true - ts`` (halves to even).

    Rows without either time don't count; a series without both anywhere keeps its times.
    """
    off = (micros(F.col(true)) - micros(F.col(ts))) / 3_600_000_000
    shift = df.groupBy(*keys).agg(F.bround(F.median(off), 0).cast("long").alias("_h"))
    return joined(df, shift, keys).withColumn(into, from_micros(micros(F.col(ts)) + F.coalesce("_h", F.lit(0)) * 3_600_000_000)).drop("_h")
