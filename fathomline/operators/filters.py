"""Filters of evenly sampled series, and harmonic analysis.

A series is rows of keys, an order and a value.  Filters are windows partitioned by the keys, so a chain of
them costs one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.keyed import joined


def _reach(size: int) -> tuple[int, int]:
    """Samples before and after the centre; of an even window the centre is the later of the middle two."""
    return size // 2, (size - 1) // 2


def boxcar(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, into: str = "filtered") -> DataFrame:
    """``df`` with the sum of ``size`` samples over ``size``; beyond the ends samples are 0, a null one makes its windows null."""
    back, ahead = _reach(size)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, ahead)
    return df.withColumn(into, F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), F.sum(value).over(w) / size))


def godin(df: DataFrame, keys: list[str], order: list[str], value: str, step_hours: float = 1.0, ends: str = "pass", into: str = "filtered") -> DataFrame:
    """``df`` with boxcars of 24, 24 and 25 hours in turn; with ``ends='null'`` samples that they reach beyond the ends from are null."""
    if ends not in ("pass", "null"):
        raise ValueError("ends is pass or null")
    sizes = [round(24 / step_hours), round(24 / step_hours), round(25 / step_hours)]
    out = df.withColumn(into, F.col(value))
    for size in sizes:
        out = boxcar(out, keys, order, into, size, into)
    if ends == "null":
        w = Window.partitionBy(*keys).orderBy(*order)
        back, ahead = (sum(x) for x in zip(*map(_reach, sizes), strict=True))
        whole = F.lag(F.lit(1), back).over(w).isNotNull() & F.lead(F.lit(1), ahead).over(w).isNotNull()
        out = out.withColumn(into, F.when(whole, F.col(into)))
    return out


def fir(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, window: str = "hanning", least: float = 0.49999, into: str = "filtered") -> DataFrame:
    """``df`` with a weighted mean of ``size`` samples: a Hanning window without its zero ends, or ``boxcar``.

    Weights of null samples and of those beyond the ends are left out of the mean, and it is null where
    those that remain sum to less than ``least`` of all.
    """
    if window not in ("hanning", "boxcar"):
        raise ValueError("window is hanning or boxcar")
    back, ahead = _reach(size)
    w = Window.partitionBy(*keys).orderBy(*order)
    near = w.rowsBetween(-back, ahead)
    v = F.col(value).cast("double")
    one = F.when(v.isNotNull(), 1.0)
    summed = lambda x: F.coalesce(F.sum(x).over(near), F.lit(0.0))
    if window == "boxcar":
        s, n = summed(v) / size, summed(one) / size
        return df.withColumn(into, F.when((n >= least) & (n > 0), s / n))
    # The weight of sample i in the window of sample j is 1 - cos(step * (i - j + back + 1)): with the cosine of a
    # difference taken apart, weighted sums are sums of v, v cos(step * i) and v sin(step * i) over the window.
    step = 2 * math.pi / (size + 1)
    turn = F.lit(step) * (F.col("_i") % (size + 1))
    df = df.withColumn("_i", F.row_number().over(w)).withColumns({"_c": F.cos(turn), "_d": F.sin(turn)})
    away = F.lit(step) * ((F.col("_i") - (back + 1)) % (size + 1))

    def weighted(x: Column) -> Column:
        return (summed(x) - F.cos(away) * summed(x * F.col("_c")) - F.sin(away) * summed(x * F.col("_d"))) / (size + 1)

    s, n = weighted(v), weighted(one)
    return df.withColumn(into, F.when((n >= least) & (n > 0), s / n)).drop("_i", "_c", "_d")


def decompose(df: DataFrame, keys: list[str], t: str, value: str, omegas: list[float]) -> DataFrame:
    """``(keys, omega, amplitude, phase)``: the least-squares fit of ``amplitude * cos(omega * t - phase)`` summed over ``omegas``.

    ``omegas`` are angular frequencies.  Rows without t or value are left out.  Each task adds up the normal equations of its rows
    by key, and their sums by key and place are Spark's, so a series is never gathered; each key's small system is solved for the
    least norm.
    """
    n, own = 2 * len(omegas), [f"_k{i}" for i in range(len(keys))]
    here = df.where(F.col(t).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    here = here.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_h"))

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        told = lambda: pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=[*own, "_s"], dtype=object)
        for x in batches:
            turn = np.outer(x["_t"].to_numpy(), omegas)
            basis = np.stack([np.cos(turn), np.sin(turn)], axis=2).reshape(len(x), n)
            h = x["_h"].to_numpy()
            key = [tuple(None if pd.isna(v) else v for v in r) for r in x[own].drop_duplicates().itertuples(index=False)] if own else [()]
            at = x[own].apply(lambda c: pd.factorize(c, use_na_sentinel=False)[0]) if own else None
            number = at.groupby(own, sort=False).ngroup().to_numpy() if own else np.zeros(len(x), int)
            for i, k in enumerate(key):
                rows = number == i
                s = np.concatenate([(basis[rows].T @ basis[rows]).ravel(), basis[rows].T @ h[rows]])
                held[k] = held[k] + s if k in held else s
            if len(held) > 256:
                yield told()
                held = {}
        if held:
            yield told()

    kinds = dict(df.dtypes)
    parts = here.mapInPandas(normal, ", ".join([*(f"{o} {kinds[k]}" for k, o in zip(keys, own, strict=True)), "_s array<double>"]))
    each = parts.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), F.posexplode("_s").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    held = F.array_sort(F.collect_list(F.struct("_i", "_v")))["_v"]  # n (n + 1) numbers
    sums = each.groupBy(*keys).agg(held.alias("_s")).select(*keys, F.slice("_s", 1, n * n).alias("_a"), F.slice("_s", n * n + 1, n).alias("_y")).where("size(_y) > 0")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            a, y = np.stack(x["_a"]).reshape(-1, n, n), np.stack(x["_y"])
            part = (np.linalg.pinv(a, hermitian=True) @ y[:, :, None])[:, :, 0].reshape(len(x), -1, 2)
            out = x[keys].loc[x.index.repeat(len(omegas))].reset_index(drop=True)
            yield out.assign(omega=np.tile(omegas, len(x)).astype(float), amplitude=np.hypot(part[:, :, 0], part[:, :, 1]).ravel(), phase=np.arctan2(part[:, :, 1], part[:, :, 0]).ravel())

    return sums.mapInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "omega double, amplitude double, phase double"]))


def recompose(df: DataFrame, comps: DataFrame, keys: list[str], t: str, into: str = "level") -> DataFrame:
    """``df`` with the sum of the constituents of its keys at its times; null for keys without any."""
    each = comps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("omega", "amplitude", "phase"))).alias("_c"))
    found = df.join(each, keys, "left") if keys else df.join(F.broadcast(each), F.lit(True), "left")
    wave = F.transform("_c", lambda c: c["amplitude"] * F.cos(c["omega"] * F.col(t) - c["phase"]))
    return found.withColumn(into, F.aggregate(wave, F.lit(0.0), lambda a, x: a + x)).drop("_c")


def butter(order: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth low pass; ``cut`` is the half-power frequency over half the sampling rate."""
    if not 0 < cut < 1:
        raise ValueError("the cutoff must be longer than the time step")
    warped = 4 * math.tan(math.pi * cut / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    gain = (warped**order / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)), np.poly((4 + poles) / (4 - poles)).real


def _settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state in a series that has been 1 for ever."""
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -a[1:]
    step[: n - 1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - step, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    out, s, b0, b1, a1 = np.empty(len(x)), state.copy(), b[0], b[1:], a[1:]
    for i, v in enumerate(x):
        y = b0 * v + s[0]
        s[:-1] = s[1:]
        s[-1] = 0.0
        s += b1 * v - a1 * y
        out[i] = y
    return out


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter forward and backward, so without delay, over a series that goes on mirrored at its ends."""
    pad, start = 3 * max(len(a), len(b)), _settled(b, a)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    there = _run(b, a, long, start * long[0])[::-1]
    return _run(b, a, there, start * there[0])[::-1][pad:-pad]


#: Samples of a series that one task filters, besides those on both sides from which its filter settles.
BLOCK = 20_000


def lowpass(df: DataFrame, keys: list[str], order: list[str], value: str, step: float, cutoff: float, degree: int = 4, causal: bool = False, into: str = "filtered") -> DataFrame:
    """``df`` with a Butterworth low pass of evenly spaced samples, ``step`` and ``cutoff`` in one unit of time.

    The half-power frequency is ``step / cutoff`` of half the sampling rate, so half the response is at twice the cutoff.
    Without ``causal`` it runs both ways.  A null makes its series null, and so does a length of 15 or less at degree 4.

    A series is dealt in blocks with samples on both sides from which what lies beyond has decayed below 1e-13 of its
    size, so no task holds a series.
    """
    b, a = butter(degree, step / cutoff)
    halo = int(math.ceil(-30.0 / math.log(np.abs(np.roots(a)).max()))) + 3 * (degree + 1)
    block = max(BLOCK, 4 * halo)
    w, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    s = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(every), "_ok": F.count(value).over(every) == F.count("*").over(every)})
    s = s.withColumn("_v", F.when(F.col("_ok") & (F.col("_n") > 3 * (degree + 1)), F.col(value).cast("double")))
    own = F.floor(F.col("_i") / block)
    near = F.array_distinct(F.array(own, F.floor(F.greatest(F.col("_i") - halo, F.lit(0)) / block), F.floor(F.least(F.col("_i") + halo, F.col("_n") - 1) / block)))
    dealt = s.select(*keys, "_i", "_v", own.alias("_own"), F.explode(near).alias("_block"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_i")
        v = x["_v"].to_numpy()
        if not np.isnan(v).any():
            v = _run(b, a, v, np.zeros(degree)) if causal else both_ways(b, a, v)
        return x.assign(_f=v)[x["_own"] == x["_block"]][[*keys, "_i", "_f"]]

    kinds = dict(df.dtypes)
    found = dealt.groupBy(*keys, "_block").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_i int, _f double"]))
    return joined(s, found, [*keys, "_i"]).withColumn(into, F.when(~F.isnan("_f"), F.col("_f"))).select(*df.columns, into)


def windowed_slope(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, size: int, into: str = "slope") -> DataFrame:
    """``df`` with the local slope of y over x: of their parts faster than a Hanning mean, mean product over mean square."""
    s = fir(fir(df, keys, order, x, size, into="_lx"), keys, order, y, size, into="_ly")
    s = s.withColumns({"_xy": (F.col(x) - F.col("_lx")) * (F.col(y) - F.col("_ly")), "_xx": (F.col(x) - F.col("_lx")) * (F.col(x) - F.col("_lx"))})
    s = fir(fir(s, keys, order, "_xy", size, into="_sxy"), keys, order, "_xx", size, into="_sxx")
    return s.withColumn(into, F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))).select(*df.columns, into)


def nearest_mean(df: DataFrame, keys: list[str], x: str, y: str, n: int, into: str = "mean") -> DataFrame:
    """``df`` with the mean of the n values nearest in x, of equally near ones those before.

    The n nearest of sorted values lie within n - 1 places on either side.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    near = F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(w.rowsBetween(1 - n, n - 1))
    here = F.transform("_near", lambda s: F.struct(F.abs(s["x"] - F.col(x)).alias("d"), s["x"].alias("x"), s["y"].alias("y")))
    best = F.slice(F.array_sort(here), 1, n)
    return df.withColumn("_near", near).withColumn(into, F.aggregate(best, F.lit(0.0), lambda a, s: a + s["y"]) / F.size(best)).drop("_near")


def thinned(df: DataFrame, keys: list[str], order: list[str], value: str, stride: int, smooth: bool = True) -> DataFrame:
    """Every ``stride``-th row in order, its value smoothed by a Hanning mean of twice the stride before."""
    s = fir(df, keys, order, value, 2 * stride, into="_f").withColumn(value, F.col("_f")).drop("_f") if smooth else df
    return s.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("_i") % stride == 0).drop("_i")
