"""Spectra of regular series from their autocovariances, and the period that carries most of a series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.metrics import autocovariance, detrended
from fathomline.session import saved


def correlogram(cov: DataFrame, keys: list[str], longest: int, bins: int) -> DataFrame:
    """``(keys, bin, power)``: the cosine transform of ``cov(keys, lag, cov)``, of lags 0 to ``longest``, tapered by half a Hann window.

    Lags without a covariance count as 0.  The rows are keys x lags x bins before they are summed, whatever the length of a series.
    """
    if not 0 < longest < bins:
        raise ValueError("the longest lag is positive and smaller than the number of bins")
    each = cov.where(F.col("lag").between(0, longest)).select(*keys, "lag", "cov", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    taper = F.when(F.col("lag") == 0, 1.0).otherwise(1 + F.cos(F.col("lag") * (math.pi / longest)))
    wave = F.cos(F.col("bin") * F.col("lag") * (2 * math.pi / bins))
    return each.groupBy(*keys, "bin").agg(F.sum(F.col("cov") * taper * wave).alias("power"))


def spectrum(df: DataFrame, keys: list[str], index: str, value: str, longest: int, bins: int, step: float = 1.0) -> DataFrame:
    """``(keys, frequency, power)`` of a regular series ``step`` apart, less its straight line, with holes where values are null.

    One-sided: power counts twice but at 0 and at the highest frequency, so ``bins`` is even.
    """
    if bins % 2:
        raise ValueError("bins is even")
    flat = detrended(df, keys, index, value, "_flat")
    found = correlogram(autocovariance(flat, keys, index, "_flat", longest), keys, longest, bins).where(F.col("bin") <= bins // 2)
    twice = F.when(F.col("bin").isin(0, bins // 2), step).otherwise(2 * step)
    return found.select(*keys, (F.col("bin") / (bins * step)).alias("frequency"), (F.abs("power") * twice).alias("power"))


def dominant_period(df: DataFrame, keys: list[str], t: str, value: str, periods: list[float], rounds: int = 6, fan: int = 8) -> DataFrame:
    """``(keys, period, energy)``: of each key the period with most energy, see ``metrics.period_energy``, of the series less its mean.

    The best of ``periods`` is refined between its neighbours: ``rounds`` times by ``fan`` equal steps, so each round narrows the
    reach to 2 / ``fan``.  A peak that lies between two of ``periods`` is found only if one of them is on its slope.  Of equal
    energies the shorter period counts.  Series without a value, and null keys, have no row.
    """
    tried = sorted(set(map(float, periods)))
    if not tried or tried[0] <= 0 or not keys:
        raise ValueError("give keys, and periods above 0")
    whole = Window.partitionBy(*keys)
    known = df.where(F.col(t).isNotNull() & F.col(value).isNotNull()).dropna(subset=keys)
    each = saved(known.select(*keys, F.col(t).cast("double").alias("_t"), (F.col(value) - F.avg(value).over(whole)).alias("_h")))

    def energy(period):
        angle = 2 * math.pi * F.col("_t") / period
        return F.pow(F.avg(F.col("_h") * F.cos(angle)), 2) + F.pow(F.avg(F.col("_h") * F.sin(angle)), 2)

    def trial(period, low, high):
        return F.struct(energy(period).alias("e"), (-period).alias("p"), low.alias("low"), high.alias("high"))

    near = [(tried[max(i - 1, 0)], p, tried[min(i + 1, len(tried) - 1)]) for i, p in enumerate(tried)]
    best = each.groupBy(*keys).agg(F.array_max(F.array(*(trial(F.lit(p), F.lit(a), F.lit(b)) for a, p, b in near))).alias("_b"))
    for _ in range(rounds):
        ends = saved(best).select(*keys, F.col("_b.low").alias("_low"), F.col("_b.high").alias("_high"))
        low, step = F.col("_low"), (F.col("_high") - F.col("_low")) / fan
        steps = [trial(low + k * step, low + max(k - 1, 0) * step, low + min(k + 1, fan) * step) for k in range(fan + 1)]
        best = each.join(ends, keys).groupBy(*keys, "_low", "_high").agg(F.array_max(F.array(*steps)).alias("_b"))
    return best.select(*keys, (-F.col("_b.p")).alias("period"), F.col("_b.e").alias("energy"))
