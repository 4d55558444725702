"""Statistics of series and pairs of series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.time import from_micros, micros
from fathomline.operators.keyed import joined
from fathomline.operators.temporal import asof, bin_mean, period


def paired(df: DataFrame, keys: list[str], x: str, ref: str) -> DataFrame:
    """``(keys, n, bias, r, amp, willmott, murphy, rms_error)`` of a model against a reference, over rows where both are.

    ``amp`` is the ratio of population deviations.  Willmott's and Murphy's skill measure errors against the
    reference's own mean.
    """
    both = df.where(F.col(x).isNotNull() & F.col(ref).isNotNull() & ~F.isnan(x) & ~F.isnan(ref))
    means = both.groupBy(*keys).agg(F.avg(ref).alias("_m"))
    both = joined(both, means, keys)
    err = F.pow(F.col(x) - F.col(ref), 2)
    span = F.pow(F.abs(F.col(x) - F.col("_m")) + F.abs(F.col(ref) - F.col("_m")), 2)
    return both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col(x) - F.col(ref)).alias("bias"), F.corr(x, ref).alias("r"), (F.stddev_pop(x) / F.stddev_pop(ref)).alias("amp"),
        (1 - F.sum(err) / F.sum(span)).alias("willmott"), (1 - F.avg(err) / F.avg(F.pow(F.col(ref) - F.col("_m"), 2))).alias("murphy"), F.sqrt(F.avg(err)).alias("rms_error"),
    )


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``(keys, rho)``: correlation of ranks, equal values sharing their mean rank."""

    def ranked(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_rx", ranked(x)).withColumn("_ry", ranked(y))
    return both.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"))


def rms(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``(keys, weighted_median)``: the first value at which the weights so far reach half of all.

    Weights are summed by value first, so repeated values cost one row.
    """
    each = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    each = each.withColumn("_c", F.sum("_w").over(w.orderBy(value))).withColumn("_t", F.sum("_w").over(w))
    return each.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def pair_cov(df: DataFrame, row: str, var: str, value: str, demean: bool = False) -> DataFrame:
    """``(var_a, var_b, cov)``: sums of products over the rows that both variables have, by their number less one; 0 if that is not positive."""
    if demean:
        df = df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(var)))
    a = df.where(F.col(value).isNotNull()).select(F.col(row).alias("_r"), F.col(var).alias("var_a"), F.col(value).alias("_a"))
    b = a.select("_r", F.col("var_a").alias("var_b"), F.col("_a").alias("_b"))
    n = F.count("*")
    return a.join(b, "_r").groupBy("var_a", "var_b").agg(F.when(n > 1, F.sum(F.col("_a") * F.col("_b")) / (n - 1)).otherwise(0.0).alias("cov"))


def autocovariance(df: DataFrame, keys: list[str], index: str, value: str, max_lag: int) -> DataFrame:
    """``(keys, lag, cov, n)``: mean product of values ``lag`` apart in ``index``, for lags from 0."""
    later = df.select(*keys, F.col(index).alias("_j"), F.col(value).alias("_b"))
    now = df.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    now = now.withColumn("_j", F.col("_i") + F.col("lag"))
    both = now.join(later, [*keys, "_j"]).where("_a is not null and _b is not null")
    return both.groupBy(*keys, "lag").agg(F.avg(F.col("_a") * F.col("_b")).alias("cov"), F.count("*").alias("n"))


def principal_theta(df: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    """``(keys, theta)``: direction of greatest variance of a vector series, in radians."""
    return df.groupBy(*keys).agg((0.5 * F.atan2(2 * F.covar_samp(u, v), F.var_samp(u) - F.var_samp(v))).alias("theta"))


def detrended(df: DataFrame, keys: list[str], x: str, y: str, into: str = "residual") -> DataFrame:
    """Values less their straight-line fit over x."""
    w = Window.partitionBy(*keys)
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    xs, ys = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    slope = F.covar_pop(xs, ys).over(w) / F.var_pop(xs).over(w)
    return df.withColumn(into, F.col(y) - F.avg(ys).over(w) - slope * (F.col(x) - F.avg(xs).over(w)))


def enumerate_groups(df: DataFrame, key: str, index: str) -> DataFrame:
    """``(key, members)`` with members in order.  An array holds a whole group, so use it where groups are small."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(index)).alias("members"))


def lag_scan(x: DataFrame, ref: DataFrame, keys: list[str], lags: list[float], ts: str = "ts", value: str = "value", least: int = 3) -> DataFrame:
    """``(keys, lag, r, n)``: the correlation of ``ref`` with ``x`` that many seconds later, for each of ``lags``.

    ``x`` is linear between its samples and counts only there; lags of fewer than ``least`` pairs have no row.
    Only ``ref`` is repeated for the lags, so give the sparser series as ``ref``.
    """
    tried = ref.where(F.col(value).isNotNull()).select(*keys, F.col(ts), F.col(value).alias("_ref"), F.explode(F.array(*(F.lit(float(s)) for s in lags))).alias("lag"))
    tried = tried.withColumn(ts, from_micros(micros(F.col(ts)) + (F.col("lag") * 1e6).cast("long")))
    found = asof(tried, x.where(F.col(value).isNotNull()), keys, ts, value).where("t0 is not null and t1 is not null")
    back, whole = micros(F.col(ts)) - micros(F.col("t0")), micros(F.col("t1")) - micros(F.col("t0"))
    at = F.when(whole == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * back / F.nullif(whole, F.lit(0)))
    out = found.withColumn("_x", at).groupBy(*keys, "lag").agg(F.corr("_x", "_ref").alias("r"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def best_lag(scan: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, lag, r)`` of the largest correlation in a ``lag_scan``, the lag nearest 0 of equal ones."""
    top = F.max(F.struct("r", (-F.abs("lag")).alias("near"), "lag")).alias("_t")
    return scan.where("r is not null and not isnan(r)").groupBy(*keys).agg(top).select(*keys, "_t.lag", "_t.r")


def period_energy(df: DataFrame, keys: list[str], t: str, value: str, periods: list[float]) -> DataFrame:
    """``(keys, period, energy)``: squared mean products of the value with a cosine and a sine of each trial period."""
    angle = [F.lit(2 * math.pi / p) * F.col(t) for p in periods]
    sums = [F.struct(F.lit(float(p)).alias("period"), (F.pow(F.avg(F.col(value) * F.cos(a)), 2) + F.pow(F.avg(F.col(value) * F.sin(a)), 2)).alias("energy")) for p, a in zip(periods, angle, strict=True)]
    return df.groupBy(*keys).agg(F.array(*sums).alias("_p")).select(*keys, F.inline("_p"))


def sigma_median(df: DataFrame, keys: list[str], layer: str, value: str) -> DataFrame:
    """``(keys, sigma)``: at which share of evenly spaced layers, in order, half of the sum of a layered value lies, linear within a layer."""
    w, every = Window.partitionBy(*keys).orderBy(layer), Window.partitionBy(*keys)
    s = df.withColumns({"_c": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum(value).over(every), "_n": F.count("*").over(every), "_i": F.row_number().over(w)})
    share = (F.col("_i") - (F.col("_c") - F.col("_t") / 2) / F.nullif(F.col(value), F.lit(0))) / F.col("_n")
    return s.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min_by(share, "_i").alias("sigma"))


def mean_time(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``(keys, mean_ts)``, to the microsecond below."""
    total = F.sum(micros(F.col(ts)).cast("decimal(38,0)"))  # a sum of many times exceeds 64 bits
    return df.groupBy(*keys).agg(from_micros(F.floor(total / F.count(ts))).alias("mean_ts"))


def nan_rms(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, rms)`` over values that are neither null nor not a number."""
    return rms(df.where(~F.isnan(F.col(value).cast("double"))), keys, value)


def combine_sources(sources: dict[str, DataFrame], seconds: int, common: bool = True, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(source, bin, mean)``: means of several series in the same bins, see ``temporal.bin_mean``, over the period that all share, or that any covers.

    Only samples in the period count, its ends included.
    """
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), F.col(ts).alias("ts"), F.col(value).alias("value")) for name, df in sources.items()])
    if common:
        spans = period(every, "source", "ts")  # one row
        every = every.join(F.broadcast(spans), F.col("ts").between(F.col("shared_start"), F.col("shared_end"))).select("source", "ts", "value")
    return bin_mean(every, ["source"], seconds)


def kernel_density(df: DataFrame, points: list[float], value: str, weight: str, width: float) -> DataFrame:
    """``(at, density)``: a sum of Gaussians of ``width`` around values, by weight, at the given points; the weights sum to 1 first."""
    each = F.array(*(F.struct(F.lit(float(p)).alias("at"), (F.exp(-0.5 * F.pow((F.lit(float(p)) - F.col(value)) / width, 2)) * F.col(weight)).alias("g")) for p in points))
    s = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(F.col(weight).alias("w"), F.inline(each))
    return s.groupBy("at").agg((F.sum("g") / F.sum("w") / (width * math.sqrt(2 * math.pi))).alias("density"))


def bandwidth(df: DataFrame, value: str, weight: str, rule: str = "scott") -> DataFrame:
    """``(n_effective, spread, width)``: of a weighted sample, (sum w) ** 2 / sum w ** 2, its unbiased deviation, and Scott's or Silverman's width in one dimension."""
    if rule not in ("scott", "silverman"):
        raise ValueError("rule is scott or silverman")
    mean = df.agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("_m"))
    off = F.col(value).cast("double") - F.col("_m")  # squares of large values would cancel
    sums = joined(df, mean, []).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(weight)).alias("w2"), F.sum(F.col(weight) * off).alias("s"), F.sum(F.col(weight) * off * off).alias("q"))
    n = F.col("w") * F.col("w") / F.col("w2")
    spread = F.sqrt((F.col("q") / F.col("w") - F.pow(F.col("s") / F.col("w"), 2)) / (1 - 1 / n))
    factor = F.pow(n, -0.2) if rule == "scott" else F.pow(n * 3 / 4, -0.2)
    return sums.select(n.alias("n_effective"), spread.alias("spread"), (spread * factor).alias("width"))


def bootstrap(df: DataFrame, key: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, mean, variance)`` of resamples with replacement: each row counts a Poisson number of times, mean 1, by a hash of its key.

    So a resample takes no shuffle of rows, its size is that of the table on average, and reruns agree.
    """
    u = (F.pmod(F.xxhash64(F.col("_key"), F.col("replicate"), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    upto, total, count = math.exp(-1), 0.0, F.lit(0)
    for k in range(20):
        total += upto
        upto /= k + 1
        count = count + F.when(u > total, 1).otherwise(0)
    held = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("v"))
    held = joined(held, held.agg(F.avg("v").alias("_m")), []).withColumn("v", F.col("v") - F.col("_m"))  # squares of large values would cancel
    s = held.select("_key", "v", "_m", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("c", count)
    sums = s.groupBy("replicate").agg(F.max("_m").alias("m"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("a"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("q"))
    return sums.select("replicate", (F.col("m") + F.col("a") / F.col("n")).alias("mean"), (F.col("q") / F.col("n") - F.pow(F.col("a") / F.col("n"), 2)).alias("variance"))


def rotated_to_principal(df: DataFrame, keys: list[str], u: str, v: str, near: float | None = None) -> DataFrame:
    """``df`` with ``along`` and ``across`` the direction of greatest variance of each series; of its two senses that nearer to the angle ``near``."""
    theta = principal_theta(df, keys, u, v)
    if near is not None:
        off = F.abs(F.pmod(F.col("theta") - near + math.pi, F.lit(2 * math.pi)) - math.pi)
        theta = theta.withColumn("theta", F.when(off > math.pi / 2, F.pmod(F.col("theta") + math.pi, F.lit(2 * math.pi))).otherwise(F.col("theta")))
    s = joined(df, theta, keys)
    c, d = F.cos("theta"), F.sin("theta")
    return s.withColumns({"along": c * F.col(u) + d * F.col(v), "across": c * F.col(v) - d * F.col(u)})


def autocorrelation(df: DataFrame, keys: list[str], index: str, value: str, max_lag: int) -> DataFrame:
    """``(keys, lag, r, n)``: correlation of values ``lag`` apart with each other, over the pairs of each lag alone."""
    later = df.select(*keys, F.col(index).alias("_j"), F.col(value).alias("_b"))
    now = df.select(*keys, F.col(value).alias("_a"), F.col(index).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("_j", F.col("_i") + F.col("lag"))
    return now.join(later, [*keys, "_j"]).where("_a is not null and _b is not null").groupBy(*keys, "lag").agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))


def windowed_median(df: DataFrame, keys: list[str], value: str, window: float) -> DataFrame:
    """``(keys, median)`` of the values within ``window`` of the median of all."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return joined(df, mid, keys).where(F.abs(F.col(value) - F.col("_m")) <= window).groupBy(*keys).agg(F.median(value).alias("median"))
