"""Irregular series: bins, nearest and interpolating joins, gaps, windows by sign.

A series is rows of keys, a time and a value.  Every window is partitioned by the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.time import from_micros, micros
from fathomline.operators.keyed import joined


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def bin_mean(df: DataFrame, keys: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(keys, bin, mean)``: means over bins of ``seconds`` from 1970 on.

    A bin holds the times after its left edge up to and with its right edge, and has the left edge's name.
    """
    step = seconds * 1_000_000
    left = from_micros((F.ceil(micros(F.col(ts)) / step) - 1) * step)
    return df.groupBy(*keys, left.alias("bin")).agg(F.avg(value).alias("mean"))


def period(df: DataFrame, source: str, ts: str = "ts") -> DataFrame:
    """One row: the time that all sources share and the time that any covers."""
    each = df.groupBy(source).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return each.agg(F.max("a").alias("shared_start"), F.min("b").alias("shared_end"), F.min("a").alias("any_start"), F.max("b").alias("any_end"))


def remove_repeated(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Without rows whose value equals the one before."""
    was = F.lag(F.struct(value)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_was", was).where(F.col("_was").isNull() | ~F.struct(value).eqNullSafe(F.col("_was"))).drop("_was")


def select_increasing(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds every value before it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(value).over(before)
    return df.withColumn("_top", top).where(F.col(value).isNotNull() & (F.col("_top").isNull() | (F.col(value) > F.col("_top")))).drop("_top")


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """``left`` with the right series' last sample at or before its time (``t0, v0``) and first at or after (``t1, v1``).

    Both tables are united and two windows carry the samples, so the cost is one shuffle and two sorts by key,
    linear in the length of a series.
    Of right samples of one time the largest value counts.
    """
    one = right.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias("_v"))
    mine = left.select(*keys, F.col(ts), F.struct(*left.columns).alias("_row"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    other = one.select(*keys, F.col(ts), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), "_v", F.lit(0).alias("_side"))
    both = mine.unionByName(other).withColumn("_s", F.when(F.col("_side") == 0, F.struct(F.col(ts).alias("t"), F.col("_v").alias("v"))))
    w = Window.partitionBy(*keys).orderBy(ts)
    past = F.last("_s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    # Looking back from the other end: a frame that ends at the series' end would be read anew from each row.
    back = Window.partitionBy(*keys).orderBy(F.col(ts).desc()).rangeBetween(Window.unboundedPreceding, 0)
    ahead = F.last("_s", ignorenulls=True).over(back)
    out = both.withColumn("_p", past).withColumn("_a", ahead).where("_side = 1")
    return out.select("_row.*", F.col("_p.t").alias("t0"), F.col("_p.v").alias("v0"), F.col("_a.t").alias("t1"), F.col("_a.v").alias("v1"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], max_seconds: float | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """``left`` with ``near_ts, near_value``: the right sample nearest in time, the later of two as near."""
    found = asof(left, right, keys, ts, value)
    back, ahead = micros(F.col(ts)) - micros(F.col("t0")), micros(F.col("t1")) - micros(F.col(ts))
    later = F.col("t1").isNotNull() & (F.col("t0").isNull() | (ahead <= back))
    far = F.lit(False) if max_seconds is None else F.when(later, ahead).otherwise(back) > max_seconds * 1e6
    pick = lambda a, b: F.when(~far, F.when(later, F.col(a)).otherwise(F.col(b)))
    return found.withColumns({"near_ts": pick("t1", "t0"), "near_value": pick("v1", "v0")}).drop("t0", "v0", "t1", "v1")


def interp_near(left: DataFrame, right: DataFrame, keys: list[str], max_seconds: float | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """``left`` with ``interp``: the right series at its time, linear between samples and constant beyond them.

    Null where the nearest sample is more than ``max_seconds`` away.
    """
    found = asof(left, right, keys, ts, value)
    back, ahead = micros(F.col(ts)) - micros(F.col("t0")), micros(F.col("t1")) - micros(F.col(ts))
    mid = F.when(back + ahead == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * back / F.nullif(back + ahead, F.lit(0)))
    at = F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(mid)
    if max_seconds is not None:
        at = F.when(F.least(F.coalesce(back, ahead), F.coalesce(ahead, back)) <= max_seconds * 1e6, at)
    return found.withColumn("interp", at).drop("t0", "v0", "t1", "v1")


def fill_invalid(df: DataFrame, keys: list[str], order: list[str], value: str, into: str = "filled", ends: str = "constant") -> DataFrame:
    """``df`` with null values interpolated by position between their neighbours.

    Beyond the first and last value they are constant, or with ``ends='linear'`` on the line through both.
    """
    if ends not in ("constant", "linear"):
        raise ValueError("ends is constant or linear")
    w = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_s", F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))))
    df = df.withColumn("_p", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last("_s", True).over(back))
    mid = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / F.nullif(F.col("_n.i") - F.col("_p.i"), F.lit(0))
    if ends == "linear":
        every = Window.partitionBy(*keys)
        a, b = F.min("_s").over(every), F.max("_s").over(every)
        df = df.withColumns({"_a": a, "_b": b})
        line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / F.nullif(F.col("_b.i") - F.col("_a.i"), F.lit(0))
        mid = F.coalesce(mid, line)
    return df.withColumn(into, F.coalesce(value, mid, F.col("_p.v"), F.col("_n.v"))).drop("_i", "_s", "_p", "_n", "_a", "_b")


def forward_fill(df: DataFrame, keys: list[str], value: str, days: float = 30, ts: str = "ts", into: str = "filled") -> DataFrame:
    """The last value at most ``days`` before a row without one."""
    df = df.withColumn("_u", micros(F.col(ts)))
    w = Window.partitionBy(*keys).orderBy("_u").rangeBetween(-int(days * 86_400_000_000), 0)
    return df.withColumn(into, F.last(value, True).over(w)).drop("_u")


def cdiff(df: DataFrame, keys: list[str], order: list[str], value: str, into: str = "cdiff") -> DataFrame:
    """The next value less this one; the next of the last is the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn(into, F.when(last, F.first(value).over(whole)).otherwise(F.lead(value).over(w)) - F.col(value))


def deriv(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``(keys, x_mid, slope)`` between neighbours in x."""
    w = Window.partitionBy(*keys).orderBy(x)
    out = df.select(*keys, ((F.col(x) + F.lead(x).over(w)) / 2).alias("x_mid"), ((F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))).alias("slope"))
    return out.where("x_mid is not null")


def center_to_interval(df: DataFrame, keys: list[str], x: str, into: str = "width") -> DataFrame:
    """Widths of intervals around sorted centres; the ends take their neighbour's."""
    w = Window.partitionBy(*keys).orderBy(x)
    df = df.withColumn("_w", (F.lead(x).over(w) - F.lag(x).over(w)) / 2)
    return df.withColumn(into, F.coalesce("_w", F.lead("_w").over(w), F.lag("_w").over(w), F.lead(x).over(w) - F.col(x), F.col(x) - F.lag(x).over(w))).drop("_w")


def center_to_edge(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``(keys, place, edge)``: the n + 1 edges between and beyond n sorted centres."""
    w = Window.partitionBy(*keys).orderBy(x)
    right = F.coalesce((F.col(x) + F.lead(x).over(w)) / 2, F.col(x) + (F.col(x) - F.lag(x).over(w)) / 2)
    left = F.when(F.lag(x).over(w).isNull(), F.col(x) - (F.lead(x).over(w) - F.col(x)) / 2)
    df = df.select(*keys, F.row_number().over(w).alias("_i"), left.alias("_l"), right.alias("_r"))
    first = df.where("_l is not null").select(*keys, (F.col("_i") - 1).alias("place"), F.col("_l").alias("edge"))
    return first.unionByName(df.select(*keys, F.col("_i").alias("place"), F.col("_r").alias("edge")))


def quantize(df: DataFrame, keys: list[str], order: list[str], value: str, stride: int) -> DataFrame:
    """``(keys, block, mean)`` of each ``stride`` rows in order; a short last block is dropped."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = df.withColumn("block", F.floor(i / stride)).groupBy(*keys, "block").agg(F.avg(value).alias("mean"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == stride).drop("_n")


def sign_windows(df: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 0.0, ts: str = "ts") -> DataFrame:
    """``(keys, sign, start, end, n)``: stretches above ``high`` and below ``low``; values between keep the sign before."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("_s", F.last(F.when(F.col(value) > high, 1).when(F.col(value) < low, -1), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_s is not null")
    df = df.withColumn("_new", F.when(F.lag("_s").over(w).eqNullSafe(F.col("_s")), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return df.groupBy(*keys, "_g").agg(F.first("_s").alias("sign"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("_g")


def slack_times(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """``(keys, slack, rising)``: the times at which the value crosses zero, linear between samples."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.select(*keys, micros(F.col(ts)).alias("t"), F.col(value).alias("v"), F.lead(micros(F.col(ts))).over(w).alias("t1"), F.lead(value).over(w).alias("v1"))
    df = df.where("v * v1 < 0 or (v = 0 and v1 <> 0)")
    return df.select(*keys, from_micros(F.round(F.col("t") - F.col("v") * (F.col("t1") - F.col("t")) / (F.col("v1") - F.col("v")))).alias("slack"), (F.col("v1") > F.col("v")).alias("rising"))


def dist_along(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, into: str = "along") -> DataFrame:
    """Path length up to each point."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return df.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn(into, F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def gap_sessions(df: DataFrame, keys: list[str], gap_seconds: float, ts: str = "ts") -> DataFrame:
    """``(keys, start, end, n)``: stretches without a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = F.when(micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w) <= gap_seconds * 1e6, 0).otherwise(1)
    df = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return df.groupBy(*keys, "_g").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("_g")


def dice_interval(df: DataFrame, start: str, end: str, seconds: float, overlap: float = 0.0) -> DataFrame:
    """``df`` with a row for each of the equal windows, at least ``seconds`` wide, that cover start to end with an overlap.

    There are as many as fit; a span shorter than one window is one window unless it falls short by an advance or more, which has none.
    """
    a, b = micros(F.col(start)), micros(F.col(end))
    n = 1 + ((b - a - seconds * 1e6) / (seconds * 1e6 * (1 - overlap))).cast("int")
    width = (b - a) / (n * (1 - overlap) + overlap)
    df = df.where(n >= 1).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    return df.withColumn("window_start", from_micros(F.round(a + F.col("_k") * width * (1 - overlap)))).withColumn("window_end", from_micros(F.round(a + F.col("_k") * width * (1 - overlap) + width))).drop("_k")


def lagged(df: DataFrame, seconds: float, ts: str = "ts") -> DataFrame:
    """The series that many seconds later."""
    return df.withColumn(ts, from_micros(micros(F.col(ts)) + int(seconds * 1e6)))


def increasing_times(df: DataFrame, keys: list[str], arrived: list[str], ts: str = "ts") -> DataFrame:
    """Rows, in order of arrival, later than every one before: what requests that overlap have in common counts once."""
    return select_increasing(df, keys, arrived, ts)


def shifted(df: DataFrame, value: str, amplify: float = 1.0, delay_seconds: float = 0.0, offset: float = 0.0, centre: float = 0.0, ts: str = "ts") -> DataFrame:
    """The series that many seconds later, stretched about ``centre`` and raised by ``offset``."""
    return lagged(df, delay_seconds, ts).withColumn(value, (F.col(value) - centre) * amplify + centre + offset)


def weighted_sum(series: dict[str, DataFrame], weights: dict[str, float], ts: str = "ts", value: str = "value") -> DataFrame:
    """``(ts, value)``: the sum of several series by weight; a time that one lacks is an error, as are repeated ones."""
    each = [df.select(F.col(ts).alias("ts"), (F.col(value) * float(weights[n])).alias("v")) for n, df in series.items()]
    both = each[0]
    for df in each[1:]:
        both = both.unionByName(df)
    lacks = F.raise_error(F.concat_ws(" ", F.lit("not all series have one value at"), F.col("ts").cast("string"))).cast("double")
    return both.groupBy("ts").agg(F.when(F.count("*") == len(each), F.sum("v")).otherwise(lacks).alias("value")).select(F.col("ts").alias(ts), F.col("value").alias(value))


def merged_gages(first: DataFrame, second: DataFrame, keys: list[str], amplify: float = 1.0, delay_seconds: float = 0.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(keys, ts, value)``: the first series, and where it has no value that of the second, shifted and stretched."""
    own = first.select(*keys, ts, F.col(value).alias("_a"))
    other = shifted(second, value, amplify, delay_seconds, ts=ts).select(*keys, ts, F.col(value).alias("_b"))
    return joined(own, other, [*keys, ts], "full").select(*keys, ts, F.coalesce("_a", "_b").alias(value))


def padded_time(df: DataFrame, keys: list[str], seconds: float, ts: str = "ts") -> DataFrame:
    """``df`` with its first row earlier and its last later by ``seconds``, values as they are."""
    w, us = Window.partitionBy(*keys), micros(F.col(ts))
    at = us - F.when(us == F.min(us).over(w), int(seconds * 1e6)).otherwise(0) + F.when(us == F.max(us).over(w), int(seconds * 1e6)).otherwise(0)
    return df.withColumn(ts, from_micros(at))


def regular(df: DataFrame, keys: list[str], seconds: float, value: str, longest: float | None = None, ts: str = "ts") -> DataFrame:
    """``(keys, ts, value)`` each ``seconds`` from the first to the last sample, linear between samples; a gap of over ``longest`` seconds is an error."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = int(seconds * 1e6)
    s = df.where(F.col(value).isNotNull()).select(*keys, micros(F.col(ts)).alias("_t"), F.col(value).cast("double").alias("_v"), micros(F.lead(ts).over(w)).alias("_n"), F.lead(value).over(w).cast("double").alias("_w"), F.min(micros(F.col(ts))).over(Window.partitionBy(*keys)).alias("_z"))
    gap = F.col("_n") - F.col("_t")
    if longest is not None:
        s = s.withColumn("_n", F.when(gap > longest * 1e6, F.raise_error(F.lit("a gap of the series is too long")).cast("bigint")).otherwise(F.col("_n")))
    first = F.ceil((F.col("_t") - F.col("_z")) / step)
    last = F.when(F.col("_n").isNull(), F.floor((F.col("_t") - F.col("_z")) / step)).otherwise(F.ceil((F.col("_n") - F.col("_z")) / step) - 1)
    s = s.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("_k")).withColumn("_at", F.col("_z") + F.col("_k") * step)
    at = F.when(F.col("_n").isNull(), F.col("_v")).otherwise(F.col("_v") + (F.col("_w") - F.col("_v")) * (F.col("_at") - F.col("_t")) / F.nullif(F.col("_n") - F.col("_t"), F.lit(0)))
    return s.select(*keys, from_micros(F.col("_at")).alias(ts), at.alias(value))


def release_log(df: DataFrame, time: str, ids: list[str]) -> DataFrame:
    """``(time, count, id_min, id_max ...)``: for each release time how many particles and the range of each of ``ids``."""
    return df.groupBy(time).agg(F.count("*").alias("count"), *(f(c).alias(f"{c}_{n}") for c in ids for f, n in ((F.min, "min"), (F.max, "max"))))


def downcasts(df: DataFrame, keys: list[str], order: str, z: str, surface: float, least: int = 10) -> DataFrame:
    """``(keys, cast, start, end, n)``: runs of samples that sink below ``surface``, more than ``least`` long; runs that touch an end of the series are partial and left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = df.withColumn("_d", F.coalesce((F.lead(z).over(w) - F.col(z) < 0) & (F.col(z) < surface), F.lit(False)))
    s = s.withColumns({"_new": F.when(F.lag("_d").over(w).eqNullSafe(F.col("_d")), 0).otherwise(1), "_end": F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull()})
    s = s.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_d")
    runs = s.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), F.max("_end").alias("_e")).where((F.col("n") > least) & ~F.col("_e"))
    return runs.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).alias("cast"), "start", "end", "n")
