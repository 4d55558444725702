"""Tidal analysis: constituents, datums, slack water, tidal hours and gap filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.time import from_micros, micros
from fathomline.operators import filters, temporal

# The constituents of published harmonic data, in their order of rank, and their speeds in degrees an hour.
SPEEDS = {
    "M2": 28.984104, "S2": 30.0, "N2": 28.43973, "K1": 15.041069, "M4": 57.96821, "O1": 13.943035, "M6": 86.95232, "MK3": 44.025173, "S4": 60.0, "MN4": 57.423832,
    "NU2": 28.512583, "S6": 90.0, "MU2": 27.968208, "2N2": 27.895355, "OO1": 16.139101, "LAM2": 29.455626, "S1": 15.0, "M1": 14.496694, "J1": 15.5854435, "MM": 0.5443747,
    "SSA": 0.0821373, "SA": 0.0410686, "MSF": 1.0158958, "MF": 1.0980331, "RHO": 13.471515, "Q1": 13.398661, "T2": 29.958933, "R2": 30.041067, "2Q1": 12.854286, "P1": 14.958931,
    "2SM2": 31.015896, "M3": 43.47616, "L2": 29.528479, "2MK3": 42.92714, "K2": 30.082138, "M8": 115.93642, "MS4": 58.984104,
}
#: Minutes of an M2 period; a lunar month is taken as 57 of them.
M2_MINUTES, M2_A_MONTH = 12.42 * 60, 57


def names_to_omegas(names: list[str]) -> list[float]:
    """Angular frequencies, in radians a second, of named constituents."""
    return [math.radians(SPEEDS[n]) / 3600 for n in names]


def omegas_to_names(omegas: list[float]) -> list[str]:
    """The constituent nearest in speed to each frequency; DC for none."""
    speed = {n: o for n, o in zip(SPEEDS, names_to_omegas(list(SPEEDS)), strict=True)}
    return [min(speed, key=lambda n: abs(speed[n] - o)) if o > 0 else "DC" for o in omegas]


def named_omegas(df: DataFrame, omega: str = "omega", into: str = "constituent") -> DataFrame:
    """``df`` with the name of the constituent nearest to each frequency."""
    speed = zip(SPEEDS, names_to_omegas(list(SPEEDS)), strict=True)
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(omega) - o).alias("d"), F.lit(k).alias("k")) for k, (_, o) in enumerate(speed))))
    return df.withColumn(into, F.when(F.col(omega) > 0, F.element_at(F.array(*map(F.lit, SPEEDS)), near["k"] + 1)).otherwise("DC"))


def select_omegas(seconds: float, omegas: list[float] | None = None, factor: float = 0.25) -> list[float]:
    """Of frequencies in order of rank those that a series of so many seconds can tell apart, from small to large.

    As long as two neighbours, or the lowest and 0, beat slower than ``factor`` periods in the series, the one of lower rank
    of the two nearest goes.
    """
    omegas = names_to_omegas(list(SPEEDS)) if omegas is None else list(omegas)
    rank = {o: k for k, o in reversed(list(enumerate(omegas)))}
    left = [0.0, *sorted(omegas)]
    while len(left) > 1:
        beats = [b - a for a, b in zip(left[:-1], left[1:], strict=True)]
        k = min(range(len(beats)), key=beats.__getitem__)
        if beats[k] >= factor * 2 * math.pi / seconds:
            break
        del left[k + 1 if k == 0 or rank[left[k]] < rank[left[k + 1]] else k]
    return left[1:]


def tidal_datum(df: DataFrame, keys: list[str], value: str, stat: str, daily: bool = False, ts: str = "ts") -> DataFrame:
    """``(keys, datum)``: mean of the lowest (``min``) or highest (``max``) value of each M2 period, or with ``daily`` of each pair of them.

    Samples are evenly spaced.  Periods are counted from the sample before the first crossing of the mean, and
    whole months of 57 periods count.  A series without a crossing or a whole month has no row.
    """
    if stat not in ("min", "max"):
        raise ValueError("stat is min or max")
    w, every = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys)
    s = df.select(*keys, micros(F.col(ts)).alias("_t"), F.col(value).alias("_v"), (F.row_number().over(w) - 1).alias("_i"), (micros(F.lead(ts).over(w)) - micros(F.col(ts))).alias("_d"))
    s = s.withColumn("_h", F.col("_v") - F.avg("_v").over(every))
    w = Window.partitionBy(*keys).orderBy("_i")
    cross = F.when(F.col("_h") * F.lead("_h").over(w) < 0, F.col("_i"))
    s = s.withColumn("_x", cross)
    facts = s.groupBy(*keys).agg(F.median("_d").alias("_dt"), F.min("_x").alias("_i0"), F.max("_t").alias("_end"), F.min_by("_t", F.when(F.col("_x").isNotNull(), F.col("_i"))).alias("_t0"))
    facts = facts.select(*keys, "_i0", (M2_MINUTES * 60e6 / F.col("_dt")).alias("_n"), F.floor((F.col("_end") - F.col("_t0")) / (M2_MINUTES * M2_A_MONTH * 60e6)).alias("_months"))
    both = s.join(facts, keys) if keys else s.join(F.broadcast(facts))
    past = F.col("_i") - F.col("_i0")
    k = F.floor(past / F.col("_n"))
    edge = lambda k: F.bround(k * F.col("_n"), 0)
    k = F.when(past >= edge(k + 1), k + 1).when(past < edge(k), k - 1).otherwise(k)
    both = both.where(past >= 0).withColumn("_k", k).where((F.col("_k") >= 0) & (F.col("_k") < M2_A_MONTH * F.col("_months")))
    f = F.min if stat == "min" else F.max
    each = both.groupBy(*keys, "_k", "_months").agg(f("_v").alias("_v"))
    if daily:  # an odd last period has no partner
        paired = (M2_A_MONTH * F.col("_months") % 2 == 0) | (F.col("_k") < M2_A_MONTH * F.col("_months") - 1)
        each = each.where(paired).groupBy(*keys, F.floor(F.col("_k") / 2).alias("_k")).agg(f("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.avg("_v").alias("datum"))


def detided(df: DataFrame, keys: list[str], value: str, step_hours: float, leave_mean: bool = False, ts: str = "ts", into: str = "smooth") -> DataFrame:
    """``df`` with the value smoothed over about two hours, less its mean over about 33 unless ``leave_mean``; gaps are filled by position."""
    out = filters.fir(df, keys, [ts], value, int(1 + round(2 / step_hours)), into=into)
    if not leave_mean:
        out = filters.fir(out, keys, [ts], into, int(1 + round(33 / step_hours)), into="_slow").withColumn(into, F.col(into) - F.col("_slow")).drop("_slow")
    return temporal.fill_invalid(out, keys, [ts], into, into)


def slack_water(df: DataFrame, keys: list[str], value: str, step_hours: float, leave_mean: bool = False, ts: str = "ts") -> DataFrame:
    """``(keys, slack, rising, nth)``: when a smoothed current turns, linear between samples; ``nth`` counts from 0."""
    s = detided(df, keys, value, step_hours, leave_mean, ts)
    w = Window.partitionBy(*keys).orderBy(ts)
    s = s.select(*keys, micros(F.col(ts)).alias("_t"), F.col("smooth").alias("_u"), F.lead("smooth").over(w).alias("_v"))
    turn = s.where("(_u <= 0 and _v > 0) or (_u > 0 and _v <= 0)")
    at = from_micros(F.round(F.col("_t") - F.col("_u") / (F.col("_v") - F.col("_u")) * step_hours * 3.6e9))
    turn = turn.select(*keys, at.alias("slack"), (F.col("_v") > 0).alias("rising"))
    return turn.withColumn("nth", (F.row_number().over(Window.partitionBy(*keys).orderBy("slack")) - 1).cast("long"))


def phases(slacks: DataFrame, keys: list[str], which: str = "ebb") -> DataFrame:
    """``(keys, start, end)`` of each whole ebb or flood between two slack waters."""
    if which not in ("ebb", "flood"):
        raise ValueError("which is ebb or flood")
    w = Window.partitionBy(*keys).orderBy("slack")
    out = slacks.withColumn("end", F.lead("slack").over(w)).where(F.col("rising") == (which == "flood")).where(F.col("end").isNotNull())
    return out.select(*keys, F.col("slack").alias("start"), "end")


def tidal_hour(df: DataFrame, slacks: DataFrame, keys: list[str], ts: str = "ts", into: str = "hour") -> DataFrame:
    """``df`` with hours from 0 to 12 of the tide: 0 at the slack before ebb, 6 at that before flood, linear between them.

    Before the first and after the last slack water it stays next to that hour.
    """
    every = Window.partitionBy(*keys)
    first = slacks.withColumn("_n", F.count("*").over(every)).withColumn("_up", F.min_by("rising", "nth").over(every))
    right = first.select(*keys, F.col("slack").alias(ts), F.struct("nth", "_n", "_up").alias("_s"))
    found = temporal.asof(df, right, keys, ts, "_s")
    back, span = micros(F.col(ts)) - micros(F.col("t0")), micros(F.col("t1")) - micros(F.col("t0"))
    at = F.col("v0.nth") * 6 + F.when(span > 0, 6 * back / span).otherwise(0)
    at = F.when(F.col("t0").isNull(), -0.01).when(F.col("t1").isNull(), (F.col("v0._n") - 1) * 6 + 0.01).otherwise(at)
    up = F.coalesce(F.col("v0._up"), F.col("v1._up"))
    return found.withColumn(into, F.pmod(at + F.when(up, 6).otherwise(0), F.lit(12.0))).drop("t0", "v0", "t1", "v1")


def dense(df: DataFrame, keys: list[str], value: str, seconds: float, ts: str = "ts") -> DataFrame:
    """``df``'s keys, times and values, and a row without value each ``seconds`` in gaps of more than one and a half of them."""
    w = Window.partitionBy(*keys).orderBy(ts)
    step = int(seconds * 1e6)
    s = df.select(*keys, micros(F.col(ts)).alias("_t"), F.col(value).alias(value), micros(F.lead(ts).over(w)).alias("_n"))
    end = F.when(F.col("_n") - F.col("_t") > 1.5 * step, F.col("_n") - 1).otherwise(F.col("_t"))
    s = s.select("*", F.explode(F.sequence(F.col("_t"), end, F.lit(step))).alias("_at"))
    return s.select(*keys, from_micros(F.col("_at")).alias(ts), F.when(F.col("_at") == F.col("_t"), F.col(value)).alias(value))


def filled_tide(df: DataFrame, keys: list[str], value: str, seconds: float, omegas: list[float], days: float = 5.0, ts: str = "ts") -> DataFrame:
    """``(keys, ts, value)`` without gaps: where a sample lacks, a slow part, filled by position, and a tide that fits the rest.

    The slow part is a mean of ``days``; ``omegas`` (radians a second) are those that the series' length can tell apart,
    see ``select_omegas``.
    """
    s = filters.fir(dense(df, keys, value, seconds, ts), keys, [ts], value, int(days * 86400 / seconds), into="_slow")
    s = s.withColumn("_x", micros(F.col(ts)) / 1e6).withColumn("_fast", F.col(value) - F.col("_slow"))
    comps = filters.decompose(s, keys, "_x", "_fast", omegas)
    s = filters.recompose(temporal.fill_invalid(s, keys, [ts], "_slow", "_slow"), comps, keys, "_x", "_tide")
    return s.select(*keys, ts, F.coalesce(F.col(value), F.col("_slow") + F.col("_tide")).alias(value))


def harmonic_stage(df: DataFrame, constituents: list[tuple[str, float, float]], ts: str = "ts", mean: float = 0.0, into: str = "stage") -> DataFrame:
    """``df`` with a mean and the sum of ``(name, amplitude, phase in degrees)`` waves, phases counted from 1970."""
    wave: Column = F.lit(float(mean))
    for (_, amplitude, phase), omega in zip(constituents, names_to_omegas([c[0] for c in constituents]), strict=True):
        wave = wave + amplitude * F.cos(omega * (micros(F.col(ts)) / 1e6) - math.radians(phase))
    return df.withColumn(into, wave)
