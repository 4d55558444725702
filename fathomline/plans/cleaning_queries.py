"""Cleaning of series over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.time import from_micros, micros
from fathomline.operators import cleaning
from fathomline.plans.series_queries import events, r6


def sentences(s: SparkSession, d: str) -> DataFrame:
    """Events of a user as a ship's sentences: purchases fix a place, views name an ensemble, clicks a time."""
    e, kind = events(s, d), F.col("event_type")
    return e.select("user_id", "event_id", (kind == "purchase").alias("fix"), F.when(kind == "view", F.col("event_id")).alias("ens"), F.when(kind == "click", micros(F.col("ts")) / 1e6).alias("gps"), F.col("value").alias("lat"))


def fixed(s: SparkSession, d: str) -> DataFrame:
    return cleaning.fixes(sentences(s, d), ["user_id"], ["event_id"], "fix", "ens", "gps")


def placed(s: SparkSession, d: str) -> DataFrame:
    """Every event as an ensemble on the line between the fixes of its user; a billionth is added so that no sixth digit is a tie."""
    e = events(s, d).select("user_id", F.col("event_id").alias("ens"))
    return r6(cleaning.positioned(e, fixed(s, d), ["user_id"], ["event_id"], "ens", ["lat"]).withColumn("lat", F.col("lat") + 1e-9), "lat")


def clocks(s: SparkSession, d: str) -> DataFrame:
    """Events whose clock is some hours and up to 20 minutes off, by type."""
    e = events(s, d)
    wrong = from_micros(micros(F.col("ts")) + (F.length("event_type") * 3600 + F.col("event_id") % 1200) * 1_000_000)
    return cleaning.hours_set(e.select("event_id", "event_type", wrong.alias("clock"), "ts"), ["event_type"], "clock", "ts").select("event_id", "set")


_FIXES = """g as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) - case when event_type = 'purchase' then 1 else 0 end as g from events),
f as (select user_id, max(case when event_type = 'purchase' then event_id end) as event_id, max(case when event_type = 'view' then event_id end) as ens,
    arg_max(epoch_us(ts) / 1e6, event_id) filter (event_type = 'click') as gps, max(case when event_type = 'purchase' then value end) as lat, bool_or(event_type = 'purchase') as ok from g group by user_id, g)"""

Q = {
    "in_water": (
        lambda s, d: cleaning.in_water(events(s, d), ["user_id"], "event_id", "value").select("user_id", "event_id", "value"),
        """with m as (select user_id, median(value) as m, stddev_pop(value) as s from events group by 1),
        e as (select user_id, min(event_id) as a, max(event_id) as b from events join m using (user_id) where abs(value - m) < 0.5 * s group by 1)
        select user_id, event_id, value from events join e using (user_id) where event_id >= a and event_id < b""",
    ),
    "without_spike": (
        lambda s, d: cleaning.without_spikes(events(s, d), ["user_id"], ["event_id"], "value", threshold=2.0).select("user_id", "event_id", "clean"),
        """with d as (select user_id, event_id, value, (lead(value) over w - value) - (value - lag(value) over w) as d from events window w as (partition by user_id order by event_id)),
        k as (select *, stddev_pop(d) over (partition by user_id) as s, row_number() over (partition by user_id order by abs(d) desc nulls last, event_id) as k from d)
        select user_id, event_id, case when k = 1 and abs(d) > 2.0 * s then null else value end as clean from k""",
    ),
    "fixes": (
        lambda s, d: r6(fixed(s, d), "gps").select("user_id", "event_id", "ens", "gps", "lat"),
        f"with {_FIXES} select user_id, event_id, ens, round(gps, 6) as gps, lat from f where ok",
    ),
    "positioned": (
        placed,
        f"""with {_FIXES}, k as (select user_id, ens, cast(lat as double) as lat from f where ok and ens is not null),
        p as (select e.user_id, e.event_id as ens, k.ens as x0, k.lat as v0 from events e asof left join k on e.user_id = k.user_id and e.event_id >= k.ens),
        n as (select p.*, k.ens as x1, k.lat as v1 from p asof left join k on p.user_id = k.user_id and p.ens <= k.ens)
        select user_id, ens, round(case when x0 = x1 then v0 else v0 + (v1 - v0) * (ens - x0) / (x1 - x0) end + 1e-9, 6) as lat from n""",
    ),
    "hours_set": (
        clocks,
        """with c as (select event_id, event_type, epoch_us(ts) as t, epoch_us(ts) + (length(event_type) * 3600 + event_id % 1200) * 1000000 as u from events),
        m as (select event_type, cast(round_even(median((t - u) / 3600000000.0), 0) as bigint) as h from c group by 1)
        select event_id, make_timestamp(u + h * 3600000000) as set from c join m using (event_type)""",
    ),
}
