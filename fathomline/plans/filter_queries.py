"""Filters and harmonic analysis over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import time as T
from fathomline.operators import filters as L
from fathomline.plans.series_queries import events, r6

ORDER = ["ts", "event_id"]
DAILY = 2 * math.pi


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("t", T.to_dnum(F.col("ts")) - 19723)


def harmonic_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values less the daily wave that fits their event type best."""
    series = _timed(spark, sf_dir)
    found = L.recompose(series, L.decompose(series, ["event_type"], "t", "value", [DAILY]), ["event_type"], "t")
    return r6(found.select("event_id", (F.col("value") - F.col("level")).alias("residual")), "residual")


_FIT = f"""e as (select event_id, event_type, value as h, {DAILY!r} * (epoch_us(ts) / 86400000000.0 - 19723) as a from events),
s as (select event_type, sum(cos(a) * cos(a)) as cc, sum(cos(a) * sin(a)) as cs, sum(sin(a) * sin(a)) as ss, sum(h * cos(a)) as hc, sum(h * sin(a)) as hs from e group by 1),
f as (select event_type, (hc * ss - hs * cs) / (cc * ss - cs * cs) as x, (hs * cc - hc * cs) / (cc * ss - cs * cs) as y from s)"""


def _boxed(source: str, value: str, size: int) -> str:
    return f"""select user_id, event_id, ts, sum({value}) over (partition by user_id order by ts, event_id
    rows between {size // 2} preceding and {(size - 1) // 2} following) / {size} as v from {source}"""


Q = {
    "fir_hanning": (
        lambda s, d: r6(L.fir(_gappy(s, d), ["user_id"], ORDER, "v", 24).select("event_id", "filtered"), "filtered"),
        """with e as (select event_id, user_id, case when event_type <> 'click' then value end as v, row_number() over (partition by user_id order by ts, event_id) as i from events),
        p as (select a.event_id, b.v, 1 - cos(2 * pi() * (b.i - a.i + 13) / 25) as w from e a join e b on a.user_id = b.user_id and b.i - a.i between -12 and 11)
        select event_id, round(case when sum(case when v is not null then w end) / 25 >= 0.49999 then sum(v * w) / sum(case when v is not null then w end) end, 6) as filtered from p group by 1""",
    ),
    "fir_boxcar": (
        lambda s, d: r6(L.fir(_gappy(s, d), ["user_id"], ORDER, "v", 5, "boxcar").select("event_id", "filtered"), "filtered"),
        """select event_id, round(case when count(v) over w >= 3 then avg(v) over w end, 6) as filtered
        from (select *, case when event_type <> 'click' then value end as v from events) window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)""",
    ),
    "godin": (
        # 24 * 24 * 25 times the result is a sum of values of two decimals, which has no ties to round.
        lambda s, d: L.godin(events(s, d), ["user_id"], ORDER, "value").select("event_id", F.round(F.col("filtered") * 14400, 3).alias("filtered_x14400")),
        f"""with a as ({_boxed("events", "value", 24)}), b as ({_boxed("a", "v", 24)}), c as ({_boxed("b", "v", 25)})
        select event_id, round(v * 14400, 3) as filtered_x14400 from c""",
    ),
    "harmonic_fit": (
        lambda s, d: r6(L.decompose(_timed(s, d), ["event_type"], "t", "value", [DAILY]), "omega", "amplitude", "phase"),
        f"with {_FIT} select event_type, round({DAILY!r}::double, 6) as omega, round(sqrt(x * x + y * y), 6) as amplitude, round(atan2(y, x), 6) as phase from f",
    ),
    "harmonic_residual": (
        harmonic_residual,
        f"with {_FIT} select event_id, round(h - sqrt(x * x + y * y) * cos(a - atan2(y, x)), 6) as residual from e join f using (event_type)",
    ),
}
