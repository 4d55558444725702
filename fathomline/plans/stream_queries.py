"""Streams, parsed texts and scans of lags and periods over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import time as T
from fathomline.operators import metrics as M
from fathomline.plans.series_queries import _split, events, r6, table
from fathomline.session import shared_folder
from fathomline.sources import text as X
from fathomline.streaming import series as V


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; a pattern, as a stream's path may name a single file only so."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def settled(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that has arrived, written to and read from the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


_LAGS = [-43200.0, -21600.0, 0.0, 21600.0, 43200.0]
_PERIODS = [0.5, 1.0, 7.0]

Q = {
    "stream_bin_mean": (
        lambda s, d: r6(settled(V.bin_means(arriving(s, d), ["event_type"], 21600, "12 hours")), "mean"),
        """with b as (select event_type, cast((ceil(epoch_us(ts) / 21600000000.0) - 1) * 21600000000 as bigint) as left_us, round(avg(value), 6) as mean, count(value) as n from events group by 1, 2)
        select event_type, make_timestamp(left_us) as bin, mean, n from b where left_us + 21600000000 <= (select floor((max(epoch_us(ts)) - 1) / 1000) * 1000 - 43200000000 from events)""",
    ),
    "stream_sign_windows": (
        lambda s, d: settled(V.sign_windows(arriving(s, d), "user_id", "value", 50, 100)),
        """with a as (select *, last_value(case when value > 100 then 1 when value < 50 then -1 end ignore nulls) over (partition by user_id order by ts rows unbounded preceding) as s from events),
        b as (select *, case when lag(s) over (partition by user_id order by ts) is not distinct from s then 0 else 1 end as nw from a where s is not null),
        c as (select *, sum(nw) over (partition by user_id order by ts) as g from b),
        w as (select user_id, g, cast(any_value(s) as bigint) as sign, min(ts) as start, max(ts) as "end", count(*) as n from c group by user_id, g)
        select user_id, sign, start, "end", n from w where g < (select max(g) from c where c.user_id = w.user_id)""",
    ),
    "json_numbers": (
        lambda s, d: table(s, d, "events").select("event_id", X.number(F.get_json_object("props", "$.k")).alias("k")),
        "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events",
    ),
    "request_periods": (
        lambda s, d: X.request_periods(events(s, d).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "a", "b", 7).select("user_id", "period_start", "period_end"),
        """with u as (select user_id, min(ts) as a, max(ts) as b from events group by 1), p as (select user_id, b, unnest(generate_series(a, b, interval 7 day)) as period_start from u)
        select user_id, period_start, least(period_start + interval 7 day, b) as period_end from p where period_start < b""",
    ),
    "lag_scan": (
        lambda s, d: r6(M.lag_scan(*reversed(_split(s, d)), ["user_id"], _LAGS), "r"),
        f"""with q as (select event_id, user_id, lag, epoch_us(ts) + cast(lag * 1000000 as bigint) as t, value from events, (select unnest({_LAGS!r}::double[]) as lag) where event_type = 'click'),
        r as (select user_id, epoch_us(ts) as t, max(value) as v from events where event_type = 'view' group by 1, 2),
        c as (select event_id, lag, any_value(q.user_id) as user_id, any_value(q.t) as t, any_value(q.value) as y, max(case when r.t <= q.t then r.t end) as t0, min(case when r.t >= q.t then r.t end) as t1,
          arg_max(r.v, r.t) filter (r.t <= q.t) as v0, arg_min(r.v, r.t) filter (r.t >= q.t) as v1 from q join r on q.user_id = r.user_id group by event_id, lag)
        select user_id, lag, round(corr(case when t1 = t0 then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end, y), 6) as r, count(*) as n
        from c where t0 is not null and t1 is not null group by 1, 2 having count(*) >= 3""",
    ),
    "period_energy": (
        lambda s, d: r6(M.period_energy(events(s, d).withColumn("t", T.to_dnum(F.col("ts")) - 19723), ["event_type"], "t", "value", _PERIODS), "energy"),
        f"""with e as (select event_type, value as h, epoch_us(ts) / 86400000000.0 - 19723 as t, p from events, (select unnest({_PERIODS!r}::double[]) as p))
        select event_type, p as period, round(avg(h * cos({2 * math.pi!r} / p * t)) ** 2 + avg(h * sin({2 * math.pi!r} / p * t)) ** 2, 6) as energy from e group by 1, 2""",
    ),
}
