"""Series and statistics over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import time as T
from fathomline.operators import metrics as M
from fathomline.operators import temporal as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = S.bin_mean(events(spark, sf_dir), ["event_type"], 21600)
    a, b = (each.where(F.col("event_type") == k).select("bin", F.col("mean").alias(n)) for k, n in (("click", "model"), ("view", "obs")))
    return a.join(b, "bin")


def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources in 6-hour bins: bias, correlation, amplitude and skill of one against the other."""
    return r6(M.paired(_binned(spark, sf_dir), [], "model", "obs"), "bias", "r", "amp", "willmott", "murphy", "rms_error")


_BIN = "make_timestamp(cast((ceil(epoch_us(ts) / 21600000000.0) - 1) * 21600000000 as bigint))"
_BINNED = f"""b as (select event_type, {_BIN} as bin, avg(value) as mean from events group by 1, 2),
p as (select a.bin, a.mean as x, c.mean as y from b a join b c on a.bin = c.bin where a.event_type = 'click' and c.event_type = 'view')"""

Q = {
    "compare_metrics": (
        compare_metrics,
        f"""with {_BINNED}, m as (select avg(y) as m from p)
        select count(*) as n, round(avg(x - y), 6) as bias, round(corr(x, y), 6) as r, round(stddev_pop(x) / stddev_pop(y), 6) as amp,
          round(1 - sum((x - y) ** 2) / sum((abs(x - m) + abs(y - m)) ** 2), 6) as willmott,
          round(1 - avg((x - y) ** 2) / avg((y - m) ** 2), 6) as murphy, round(sqrt(avg((x - y) ** 2)), 6) as rms_error from p, m""",
    ),
    "bin_mean_right_closed": (
        lambda s, d: r6(S.bin_mean(events(s, d), ["user_id"], 21600), "mean"),
        f"select user_id, {_BIN} as bin, round(avg(value), 6) as mean from events group by 1, 2",
    ),
    "period_of_sources": (
        lambda s, d: S.period(events(s, d), "event_type"),
        "select max(a) as shared_start, min(b) as shared_end, min(a) as any_start, max(b) as any_end from (select min(ts) as a, max(ts) as b from events group by event_type)",
    ),
    "spearman_rho": (
        lambda s, d: r6(M.spearman(_binned(s, d), [], "model", "obs"), "rho"),
        f"""with {_BINNED}, k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as a, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as b from p)
        select round(corr(a, b), 6) as rho from k""",
    ),
    "rms_by_user": (
        lambda s, d: r6(M.rms(events(s, d), ["user_id"], "value"), "rms"),
        "select user_id, round(sqrt(avg(value * value)), 6) as rms from events group by 1",
    ),
    "weighted_median": (
        lambda s, d: M.weighted_median(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumnRenamed("weighted_median", "median"),
        """with e as (select l_returnflag, l_quantity as v, sum(l_extendedprice) as w from lineitem group by 1, 2),
        c as (select *, sum(w) over (partition by l_returnflag order by v) as c, sum(w) over (partition by l_returnflag) as t from e)
        select l_returnflag, min(v) as median from c where c >= t / 2 group by 1""",
    ),
    "pairwise_cov": (
        lambda s, d: r6(M.pair_cov(S.bin_mean(events(s, d), ["event_type"], 21600), "bin", "event_type", "mean"), "cov"),
        f"""with b as (select event_type, {_BIN} as bin, avg(value) as mean from events group by 1, 2)
        select a.event_type as var_a, c.event_type as var_b, round(case when count(*) > 1 then sum(a.mean * c.mean) / (count(*) - 1) else 0.0 end, 6) as cov
        from b a join b c on a.bin = c.bin group by 1, 2""",
    ),
    "autocovariance": (
        lambda s, d: r6(M.autocovariance(events(s, d).withColumn("i", F.row_number().over(S.Window.partitionBy("user_id").orderBy("ts"))), ["user_id"], "i", "value", 5)).select("user_id", "lag", "n", F.round(F.col("cov") * F.col("n"), 4).alias("total")),
        """with e as (select user_id, value, row_number() over (partition by user_id order by ts) as i from events)
        select a.user_id, cast(b.i - a.i as integer) as lag, round(sum(a.value * b.value), 4) as total, count(*) as n
        from e a join e b on a.user_id = b.user_id and b.i - a.i between 0 and 5 group by 1, 2""",
    ),
    "principal_theta": (
        lambda s, d: r6(M.principal_theta(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount"), "theta"),
        "select l_suppkey, round(0.5 * atan2(2 * covar_samp(l_quantity, l_discount), var_samp(l_quantity) - var_samp(l_discount)), 6) as theta from lineitem group by 1",
    ),
    "detrend": (
        lambda s, d: r6(M.detrended(events(s, d).withColumn("t", T.to_dnum(F.col("ts")) - 19723), ["user_id"], "t", "value").select("event_id", "residual"), "residual"),
        """with e as (select *, epoch_us(ts) / 86400000000.0 - 19723 as t from events)
        select event_id, round(value - avg(value) over w - covar_pop(value, t) over w / var_pop(t) over w * (t - avg(t) over w), 6) as residual from e window w as (partition by user_id)""",
    ),
    "floor_time": (
        lambda s, d: events(s, d).select("event_id", T.floor_time(F.col("ts"), 900).alias("down"), T.ceil_time(F.col("ts"), 900).alias("up")),
        """select event_id, make_timestamp(cast(floor(epoch_us(ts) / 900000000.0) * 900000000 as bigint)) as down,
        make_timestamp(cast(ceil(epoch_us(ts) / 900000000.0) * 900000000 as bigint)) as up from events""",
    ),
    "jdate": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", T.to_jdate(F.col("o_orderdate")).cast("long").alias("jdate"), T.to_unix(F.col("o_orderdate")).alias("unix"), T.to_dnum(F.col("o_orderdate")).alias("dnum")),
        "select o_orderkey, cast(year(o_orderdate) * 1000 + dayofyear(o_orderdate) - 1 as bigint) as jdate, epoch_us(o_orderdate) / 1e6 as unix, epoch_us(o_orderdate) / 86400000000.0 as dnum from orders",
    ),
    "within_closed": (
        lambda s, d: events(s, d).where(F.col("value").between(50, 100)).select("event_id", "value", ((F.col("value") >= 50) & (F.col("value") < 100)).alias("half_open")),
        "select event_id, value, value >= 50 and value < 100 as half_open from events where value between 50 and 100",
    ),
    "dedupe_consecutive": (
        lambda s, d: S.remove_repeated(events(s, d), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type"),
        "select event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as was from events) where was is null or was <> event_type",
    ),
    "increasing_only": (
        lambda s, d: S.select_increasing(events(s, d), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value"),
        "select event_id, value from (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as top from events) where top is null or value > top",
    ),
    "nearest_asof": (
        lambda s, d: S.nearest(*_split(s, d), ["user_id"], 86400.0).select("event_id", "near_ts", "near_value"),
        """with q as (select * from events where event_type = 'click'), r as (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2),
        c as (select q.event_id, q.ts, r.ts as t, r.value as v, row_number() over (partition by q.event_id order by abs(epoch_us(r.ts) - epoch_us(q.ts)), r.ts desc) as k from q left join r on q.user_id = r.user_id)
        select event_id, case when abs(epoch_us(t) - epoch_us(ts)) <= 86400000000 then t end as near_ts, case when abs(epoch_us(t) - epoch_us(ts)) <= 86400000000 then v end as near_value from c where k = 1""",
    ),
    "interp_near": (
        lambda s, d: r6(S.interp_near(*_split(s, d), ["user_id"], 172800.0).select("event_id", "interp"), "interp"),
        """with q as (select * from events where event_type = 'click'), r as (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2),
        c as (select q.event_id, epoch_us(any_value(q.ts)) as t,
          epoch_us(max(case when r.ts <= q.ts then r.ts end)) as t0, arg_max(case when r.ts <= q.ts then r.value end, case when r.ts <= q.ts then r.ts end) as v0,
          epoch_us(min(case when r.ts >= q.ts then r.ts end)) as t1, arg_min(case when r.ts >= q.ts then r.value end, case when r.ts >= q.ts then r.ts end) as v1
          from q left join r on q.user_id = r.user_id group by q.event_id)
        select event_id, round(case when least(coalesce(t - t0, t1 - t), coalesce(t1 - t, t - t0)) <= 172800000000 then
          case when t0 is null then v1 when t1 is null then v0 when t1 = t0 then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end end, 6) as interp from c""",
    ),
    "fill_linear": (
        lambda s, d: r6(S.fill_invalid(events(s, d).withColumn("v", F.when(F.col("event_type") != "click", F.col("value"))), ["user_id"], ["ts", "event_id"], "v").select("event_id", "filled"), "filled"),
        """with e as (select event_id, user_id, case when event_type <> 'click' then value end as v, row_number() over (partition by user_id order by ts, event_id) as i from events),
        n as (select *, max(case when v is not null then i end) over (partition by user_id order by i) as a, min(case when v is not null then i end) over (partition by user_id order by i desc) as b from e),
        j as (select n.*, p.v as va, q.v as vb from n left join e p on n.user_id = p.user_id and n.a = p.i left join e q on n.user_id = q.user_id and n.b = q.i)
        select event_id, round(coalesce(v, va + (vb - va) * (i - a) / nullif(b - a, 0), va, vb), 6) as filled from j""",
    ),
    "forward_fill": (
        lambda s, d: S.forward_fill(events(s, d).withColumn("v", F.when(F.col("event_type") == "view", F.col("value"))), ["user_id"], "v", 2).select("event_id", "filled"),
        """select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by ts range between interval 2 days preceding and current row) as filled from events""",
    ),
    "cdiff": (
        lambda s, d: r6(S.cdiff(events(s, d), ["user_id"], ["ts", "event_id"], "value").select("event_id", "cdiff"), "cdiff"),
        """select event_id, round(coalesce(lead(value) over (partition by user_id order by ts, event_id), first_value(value) over (partition by user_id order by ts, event_id)) - value, 6) as cdiff from events""",
    ),
    "sign_windows": (
        lambda s, d: S.sign_windows(events(s, d), ["user_id"], "value", 50, 100).select("user_id", F.col("sign").cast("long").alias("sign"), "start", "end", "n"),
        """with a as (select *, last_value(case when value > 100 then 1 when value < 50 then -1 end ignore nulls) over (partition by user_id order by ts rows unbounded preceding) as s from events),
        b as (select *, case when lag(s) over (partition by user_id order by ts) is not distinct from s then 0 else 1 end as nw from a where s is not null),
        c as (select *, sum(nw) over (partition by user_id order by ts) as g from b)
        select user_id, cast(any_value(s) as bigint) as sign, min(ts) as start, max(ts) as "end", count(*) as n from c group by user_id, g""",
    ),
    "release_intervals": (
        lambda s, d: S.gap_sessions(events(s, d), ["user_id"], 43200),
        """with b as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 43200000000 then 0 else 1 end as nw from events),
        c as (select *, sum(nw) over (partition by user_id order by ts) as g from b) select user_id, min(ts) as start, max(ts) as "end", count(*) as n from c group by user_id, g""",
    ),
    "quantize_blocks": (
        lambda s, d: r6(S.quantize(events(s, d), ["user_id"], ["ts", "event_id"], "value", 10), "mean"),
        """select user_id, cast((i - 1) // 10 as bigint) as block, round(avg(value), 6) as mean from (select *, row_number() over (partition by user_id order by ts, event_id) as i from events) group by 1, 2 having count(*) = 10""",
    ),
    "center_to_interval": (
        lambda s, d: r6(S.center_to_interval(events(s, d).withColumn("t", T.to_unix(F.col("ts"))), ["user_id"], "t").select("event_id", "width"), "width"),
        """with w as (select event_id, user_id, epoch_us(ts) / 1e6 as t, (lead(epoch_us(ts) / 1e6) over (partition by user_id order by ts) - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts)) / 2 as w from events)
        select event_id, round(coalesce(w, lead(w) over (partition by user_id order by t), lag(w) over (partition by user_id order by t), lead(t) over (partition by user_id order by t) - t, t - lag(t) over (partition by user_id order by t)), 6) as width from w""",
    ),
    "deriv": (
        lambda s, d: r6(S.deriv(events(s, d).withColumn("t", T.to_dnum(F.col("ts"))), ["user_id"], "t", "value"), "x_mid", "slope"),
        """select user_id, round((t + t1) / 2, 6) as x_mid, round((v1 - value) / (t1 - t), 6) as slope from (select user_id, value, epoch_us(ts) / 86400000000.0 as t,
        lead(epoch_us(ts) / 86400000000.0) over (partition by user_id order by ts) as t1, lead(value) over (partition by user_id order by ts) as v1 from events) where t1 is not null""",
    ),
}


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    return e.where("event_type = 'click'"), e.where("event_type = 'view'").select("user_id", "ts", "value")
