"""Text formats of observations as columns: tab tables with a row of types, checksummed sentences, JSON readings.

Every reader is a scan and a projection, so files of any number and size are split and read by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours to add to a local time of these zones to have UTC.
ZONE_HOURS = {"PST": 8, "PDT": 7, "EST": 5, "EDT": 4}


def typed_tab(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of tab-separated files with ``#`` comments, a header and a row of types such as ``5s`` or ``14n``, all as strings.

    The files share one header.  Rows of types are told by their first field, so any number of them may occur.
    """
    rows = spark.read.csv(path, sep="\t", comment="#", header=True)
    return rows.where(~F.coalesce(F.col(f"`{rows.columns[0]}`").rlike(r"^\d+[sdn]$"), F.lit(False)))


def number(text: Column) -> Column:
    """The number that a field holds; null for a qualifier such as ``Ice`` or an empty field."""
    return F.trim(text).try_cast("double")


def utc(local: Column, zone: Column) -> Column:
    """A local time of a zone in ``ZONE_HOURS`` as UTC; another zone is an error, a null one gives null."""
    hours = F.create_map(*(F.lit(x) for pair in ZONE_HOURS.items() for x in pair))
    known = F.coalesce(hours[zone], F.when(zone.isNotNull(), F.raise_error(F.concat(F.lit("unknown time zone "), zone)).cast("int")))
    return F.to_timestamp_ntz(local) + F.make_dt_interval(hours=known)


def sentences(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with ``talker, kind, fields, sound`` of sentences ``$ttkkk,field,...*hh``; other lines are left out.

    ``sound`` says that hh is the exclusive or of the characters between ``$`` and ``*``; without hh it is null.
    """
    pattern = r"^\$([^*]*)(?:\*([0-9A-Fa-f]{2}))?\s*$"
    body, said = F.regexp_extract(line, pattern, 1), F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))
    each = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), F.ascii)
    told = F.aggregate(each, F.lit(0), lambda a, c: a.bitwiseXOR(c))
    out = lines.where(F.col(line).rlike(pattern)).withColumn("_f", F.split(body, ","))
    out = out.withColumns({"talker": F.substring(F.col("_f")[0], 1, 2), "kind": F.substring(F.col("_f")[0], 3, 3), "fields": F.slice("_f", F.lit(2), F.size("_f"))})
    return out.withColumn("sound", F.conv(said, 16, 10).cast("int") == told).drop("_f")


def readings(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """``(keep, ts, value)`` of JSON texts with ``data: [{t, v}, ...]``; a value that is no number is null, a text that is no JSON has no rows."""
    data = F.from_json(F.col(json), "data array<struct<t: string, v: string>>")["data"]
    out = df.select(*keep, F.explode(data).alias("_r"))
    return out.select(*keep, F.col("_r.t").try_cast("timestamp_ntz").alias("ts"), number(F.col("_r.v")).alias("value"))


def request_periods(df: DataFrame, start: str, end: str, days: int | None = None) -> DataFrame:
    """``df`` with a row for each period that start to end is asked for in: of ``days``, the last as short as it must be, or a month of the calendar."""
    a, b = F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz")
    step = F.expr("interval 1 month") if days is None else F.make_dt_interval(days=F.lit(days))
    first = F.date_trunc("month", a).cast("timestamp_ntz") if days is None else a
    out = df.withColumn("period_start", F.explode(F.when(a < b, F.sequence(first, b, step))))
    out = out.withColumn("period_end", F.least(F.col("period_start") + step, b)).withColumn("period_start", F.greatest("period_start", a))
    return out.where("period_start < period_end")
