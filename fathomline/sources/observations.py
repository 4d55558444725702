"""Formats of observing networks as series: each a projection of lines or JSON texts that Spark has read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.sources.text import number, sentences, utc

# Short names of some common parameter and statistic codes.
PARAMETERS = {"00010": "temperature_water", "00045": "precipitation", "00055": "stream_velocity", "00060": "stream_flow", "00065": "gage_height", "00095": "specific_conductance", "00300": "oxygen", "00400": "ph", "00480": "salinity", "63680": "turbidity", "72137": "stream_flow_tidally_filtered", "80154": "suspended_sediment"}
STATISTICS = {"00001": "maximum", "00002": "minimum", "00003": "mean", "00006": "sum", "00008": "median", "00011": "instantaneous"}
SERIES_COLUMN = r"^(\d+)_(\d+)(?:_(\d{5}))?(_cd)?$"


def rdb_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns of a tab table by the letters of its row of types: ``n`` a number or null, ``d`` a time, ``s`` as it is."""
    cast = {"n": number, "d": lambda c: c.try_cast("timestamp_ntz"), "s": lambda c: c}
    return df.select(*(cast[kinds.get(c, "s")[-1]](F.col(f"`{c}`")).alias(c) for c in df.columns))


def rdb_series(df: DataFrame, time: str = "datetime", zone: str = "tz_cd") -> DataFrame:
    """``(station columns, ts, parameter, statistic, value)`` of a table with columns such as ``12345_00060_00003``, times as UTC.

    A value that is no number is null; columns of qualifiers (``_cd``) are left out; unknown codes keep their number.
    """
    import re

    told = {c: m for c in df.columns if (m := re.match(SERIES_COLUMN, c))}
    rest = [c for c in df.columns if c not in told and c not in (time, zone)]
    each = [
        F.struct(F.lit(PARAMETERS.get(m[2], m[2])).alias("parameter"), F.lit(STATISTICS.get(m[3], m[3]) if m[3] else None).cast("string").alias("statistic"), number(F.col(f"`{c}`").cast("string")).alias("value"))
        for c, m in told.items() if not m[4]
    ]
    at = utc(F.col(time).cast("string"), F.col(zone)) if zone in df.columns else F.col(time).cast("timestamp_ntz")
    return df.select(*rest, at.alias("ts"), F.inline(F.array(*each)))


def degrees(text: Column, side: Column) -> Column:
    """Degrees of a field such as ``0721.1655``, the last two whole digits minutes; south and west are negative."""
    whole = text.try_cast("double")
    turned = F.floor(whole / 100) + (whole - F.floor(whole / 100) * 100) / 60
    return F.when(side.isin("S", "W"), -turned).otherwise(turned)


def fixes(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with ``kind, ts, lat, lon`` of sound position sentences: GGA has a time of day on 1970-01-01, RMC a date too.

    Sentences of other kinds and those with a wrong or no checksum are left out, and so are those with too few fields.
    """
    s = sentences(lines, line).where("sound and kind in ('GGA', 'RMC') and size(fields) >= 9")
    f = F.col("fields")
    gga = F.col("kind") == "GGA"
    pick = lambda a, b: F.when(gga, f[a]).otherwise(f[b])
    day = F.when(gga, F.lit("010170")).otherwise(f[8])
    seconds = F.substring(f[0], 1, 2).try_cast("int") * 3600 + F.substring(f[0], 3, 2).try_cast("int") * 60 + F.substring(f[0], 5, 9).try_cast("double")
    date = F.try_to_timestamp(F.concat(F.substring(day, 1, 4), F.when(gga, "1970").otherwise(F.concat(F.lit("20"), F.substring(day, 5, 2)))), F.lit("ddMMyyyy"))
    ts = F.timestamp_micros(F.unix_micros(date) + F.round(seconds * 1e6).cast("long")).cast("timestamp_ntz")
    return s.select(*lines.columns, "kind", ts.alias("ts"), degrees(pick(1, 2), pick(2, 3)).alias("lat"), degrees(pick(3, 4), pick(4, 5)).alias("lon"))


def station_readings(df: DataFrame, json: str, keep: list[str], wind: bool = False) -> DataFrame:
    """``(keep, station, ts, value)`` of JSON answers with ``metadata`` and ``data`` or ``predictions``; with ``wind`` speed, direction and gust.

    A value that is no number is null.
    """
    row = "array<struct<t: string, v: string, s: string, d: string, g: string>>"
    said = F.from_json(F.col(json), f"metadata struct<id: string>, data {row}, predictions {row}")
    out = df.select(*keep, said.alias("_j")).select(*keep, F.col("_j.metadata.id").alias("station"), F.explode(F.coalesce("_j.data", "_j.predictions")).alias("_r"))
    values = {"speed": "s", "direction": "d", "gust": "g"} if wind else {"value": "v"}
    return out.select(*keep, "station", F.col("_r.t").try_cast("timestamp_ntz").alias("ts"), *(number(F.col(f"_r.{c}")).alias(n) for n, c in values.items()))


def weather_records(df: DataFrame, json: str, fields: list[str]) -> DataFrame:
    """``(station, ts, fields, fields_qc)`` of JSON with hourly or daily records; hour 2400 is midnight of the next day."""
    cells = ", ".join(f"{f}: struct<Value: string, Qc: string>" for f in fields)
    records = F.from_json(F.col(json), f"Data struct<Providers: array<struct<Records: array<struct<Date: string, Hour: string, Station: string, {cells}>>>>>")["Data"]["Providers"][0]["Records"]
    r = df.select(F.explode(records).alias("r"))
    hour = F.coalesce(F.col("r.Hour"), F.lit("0000"))
    at = F.col("r.Date").try_cast("timestamp_ntz") + F.make_dt_interval(hours=F.substring(hour, 1, 2).cast("int"), mins=F.substring(hour, 3, 2).cast("int"))
    return r.select(F.col("r.Station").alias("station"), at.alias("ts"), *(c for f in fields for c in (number(F.col(f"r.{f}.Value")).alias(f), F.col(f"r.{f}.Qc").alias(f"{f}_qc"))))


def gauge_items(df: DataFrame, json: str) -> DataFrame:
    """``(ts, measure, value, full)`` of JSON with ``items`` and a limit; ``full`` says that an answer reached its limit, so more may lack."""
    said = F.from_json(F.col(json), "meta struct<limit: bigint>, items array<struct<dateTime: string, measure: string, value: double>>")
    s = df.select(said.alias("j")).select(F.explode("j.items").alias("i"), (F.size("j.items") == F.col("j.meta.limit")).alias("full"))
    return s.select(F.regexp_replace("i.dateTime", "Z$", "").try_cast("timestamp_ntz").alias("ts"), "i.measure", "i.value", "full")


def buoy_rows(lines: DataFrame, names: list[str], line: str = "value", none: dict[str, float] | None = None) -> DataFrame:
    """``(ts, names)`` of lines of fields between blanks that begin with year, month, day, hour and minute; those with ``#`` are left out.

    ``none`` gives the number that stands for no value in a column; of water temperature it is 999.
    """
    none = {"WTMP": 999.0} | (none or {})
    f = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.where(~F.col(line).startswith("#") & (F.trim(F.col(line)) != ""))
    ts = F.make_timestamp_ntz(*(f[k].cast("int") for k in range(5)), F.lit(0))
    return rows.select(ts.alias("ts"), *(F.nullif(f[k + 5].try_cast("double"), F.lit(none.get(n))).alias(n) for k, n in enumerate(names)))


def local_series(df: DataFrame, local: str, zone: str) -> DataFrame:
    """``df`` with ``ts``, a local time of a region as UTC; a time that the clocks show twice is null."""
    at = F.col(local).cast("timestamp_ntz")
    ts = F.to_utc_timestamp(at.cast("string"), zone).cast("timestamp_ntz")
    # A clock that is set back shows an hour twice: then an hour more or less of UTC is the same local time.
    back = lambda h: F.from_utc_timestamp((ts + F.make_dt_interval(hours=F.lit(h))).cast("string"), zone).cast("timestamp_ntz")
    return df.withColumn("ts", F.when((back(1) != at) & (back(-1) != at), ts))


def salinity(conductance: Column) -> Column:
    """Practical salinity of water of a specific conductance in microsiemens a centimetre at 25 degrees, by the practical scale of 1978."""
    # Fixed values of the scale, for 25 degrees and no pressure.
    a = [0.0080, -0.1692, 25.3851, 14.0941, -7.0261, 2.7081]
    b = [0.0005, -0.0056, -0.0066, -0.0375, 0.0636, -0.0144]
    c = [0.6766097, 2.00564e-2, 1.104259e-4, -6.9698e-7, 1.0031e-9]
    t = 25.0 * 1.00024
    warm = sum(x * t**k for k, x in enumerate(c))
    root = F.sqrt(conductance / 1000 / 42.914 / warm)
    power = lambda cs: sum((F.lit(x) * F.pow(root, k) for k, x in enumerate(cs)), F.lit(0.0))
    return power(a) + (t - 15) / (1 + 0.0162 * (t - 15)) * power(b)


def timed_values(lines: DataFrame, reference: str, unit: str = "M", names: list[str] | None = None, columns: int = 1, line: str = "value") -> DataFrame:
    """``(ts, names)`` of lines of numbers that begin with minutes (``M``) or seconds (``S``) since a reference time; names beyond those given are val1, val2 ..."""
    if unit.upper() not in ("M", "S"):
        raise ValueError("unit is M or S")
    f = F.split(F.trim(F.regexp_replace(F.col(line), r"[*#].*$", "")), r"\s+")
    rows = lines.select(f.alias("f")).where(F.col("f")[0].rlike(r"^[-+0-9.]"))
    us = F.unix_micros(F.lit(reference).cast("timestamp")) + F.round(F.col("f")[0].cast("double") * (60e6 if unit.upper() == "M" else 1e6)).cast("long")
    given = names or []
    each = [given[k] if k < len(given) else f"val{k + 1}" for k in range(columns)]
    return rows.select(F.timestamp_micros(us).cast("timestamp_ntz").alias("ts"), *(F.col("f")[k + 1].try_cast("double").alias(n) for k, n in enumerate(each)))


def xyz_points(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(x, y, z)`` of lines of three numbers between blanks or commas; other lines are left out."""
    f = F.split(F.trim(F.col(line)), r"[\s,]+")
    s = lines.select(*(f[k].try_cast("double").alias(n) for k, n in enumerate("xyz")))
    return s.where("x is not null and y is not null and z is not null")


def dated_values(df: DataFrame, text: str, value: str, pattern: str, before: int | None = None) -> DataFrame:
    """``(ts, value)`` of texts with dates of a pattern; with ``before``, a two-digit year that would not lie before it belongs to the century before."""
    ts = F.try_to_timestamp(F.col(text), F.lit(pattern)).cast("timestamp_ntz")
    if before is not None:
        ts = F.when(F.year(ts) >= before, ts - F.expr("interval 100 year")).otherwise(ts)
    return df.select(ts.alias("ts"), F.col(value).try_cast("double").alias("value"))
