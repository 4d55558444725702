import datetime

import pytest

from fathomline.operators import metrics as M
from fathomline.sources import observations
from fathomline.sources import text as X
from fathomline.streaming import series as V
from pyspark.sql import functions as F


def test_typed_tab(spark, tmp_path):
    for name, rows in (("a", "USGS\t2013-01-01 00:00\tPST\t1.5\nUSGS\t2013-07-01 00:00\tPDT\tIce\n"), ("b", "")):
        (tmp_path / f"{name}.rdb").write_text("# note\n#\nagency\tdatetime\ttz\tflow\n5s\t20d\t6s\t14n\n" + rows)
    got = X.typed_tab(spark, str(tmp_path)).select(X.utc(F.col("datetime"), F.col("tz")).alias("t"), X.number(F.col("flow")).alias("v")).orderBy("t").collect()
    assert [tuple(r) for r in got] == [(datetime.datetime(2013, 1, 1, 8), 1.5), (datetime.datetime(2013, 7, 1, 7), None)]
    with pytest.raises(Exception, match="unknown time zone"):
        spark.createDataFrame([("2013-01-01 00:00", "CET")], "a string, b string").select(X.utc(F.col("a"), F.col("b"))).collect()


def test_sentences(spark):
    body = "GPGGA,123519,,N"
    told = 0
    for c in body.encode():
        told ^= c
    lines = spark.createDataFrame([(f"${body}*{told:02X}",), (f"${body}*{told ^ 1:02x}\r",), ("$GPZDA",), ("noise",), (None,), ("",)], "value string")
    got = [tuple(r)[1:] for r in X.sentences(lines).collect()]
    assert got == [("GP", "GGA", ["123519", "", "N"], True), ("GP", "GGA", ["123519", "", "N"], False), ("GP", "ZDA", [], None)]


def test_readings(spark):
    df = spark.createDataFrame([(1, '{"data": [{"t": "2020-01-01 00:06", "v": "1.25"}, {"t": "2020-01-01 00:12", "v": ""}]}'), (2, "no"), (3, None)], "k int, j string")
    got = [tuple(r) for r in X.readings(df, "j", ["k"]).collect()]
    assert got == [(1, datetime.datetime(2020, 1, 1, 0, 6), 1.25), (1, datetime.datetime(2020, 1, 1, 0, 12), None)]


def test_request_periods_by_month(spark):
    day = lambda *a: datetime.datetime(2020, *a)
    df = spark.createDataFrame([(1, day(1, 20), day(3, 1)), (2, day(1, 1), day(1, 1)), (3, None, day(1, 1))], "k int, a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in X.request_periods(df, "a", "b").select("k", "period_start", "period_end").orderBy("period_start").collect()]
    assert got == [(1, day(1, 20), day(2, 1)), (1, day(2, 1), day(3, 1))]


def test_lag_is_found(spark):
    import math

    at = lambda m: datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=m)
    wave = lambda m: math.cos(2 * math.pi * m / 745)
    x = spark.createDataFrame([(1, at(m), wave(m)) for m in range(0, 6000, 6)], "k int, ts timestamp_ntz, value double")
    ref = spark.createDataFrame([(1, at(m), wave(m + 45)) for m in range(0, 6000, 18)], "k int, ts timestamp_ntz, value double")
    got = M.best_lag(M.lag_scan(x, ref, ["k"], [60.0 * k for k in range(-90, 91, 15)]), ["k"]).collect()
    assert [(r["k"], r["lag"]) for r in got] == [(1, 45 * 60.0)] and got[0]["r"] > 0.999
    assert M.lag_scan(x.limit(0), ref, ["k"], [0.0]).count() == 0


def test_stream_across_batches(spark, tmp_path):
    """Files that arrive one at a time give what the windows of all of them at once give, but for each open stretch."""
    at = lambda h: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=h)
    values = [3.0, 0.5, 2.0, -2.0, None, -0.5, -3.0, 4.0, 5.0, -1.5]
    schema = "k int, ts timestamp_ntz, v double"
    for i in range(0, 10, 2):
        spark.createDataFrame([(1, at(h), values[h]) for h in (i, i + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    def run(df, name):
        stream = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        stream.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(V.sign_windows(source, "k", "v", -1.0, 1.0), "signs")
    assert sorted(got) == [(1, -1, at(3), at(6), 3), (1, 1, at(0), at(2), 3), (1, 1, at(7), at(8), 2)]
    assert len(run(V.drop_repeats(source, ["k"], "30 days"), "once")) == 1


def test_positions_and_local_times(spark):
    lines = spark.createDataFrame([("$GPGGA,123456.000,3745.5000,N,12227.2500,W,1,08,1.0,12.3,M,0.0,M,,*43",), ("$GPGGA,123456.000,3745.5000,N,12227.2500,W,1,08,1.0,12.3,M,0.0,M,,*42",), ("noise",)], "value string")
    got = observations.fixes(lines).collect()
    assert len(got) == 1 and got[0]["kind"] == "GGA" and abs(got[0]["lat"] - (37 + 45.5 / 60)) < 1e-9 and abs(got[0]["lon"] + 122 + 27.25 / 60) < 1e-9
    times = ["2023-11-05 00:30", "2023-11-05 01:30", "2023-11-05 02:30", "2023-07-01 12:00"]
    df = observations.local_series(spark.createDataFrame([(t,) for t in times], "t string"), "t", "America/Los_Angeles")
    assert [None if r["ts"] is None else r["ts"].strftime("%m-%d %H:%M") for r in df.collect()] == ["11-05 07:30", None, "11-05 10:30", "07-01 19:00"]
    assert abs(spark.range(1).select(observations.salinity(F.lit(53087.0))).first()[0] - 35.0) < 0.05


def test_wind_answers_and_midnight(spark):
    said = '{"metadata": {"id": "9"}, "data": [{"t": "2011-03-04 05:06", "s": "2.5", "d": "", "g": "3", "f": "1,1"}]}'
    r = observations.station_readings(spark.createDataFrame([(1, said)], "k int, j string"), "j", ["k"], wind=True).first()
    assert (r["station"], r["speed"], r["direction"], r["gust"]) == ("9", 2.5, None, 3.0)
    day = '{"Data": {"Providers": [{"Records": [{"Date": "2020-02-29", "Hour": "2400", "Station": "5", "HlyEto": {"Value": "x", "Qc": "A"}}]}]}}'
    r = observations.weather_records(spark.createDataFrame([(day,)], "j string"), "j", ["HlyEto"]).first()
    assert str(r["ts"]) == "2020-03-01 00:00:00" and r["HlyEto"] is None and r["HlyEto_qc"] == "A"
