"""Binary frames and period files written here and read back, by many tasks, torn, empty and filtered."""

import datetime
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomline.sources import frames


@pytest.fixture(scope="module")
def reading(spark):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda kind, path, **options: frames.registered(spark).read.format(kind).options(path=str(path), **options).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def particles(path, steps, cut=0):
    with path.open("wb") as f:
        f.write(struct.pack("<i", 2))
        for k in range(2):
            f.write(struct.pack("<i", k) + b"real".ljust(80) + b"depth".ljust(80))
        for when, n in steps:
            f.write(struct.pack("<6i", *when, n))
            for i in range(n):
                f.write(struct.pack("<i3di", i, i * 0.5, -i, n, i % 2))
    if cut:
        raw = path.read_bytes()
        path.write_bytes(raw[:-cut])


def test_particles_are_read_by_many_tasks(reading, tmp_path):
    particles(tmp_path / "a_bin.out", [((2020, 2, 28, 23, 30), 1000), ((2020, 2, 28, 23, 60), 3), ((2020, 2, 29, 24, 0), 500)])
    df = reading("particle_frames", tmp_path / "a_bin.out", taskBytes=100 * 32)
    assert df.rdd.getNumPartitions() == 10 + 1 + 5
    got = df.groupBy("step", "time").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.min("y").alias("y"), F.sum("active").alias("on")).orderBy("step").collect()
    assert [(r["step"], r["time"].strftime("%m-%d %H:%M"), r["n"], r["x"], r["y"], r["on"]) for r in got] == [(0, "02-28 23:30", 1000, 249750.0, -999.0, 500), (1, "02-29 00:00", 3, 1.5, -2.0, 1), (2, "03-01 00:00", 500, 62375.0, -499.0, 250)]
    assert reading("particle_frames", tmp_path / "a_bin.out").rdd.getNumPartitions() == 3


def test_torn_particles(reading, tmp_path):
    """Of a torn last step whole records count; a torn header has none; files of nothing are empty."""
    particles(tmp_path / "a", [((2020, 1, 1, 0, 0), 5), ((2020, 1, 1, 1, 0), 5)], cut=40)
    particles(tmp_path / "b", [((2020, 1, 1, 0, 0), 5), ((2020, 1, 1, 1, 0), 0)], cut=3)
    (tmp_path / "c").write_bytes(b"")
    got = {(r["file"][-1], r["step"]): r["count"] for r in reading("particle_frames", tmp_path).groupBy("file", "step").count().collect()}
    assert got == {("a", 0): 5, ("a", 1): 3, ("b", 0): 5}
    assert reading("particle_frames", tmp_path / "c").count() == 0
    with pytest.raises(Exception, match="missing"):
        reading("particle_frames", tmp_path / "missing").count()


def test_histories(reading, tmp_path):
    data = np.arange(50 * 3 * 2, dtype="<f4").reshape(50, 3, 2)
    with (tmp_path / "x.his").open("wb") as f:
        f.write(b"".join(s.ljust(40) for s in (b"one", b"two", b"three", b"T0: 2019.08.01 00:00:00")) + struct.pack("<2i", 2, 3))
        f.write(b"salt".ljust(10) + b"".ljust(10) + b"salt".ljust(10) + b"decay".ljust(10))
        for k, name in enumerate((b"north", b"south", b"open sea")):
            f.write(struct.pack("<i", k + 1) + name.ljust(20))
        for k in range(50):
            f.write(struct.pack("<i", k * 60) + data[k].tobytes())
        f.write(b"torn frame")
    df = reading("history_frames", tmp_path / "x.his", taskBytes=28 * 8)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 300 and df.select("origin").distinct().collect()[0][0] == "T0: 2019.08.01 00:00:00"
    names = {"north": 0, "south": 1, "open sea": 2}
    assert all(r["value"] == data[r["seconds"] // 60, names[r["region"]], int(r["process"] == "decay")] and r["substance"] == "salt" for r in df.collect())


def test_maps(reading, tmp_path):
    data = np.arange(20 * 7 * 2, dtype="<f4").reshape(20, 7, 2)
    data[3, 2, 1] = -999
    with (tmp_path / "x.map").open("wb") as f:
        f.write(b"a map".ljust(160) + struct.pack("<2i", 2, 7) + b"salt".ljust(20) + b"age".ljust(20))
        for k in range(20):
            f.write(struct.pack("<i", k * 3600) + data[k].tobytes())
        f.write(b"\0" * 20)
    df = reading("map_frames", tmp_path / "x.map", taskBytes=60 * 6, missing=-999)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 280
    for r in df.collect():
        want = data[r["seconds"] // 3600, r["segment"], int(r["substance"] == "age")]
        assert r["value"] == want or (want == -999 and r["value"] is None)


def test_filters_read_only_their_periods(reading, tmp_path):
    """Months of two stations, one file overlapping the month before it and one reaching beyond its name."""
    day = datetime.datetime(2020, 1, 1)
    for station in ("s1", "s_2"):
        for m in range(1, 13):
            a, b = datetime.datetime(2020, m, 1), datetime.datetime(2020 + m // 12, m % 12 + 1, 1)
            first = a - datetime.timedelta(days=3) if m == 5 else a
            ts = [first + datetime.timedelta(days=i) for i in range((b - first).days + (4 if m == 7 else 0))]
            name = f"{station}_{first:%Y%m%d}_{b:%Y%m%d}"
            value = [float((t - day).days) + (0.5 if m == 5 else 0.0) for t in ts]
            if m % 2:
                pq.write_table(pa.table({"ts": pa.array(ts, pa.timestamp("us")), "value": value, "other": ["x"] * len(ts)}), tmp_path / f"{name}.parquet")
            else:
                (tmp_path / f"{name}.csv").write_text("ts,value,other\n" + "".join(f"{t:%Y-%m-%d %H:%M:%S},{v},x\n" for t, v in zip(ts, value, strict=True)))
    (tmp_path / "notes.txt").write_text("no period")
    df = reading("period_files", tmp_path)
    assert df.rdd.getNumPartitions() == 24
    got = {r["station"]: (r["n"], r["d"], r["v"]) for r in df.groupBy("station").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("d"), F.sum("value").alias("v")).collect()}
    assert got == {s: (366, 366, sum(range(366)) + 31 * 0.5) for s in ("s1", "s_2")}
    june = df.where("station = 's1' and ts >= timestamp '2020-06-10' and ts < timestamp '2020-08-01'")
    assert june.rdd.getNumPartitions() == 2 + 1 and june.count() == 52
    inner = df.where("station in ('s_2', 'other') and ts > timestamp '2020-06-10' and ts < timestamp '2020-06-20'")
    assert inner.rdd.getNumPartitions() == 1 and inner.count() == 9
    assert df.where("station = 'none'").count() == 0
