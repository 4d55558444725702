"""Spark data sources for binary frames of models, read by byte ranges, and for folders of period files, read only where a filter looks."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes that one task reads, and of which it makes one batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, which workers can open as the driver does."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _files(path: str, ending: str = "") -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, or of the files of a folder by name."""
    fs, at = _store(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if info.type == pyarrow.fs.FileType.Directory else []
    if not found:
        raise FileNotFoundError(path)
    # what a URI says of its store goes before each path again
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith(("_", ".")))


@dataclass
class Span(InputPartition):
    """Whole records of one file from ``start`` to ``end``; ``about`` is what the header says of them."""

    path: str
    start: int
    end: int
    about: dict

    def __post_init__(self) -> None:
        super().__init__(None)


def _spans(path: str, start: int, size: int, count: int, about: dict, task: int) -> Iterator[Span]:
    """Ranges of about ``task`` bytes of ``count`` records of ``size`` bytes, each a whole number of records."""
    each = max(1, task // size)
    for first in range(0, count, each):
        yield Span(path, start + first * size, start + min(count, first + each) * size, about | {"first": first})


def _records(span: Span, dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of first records and blocks of about BATCH_BYTES."""
    fs, at = _store(span.path)
    each = max(1, BATCH_BYTES // dtype.itemsize)
    with fs.open_input_file(at) as f:
        for k in range(span.start, span.end, each * dtype.itemsize):
            raw = f.read_at(min(each * dtype.itemsize, span.end - k), k)
            yield span.about["first"] + (k - span.start) // dtype.itemsize, np.frombuffer(raw, dtype)


class _Frames(DataSource):
    """Options: ``path``, a file, a folder or a URI, and ``taskBytes``."""

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return self.Reader(self.options)


PARTICLE = np.dtype([("id", "<i4"), ("x", "<f8", 3), ("active", "<i4")])


class ParticleFrames(_Frames):
    """``particle_frames``: positions of particles at steps, ``(file, step, time, id, x, y, z, active)``.

    A file has a header of attributes, and for each step year, month, day, hour, minute and count, then as many records. The driver reads the 24 bytes
    before each step alone; a step of many particles is read by many tasks.  Minute 60 and hour 24 are the next hour and day.  Of
    a torn last step the whole records are read; a torn header of a step, or of a file, has none.
    """

    @classmethod
    def name(cls) -> str:
        return "particle_frames"

    def schema(self) -> str:
        return "file string, step int, time timestamp, id int, x double, y double, z double, active int"

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.task = options["path"], int(options.get("taskBytes", TASK_BYTES))

        def partitions(self) -> list[Span]:
            out: list[Span] = []
            for path, size in _files(self.path):
                fs, inner = _store(path)
                with fs.open_input_file(inner) as f:
                    if size < 4:
                        continue
                    at, step = 4 + 164 * int(np.frombuffer(f.read_at(4, 0), "<i4")[0]), 0
                    while at + 24 <= size:
                        *when, count = np.frombuffer(f.read_at(24, at), "<i4").tolist()
                        at += 24
                        there = min(count, (size - at) // PARTICLE.itemsize)
                        out += _spans(path, at, PARTICLE.itemsize, there, {"step": step, "when": when}, self.task)
                        at, step = at + count * PARTICLE.itemsize, step + 1
            return out or [Span("", 0, 0, {"first": 0})]

        def read(self, span: Span) -> Iterator[pa.RecordBatch]:
            if not span.path:
                return
            year, month, day, hour, minute = span.about["when"]
            when = datetime.datetime(year, month, day, tzinfo=datetime.UTC) + datetime.timedelta(hours=hour, minutes=minute)
            for _, r in _records(span, PARTICLE):
                same = lambda v, t: pa.repeat(pa.scalar(v, t), len(r))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [same(span.path, pa.string()), same(span.about["step"], pa.int32()), same(when, pa.timestamp("us", "UTC")), pa.array(r["id"].copy()), *(pa.array(r["x"][:, k].copy()) for k in range(3)), pa.array(r["active"].copy())],
                    ["file", "step", "time", "id", "x", "y", "z", "active"],
                )


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


class HistoryFrames(_Frames):
    """``history_frames``: values of regions and fields at times, ``(file, origin, seconds, region, substance, process, value)``.

    A file has four lines of 40 characters, the last of which tells where time begins, the numbers of fields and regions and their names; then
    frames of a time in seconds and a value for each region and field.  Tasks read whole frames; a torn last frame is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "history_frames"

    def schema(self) -> str:
        return "file string, origin string, seconds int, region string, substance string, process string, value float"

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.task = options["path"], int(options.get("taskBytes", TASK_BYTES))

        def partitions(self) -> list[Span]:
            out: list[Span] = []
            for path, size in _files(self.path):
                fs, inner = _store(path)
                with fs.open_input_file(inner) as f:
                    if size < 168:
                        continue
                    fields, regions = np.frombuffer(f.read_at(8, 160), "<i4").tolist()
                    start = 168 + fields * 20 + regions * 24
                    if size < start:
                        continue
                    head = f.read_at(start, 0)
                about = {"origin": _text(head[120:160]), "fields": [(_text(head[k : k + 10]), _text(head[k + 10 : k + 20])) for k in range(168, 168 + fields * 20, 20)], "regions": [_text(head[k + 4 : k + 24]) for k in range(168 + fields * 20, start, 24)]}
                frame = 4 + 4 * fields * regions
                out += _spans(path, start, frame, (size - start) // frame, about, self.task)
            return out or [Span("", 0, 0, {"first": 0})]

        def read(self, span: Span) -> Iterator[pa.RecordBatch]:
            if not span.path:
                return
            fields, regions = span.about["fields"], span.about["regions"]
            n = len(fields) * len(regions)
            for _, r in _records(span, np.dtype([("seconds", "<i4"), ("data", "<f4", (len(regions), len(fields)))])):
                named = lambda names, at: pa.DictionaryArray.from_arrays(pa.array(np.tile(at, len(r)).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())  # noqa: E731, B023
                field = np.tile(np.arange(len(fields)), len(regions))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(v, pa.string()), len(r) * n) for v in (span.path, span.about["origin"])]
                    + [pa.array(np.repeat(r["seconds"], n)), named(regions, np.repeat(np.arange(len(regions)), len(fields))), named([a for a, _ in fields], field), named([b for _, b in fields], field), pa.array(r["data"].ravel())],
                    ["file", "origin", "seconds", "region", "substance", "process", "value"],
                )


class MapFrames(_Frames):
    """``map_frames``: values of segments and substances at times, ``(file, seconds, segment, substance, value)``, segments from 0.

    A file has 160 characters of text, the numbers of substances and segments and the substances' names; then frames of a time in seconds
    and the substances of each segment.  With the option ``missing`` that value is null.  Tasks read whole frames; a torn last one is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "map_frames"

    def schema(self) -> str:
        return "file string, seconds int, segment int, substance string, value float"

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.task = options["path"], int(options.get("taskBytes", TASK_BYTES))
            self.missing = float(options["missing"]) if "missing" in options else None

        def partitions(self) -> list[Span]:
            out: list[Span] = []
            for path, size in _files(self.path):
                fs, inner = _store(path)
                with fs.open_input_file(inner) as f:
                    if size < 168:
                        continue
                    subs, segments = np.frombuffer(f.read_at(8, 160), "<i4").tolist()
                    start, frame = 168 + subs * 20, 4 + 4 * subs * segments
                    names = f.read_at(subs * 20, 168)
                about = {"substances": [_text(names[k : k + 20]) for k in range(0, subs * 20, 20)], "segments": segments}
                out += _spans(path, start, frame, max(0, size - start) // frame, about, self.task)
            return out or [Span("", 0, 0, {"first": 0})]

        def read(self, span: Span) -> Iterator[pa.RecordBatch]:
            if not span.path:
                return
            names, segments = span.about["substances"], span.about["segments"]
            for _, r in _records(span, np.dtype([("seconds", "<i4"), ("data", "<f4", (segments, len(names)))])):
                n = segments * len(names)
                value = r["data"].ravel()
                sub = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(names)), len(r) * segments).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(span.path, pa.string()), len(r) * n), pa.array(np.repeat(r["seconds"], n)), pa.array(np.tile(np.repeat(np.arange(segments, dtype=np.int32), len(names)), len(r))), sub, pa.array(value, mask=value == np.float32(self.missing) if self.missing is not None else None)],
                    ["file", "seconds", "segment", "substance", "value"],
                )


PERIOD = re.compile(r"(?P<station>.+)_(?P<start>\d{8}(?:T\d{6})?)_(?P<end>\d{8}(?:T\d{6})?)\.(?P<kind>csv|parquet)$")


def _instant(text: str) -> int:
    """Microseconds of 20200131 or 20200131T235900, in UTC."""
    t = datetime.datetime.strptime(text, "%Y%m%dT%H%M%S" if "T" in text else "%Y%m%d").replace(tzinfo=datetime.UTC)
    return int(t.timestamp()) * 1_000_000


def _micros(value: datetime.datetime) -> int:
    value = value if value.tzinfo else value.replace(tzinfo=datetime.UTC)
    return round(value.timestamp() * 1_000_000)


class PeriodFiles(DataSource):
    """``period_files``: series kept as one file for each station and period, ``(station, ts, value)``.

    Names are ``station_start_end.csv`` or ``.parquet``, days or instants in UTC, and files have columns ``ts`` and ``value``; a CSV's times are UTC.  The end of
    a name is not part of its period.  Rows outside their file's period are left out, and where periods of a station overlap those of the file that
    starts first count, of equal ones the longer, so no time comes twice from two files.  Each file is a task, and filters on ``station`` and
    ``ts`` leave files out before any is opened (with ``spark.sql.python.filterPushdown.enabled``); Spark applies them to the rows still.
    """

    @classmethod
    def name(cls) -> str:
        return "period_files"

    def schema(self) -> str:
        return "station string, ts timestamp, value double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PeriodReader(self.options["path"])


class PeriodReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.stations = path, None
        self.low, self.high = -(2**62), 2**62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("station",) and isinstance(f, EqualTo):
                self._only({value})
            elif column == ("station",) and isinstance(f, In):
                self._only(set(value))
            elif column == ("ts",) and isinstance(value, datetime.datetime):
                t = _micros(value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, t)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, t)
            yield f

    def _only(self, names: set) -> None:
        self.stations = names if self.stations is None else self.stations & names

    def partitions(self) -> list[InputPartition]:
        held = []
        for path, _ in _files(self.path):
            m = PERIOD.match(path.rsplit("/", 1)[-1])
            if m:
                held.append((m["station"], _instant(m["start"]), -_instant(m["end"]), path))
        out: list[InputPartition] = []
        last: dict[str, int] = {}
        for station, start, end, path in sorted(held):
            start, end = max(start, last.get(station, start)), -end
            last[station] = max(end, last.get(station, end))
            if start < end and end > self.low and start <= self.high and (self.stations is None or station in self.stations):
                out.append(Span(path, start, end, {"station": station}))
        return out or [Span("", 0, 0, {})]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        fs, at = _store(span.path)
        utc = pa.timestamp("us", "UTC")
        if at.endswith(".csv"):
            with fs.open_input_stream(at) as f:
                table = pyarrow.csv.read_csv(f, convert_options=pyarrow.csv.ConvertOptions(column_types={"ts": pa.timestamp("us"), "value": pa.float64()}, include_columns=["ts", "value"]))
            batches = table.to_batches()
        else:
            batches = pyarrow.dataset.dataset(at, filesystem=fs).to_batches(columns=["ts", "value"])
        for b in batches:
            ts = b.column("ts")
            ts = ts.cast(utc) if ts.type.tz else ts.cast(pa.timestamp("us")).cast(pa.int64()).cast(utc)
            t = ts.cast(pa.int64()).to_numpy(zero_copy_only=False)
            keep = pa.array((t >= span.start) & (t < span.end))
            held = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(span.about["station"]), b.num_rows), ts, b.column("value").cast(pa.float64())], ["station", "ts", "value"])
            yield held.filter(keep)


def registered(spark: SparkSession) -> SparkSession:
    """``spark`` with the formats ``particle_frames``, ``history_frames``, ``map_frames`` and ``period_files``."""
    for source in (ParticleFrames, HistoryFrames, MapFrames, PeriodFiles):
        spark.dataSource.register(source)
    return spark
