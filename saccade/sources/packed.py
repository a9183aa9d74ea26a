"""Packed (.bin) and archived (.npz) event files as a Spark data source, for batches and streams.

A file is cut into ranges of events that tasks read apart; archives too, where their arrays are stored
as they are. Bounds on t are options of the source (start, stop): events outside leave before they reach
Spark, and with ``sorted`` a range whose first and last events lie outside isn't read at all. They aren't
taken from where(): Spark 4.1 keeps the filters that a Python source was given for later queries on the
same DataFrame, which then lack rows. Writers put parts
under names of their own, which take their final names and are listed in a numbered commit only when
all tasks have ended. A stream's offset is the last commit it has seen (or, in folders that others
fill, the last file by name).
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "t double, x int, y int, p int"
PROBED = "file string, wide boolean"
#: Events in a range, and in a batch that goes to Spark; the largest coordinate of a packed event.
RANGE, BATCH, WIDEST = 1 << 23, 1 << 18, 4096
COMMITS = "_commits"


def opened(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def listed(path: str, kind: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of the files of a kind in a folder, by name; hidden ones are left out."""
    from pyarrow import fs

    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    found = store.get_file_info(fs.FileSelector(place))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.lower().endswith(f".{kind}"))


@dataclass
class Range(InputPartition):
    """Events first to last of a file; arrays: of an archive, by name the place of the data and their type."""

    file: str
    first: int
    last: int
    layout: str = "packed"
    arrays: dict | None = None


def _archive(store, file: str) -> tuple[int, dict] | None:
    """(events, arrays) of an archive whose arrays are stored as they are; None if one is packed."""
    found = {}
    with store.open_input_file(file) as f, zipfile.ZipFile(f) as z:
        for name in ("t", "x", "y", "p"):
            entry = z.getinfo(f"{name}.npy")
            if entry.compress_type != zipfile.ZIP_STORED:
                return None
            with z.open(entry) as member:
                version = np.lib.format.read_magic(member)
                header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, _, kind = header(member)
                head = member.tell()
            if len(shape) != 1 or kind.hasobject:
                return None
            f.seek(entry.header_offset + 26)
            found[name] = (entry.header_offset + 30 + sum(struct.unpack("<2H", f.read(4))) + head, kind.str, shape[0])
    n = min(v[2] for v in found.values())
    return n, {k: v[:2] for k, v in found.items()}


def ranges(path: str, files: list[tuple[str, int]], kind: str, layouts: dict[str, str], most: int) -> list[Range]:
    store, out = opened(path)[0], []
    for file, size in files:
        arrays, layout = None, layouts.get(file, layouts.get("", "packed"))
        if kind == "npz":
            found = _archive(store, file) if size > most else None  # an event takes more than a byte
            if found is None:
                out.append(Range(file, 0, -1, "whole"))
                continue
            (n, arrays), layout = found, "arrays"
        else:
            n = size // (16 if layout == "ints" else 8)
        out += [Range(file, a, min(a + most, n), layout, arrays) for a in range(0, n, most)]
    return out


def unpacked(v: np.ndarray) -> tuple[np.ndarray, ...]:
    t, x, y = v >> np.uint64(32), v >> np.uint64(16) & np.uint64(0xFFFF), v >> np.uint64(1) & np.uint64(0x7FFF)
    return t.astype("f8"), x.astype("i4"), y.astype("i4"), np.where(v & np.uint64(1), 1, -1).astype("i4")


def _events(f, r: Range, first: int, last: int) -> tuple[np.ndarray, ...]:
    """(t, x, y, p) of events first to last of an open file."""
    def read(place: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        f.seek(place + first * size)
        return np.frombuffer(f.read((last - first) * size), kind)

    if r.layout == "packed":
        return unpacked(read(0, "<u8"))
    if r.layout == "ints":
        w = read(0, "V16").view("<i4").reshape(-1, 4)
        return w[:, 0].astype("f8"), w[:, 1], w[:, 2], np.where(w[:, 3] > 0, 1, -1)
    return tuple(read(*r.arrays[c]).astype(k) for c, k in zip("txyp", ("f8", "i4", "i4", "i4"), strict=True))


def read_range(path: str, r: Range, low: float, high: float, ordered: bool) -> Iterator[pa.RecordBatch]:
    store = opened(path)[0]

    def batch(t, x, y, p) -> pa.RecordBatch:
        if low > -np.inf or high < np.finfo("f8").max:
            inside = (t >= low) & (t <= high)
            t, x, y, p = t[inside], x[inside], y[inside], p[inside]
        cells = zip((t, x, y, p), (pa.float64(), *[pa.int32()] * 3), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v), k) for v, k in cells], names=["t", "x", "y", "p"])

    with store.open_input_file(r.file) as f:
        if r.layout == "whole":
            with np.load(io.BytesIO(f.read())) as a:
                yield batch(*(a[c].astype(k) for c, k in zip("txyp", ("f8", "i4", "i4", "i4"), strict=True)))
            return
        if ordered and r.last > r.first and (_events(f, r, r.last - 1, r.last)[0][0] < low or _events(f, r, r.first, r.first + 1)[0][0] > high):
            return
        for at in range(r.first, r.last, BATCH):
            yield batch(*_events(f, r, at, min(at + BATCH, r.last)))


class EventFiles(DataSource):
    """Format ``events``. Options: path; kind (bin or npz, by the path's ending if none is given, bin for folders);
    range (events a task's part); layouts (JSON: by file, or for all under "", packed or ints); sorted (true:
    files are in order of time); start, stop (only events from start on and before stop); probe (true: gives for each range whether a coordinate is beyond the widest)."""

    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self) -> str:
        return PROBED if self.options.get("probe") == "true" else SCHEMA

    def reader(self, schema) -> EventReader:
        return EventReader(dict(self.options))

    def streamReader(self, schema) -> EventStreamReader:  # noqa: N802
        return EventStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(dict(self.options), overwrite)


class _Parts:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        ending = self.path.rstrip("/").rsplit(".", 1)[-1].lower()
        self.kind = options.get("kind", ending if ending in ("bin", "npz") else "bin")
        self.most = int(options.get("range", RANGE))
        self.layouts = json.loads(options.get("layouts", "{}"))
        self.ordered, self.probe = options.get("sorted") == "true", options.get("probe") == "true"
        self.low, self.high = float(options.get("start", "-inf")), np.nextafter(float(options.get("stop", "inf")), -np.inf)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not self.probe:
            yield from read_range(self.path, partition, self.low, self.high, self.ordered)
            return
        wide = any(max(b.column(1).to_numpy().max(initial=0), b.column(2).to_numpy().max(initial=0)) > WIDEST for b in read_range(self.path, partition, self.low, self.high, False))
        yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([wide])], names=["file", "wide"])


class EventReader(_Parts, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(self.path, listed(self.path, self.kind), self.kind, self.layouts, self.most) or [Range("", 0, 0, "none")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.layout != "none" else iter(())


class EventStreamReader(_Parts, DataSourceStreamReader):
    def _steps(self) -> list[tuple[str, list[tuple[str, int]]]]:
        """(name, files) of each commit, or of each file where there are no commits, in order."""
        from pyarrow import fs

        store, place = opened(self.path)
        own = fs.FileSelector(f"{place}/{COMMITS}", allow_not_found=True)
        commits = sorted(f.path for f in store.get_file_info(own) if f.base_name[0] not in "._")
        if not commits:
            return [(f.rsplit("/", 1)[-1], [(f, size)]) for f, size in listed(self.path, self.kind)]
        out = []
        for c in commits:
            with store.open_input_file(c) as f:
                out.append((c.rsplit("/", 1)[-1], [(f"{place}/{n}", size) for n, size in json.loads(f.read())]))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max([s[0] for s in self._steps()], default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = [f for name, own in self._steps() if start["after"] < name <= end["after"] for f in own]
        return ranges(self.path, files, self.kind, self.layouts, self.most) or [Range("", 0, 0, "none")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.layout != "none" else iter(())


@dataclass
class Part(WriterCommitMessage):
    draft: str
    name: str
    size: int


class EventWriter(DataSourceArrowWriter):
    """Packed files, one a task. Times are cut to whole microseconds of 32 bits."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        store, place = opened(self.path)
        task, size = TaskContext.get(), 0
        store.create_dir(place)
        draft = f"{place}/.{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        with store.open_output_stream(draft) as out:
            for batch in iterator:
                t, x, y, p = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "txyp")
                v = (t.astype("u8") << np.uint64(32)) | (x.astype("u8") << np.uint64(16)) | (y.astype("u8") << np.uint64(1)) | (p > 0)
                out.write(v.astype("<u8").tobytes())
                size += 8 * len(v)
        return Part(draft, f"part-{task.partitionId():06d}-{self.job}.bin", size)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, place = opened(self.path)
        store.create_dir(f"{place}/{COMMITS}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]
        commits = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(f"{place}/{COMMITS}")))
        parts = [m for m in messages if m]
        for m in parts:
            store.move(m.draft, f"{place}/{m.name}")
        number = f"{int(commits[-1]) + 1 if commits else 0:012d}"
        with store.open_output_stream(f"{place}/.{number}-{self.job}") as out:
            out.write(json.dumps([(m.name, m.size) for m in parts if m.size]).encode())
        store.move(f"{place}/.{number}-{self.job}", f"{place}/{COMMITS}/{number}")
        taken = {m.draft for m in parts}
        for f in files:  # what other attempts left, and earlier files that go
            if f not in taken and (self.overwrite or f.rsplit("/", 1)[-1].startswith(f".{self.job}")):
                store.delete_file(f)
        for c in commits if self.overwrite else []:
            store.delete_file(f"{place}/{COMMITS}/{c}")

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, place = opened(self.path)
        for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}"):
                store.delete_file(f.path)


def _source(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EventFiles)
    return spark


def read_files(spark: SparkSession, path: str, kind: str, layout: str | None = None, **options: str) -> DataFrame:
    """(t, x, y, p) of packed or archived files. Packed files whose coordinates come out beyond 4096 anywhere
    are four 32-bit integers an event instead: a pass over all ranges finds out, unless layout (packed or
    ints) says so. An empty folder has no rows."""
    rows = _source(spark).read.format("events").options(kind=kind, **options)
    layouts = {"": layout} if layout else {}
    if kind == "bin" and not layout:
        probed = rows.option("probe", "true").load(path).groupBy("file").agg(F.bool_or("wide").alias("wide")).where("wide")
        layouts = {r.file: "ints" for r in probed.collect()}  # a row a file that isn't packed
        rows = _source(spark).read.format("events").options(kind=kind, **options)
    return rows.option("layouts", json.dumps(layouts)).load(path)


def stream_files(spark: SparkSession, path: str, kind: str = "bin", layout: str = "packed", **options: str) -> DataFrame:
    """The same as a stream: what is committed to the folder, or put there by ascending names."""
    return _source(spark).readStream.format("events").options(kind=kind, layouts=json.dumps({"": layout}), **options).load(path)


def write_files(events: DataFrame, path: str, mode: str = "append") -> None:
    """Packed files below a folder that all executors can write: all of them are committed at once, or none."""
    _source(events.sparkSession)
    events.selectExpr("double(t) AS t", "int(x) AS x", "int(y) AS y", "int(p) AS p").write.format("events").mode(mode).save(path)
