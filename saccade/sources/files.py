"""File sources and sinks for event streams: CSV, NPZ, packed binary, Parquet."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.functions.schema import HEIGHT, WIDTH
from saccade.sources import packed as ranges

#: Column names that mean time and polarity (fixed values).
ALIASES = {"timestamp_us": "t", "timestamp": "t", "ts": "t", "time": "t", "pol": "p", "polarity": "p"}
SCHEMA = "t double, x int, y int, p int"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(t, x, y, p) from files by their extension; rows keep no order of their own."""
    if not path:
        raise ValueError("a path is needed; use generators.objects for synthetic scenes")
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "txt": read_csv, "npz": read_npz, "bin": read_bin, "parquet": lambda s, p: s.read.parquet(p)}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind} files")
    return readers[kind](spark, path)


def signed(p: Column) -> Column:
    return F.when(p > 0, 1).otherwise(-1)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header (aliases allowed) or, if its names aren't known, four columns t, x, y, p without one.
    Polarity may be a number or true and false. The files of a folder have one form: the first line found
    decides for all."""
    head = spark.read.text(path).first()
    names = [c.strip().strip('"').lower() for c in head.value.split(",")] if head else []
    names = [ALIASES.get(c, c) for c in names]
    if {"t", "x", "y", "p"} <= set(names):
        rows = spark.read.option("header", True).schema(", ".join(f"_{i} string" for i in range(len(names)))).csv(path)
        rows = rows.select(*[F.trim(f"_{names.index(c)}").alias(c) for c in ("t", "x", "y", "p")])
    else:
        rows = spark.read.schema("t string, x string, y string, p string").csv(path)
        rows = rows.select(*[F.trim(c).alias(c) for c in ("t", "x", "y", "p")])
    number = lambda c: F.col(c).try_cast("double")
    truth = F.lower("p")
    p = F.when(truth == "true", 1.0).when(truth == "false", 0.0).otherwise(number("p"))
    return rows.select(number("t").alias("t"), number("x").cast("int").alias("x"), number("y").cast("int").alias("y"), signed(p).alias("p"))


def _by_ranges(path: str) -> bool:
    """Whether files can be read in ranges: their store must be one that pyarrow knows."""
    try:
        ranges.opened(path)
    except Exception:  # other stores are left to Spark, a whole file at a time
        return False
    return True


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Arrays t, x, y, p of each file; polarity as it is. Stored arrays are read in ranges by several tasks; files in
    stores that only Spark knows are one task's work each. Sizes of sensors: sizes_of()."""
    if _by_ranges(path):
        return ranges.read_files(spark, path, "npz")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content)) as f:
                    yield pd.DataFrame({"t": f["t"].astype("f8"), "x": f["x"].astype("i4"), "y": f["y"].astype("i4"), "p": f["p"].astype("i4")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(take, SCHEMA)


def sizes_of(spark: SparkSession, path: str, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(path, width, height) of NPZ files: their W and H, or those given where a file has none."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for content in batch["content"]:
                with np.load(io.BytesIO(content)) as f:
                    found.append((int(f["W"]) if "W" in f else width, int(f["H"]) if "H" in f else height))
            yield pd.DataFrame({"path": batch["path"], "width": [w for w, _ in found], "height": [h for _, h in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(take, "path string, width int, height int")


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    """Packed 64-bit events (t << 32 | x << 16 | y << 1 | p, p 1 or 0); files whose coordinates come
    out above 4096 are four 32-bit integers an event instead. Files are read in ranges by several tasks; in
    stores that only Spark knows, a file is one task's work."""
    if _by_ranges(path):
        return ranges.read_files(spark, path, "bin")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                v = np.frombuffer(content[: len(content) // 8 * 8], "<u8")
                t, x, y = v >> np.uint64(32), v >> np.uint64(16) & np.uint64(0xFFFF), v >> np.uint64(1) & np.uint64(0x7FFF)
                p = np.where(v & np.uint64(1), 1, -1)
                if len(v) and max(x.max(), y.max()) > 4096:
                    w = np.frombuffer(content[: len(content) // 16 * 16], "<i4").reshape(-1, 4)
                    t, x, y, p = w[:, 0], w[:, 1], w[:, 2], np.where(w[:, 3] > 0, 1, -1)
                yield pd.DataFrame({"t": t.astype("f8"), "x": x.astype("i4"), "y": y.astype("i4"), "p": p.astype("i4")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(take, SCHEMA)


def packed(t: Column, x: Column, y: Column, p: Column) -> Column:
    bit = F.when(p > 0, 1).otherwise(0).cast("long")
    return F.shiftleft(t.cast("long"), 32).bitwiseOR(F.shiftleft(x.cast("long"), 16)).bitwiseOR(F.shiftleft(y.cast("long"), 1)).bitwiseOR(bit)


def unpacked(v: Column) -> list[Column]:
    return [
        F.shiftrightunsigned(v, 32).alias("t"),
        F.shiftrightunsigned(v, 16).bitwiseAND(F.lit(65535)).cast("int").alias("x"),
        F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(32767)).cast("int").alias("y"),
        F.when(v.bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1).alias("p"),
    ]


def write_csv(events: DataFrame, path: str) -> None:
    rows = events.select(F.format_string("%.1f", "t").alias("timestamp_us"), "x", "y", F.col("p").alias("polarity"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_npz(events: DataFrame, uri: str, width: int = WIDTH, height: int = HEIGHT) -> list[str]:
    """An archive of arrays t, x, y, p and W, H for each partition of events, in order of time, below uri
    (file://, hdfs:// or the like, which all executors can write). A part is written under a name of its
    attempt first, so that a task that runs again leaves one file. Returns the files' names."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        parts = list(batches)
        if parts:
            rows, task = pd.concat(parts).sort_values(["t"], kind="stable"), TaskContext.get()
            store, folder = fs.FileSystem.from_uri(uri)
            store.create_dir(folder)
            name = f"part-{task.partitionId():05d}.npz"
            draft = f"{folder}/.{name}-{task.taskAttemptId()}"
            made = io.BytesIO()
            np.savez(made, t=rows["t"].to_numpy("f8"), x=rows["x"].to_numpy("i2"), y=rows["y"].to_numpy("i2"), p=rows["p"].to_numpy("i1"), W=width, H=height)
            with store.open_output_stream(draft) as out:
                out.write(made.getvalue())
            store.move(draft, f"{folder}/{name}")
            yield pd.DataFrame({"file": [name]})

    return sorted(r.file for r in events.select("t", "x", "y", "p").mapInPandas(save, "file string").collect())  # a name a partition


def write_bin(events: DataFrame, path: str) -> None:
    """Packed files, one a partition, below path (file://, hdfs:// or the like, which all executors can write)."""
    ranges.write_files(events, path, "overwrite")


def write_results(scores: DataFrame, path: str) -> None:
    """Scores (detector, filter, scene, accuracy) or a report's rows, as lines of JSON."""
    scores.write.mode("overwrite").json(path)


def write_parquet(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").parquet(path)
