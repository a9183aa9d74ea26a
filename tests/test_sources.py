"""Packed and archived event files as a data source."""

from __future__ import annotations

import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.sources import files, packed

EVENTS = "t double, x int, y int, p int"


def events(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(float(t), int(x), int(y), int(p)) for t, x, y, p in zip(np.sort(rng.integers(0, 1 << 31, n)), rng.integers(0, 346, n), rng.integers(0, 260, n), rng.choice([-1, 1], n), strict=True)]


def rows_of(df):
    return sorted(map(tuple, df.select("t", "x", "y", "p").collect()))


def packed_bytes(rows):
    return b"".join(struct.pack("<Q", int(t) << 32 | x << 16 | y << 1 | (p > 0)) for t, x, y, p in rows)


def test_a_file_is_read_in_ranges_by_several_tasks(spark, tmp_path):
    rows = events(1003)
    (tmp_path / "a.bin").write_bytes(packed_bytes(rows) + b"abc")  # an event that isn't whole is left out
    got = packed.read_files(spark, str(tmp_path / "a.bin"), "bin", range="100")
    assert got.rdd.getNumPartitions() == 11 and rows_of(got) == sorted(rows)
    per = got.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in per) == [3] + [100] * 10


def test_bounds_on_time(spark, tmp_path):
    rows = events(500)
    (tmp_path / "a.bin").write_bytes(packed_bytes(rows))
    lo, hi = rows[100][0], rows[300][0]
    for options in ({}, {"sorted": "true"}):
        source = packed.read_files(spark, str(tmp_path / "a.bin"), "bin", range="64", start=str(lo), stop=str(hi), **options)
        assert rows_of(source) == [r for r in sorted(rows) if lo <= r[0] < hi]
        assert rows_of(source.where("x > 100")) == [r for r in sorted(rows) if lo <= r[0] < hi and r[1] > 100]
        assert source.where("x = 3 OR x > 100").count() == sum(lo <= r[0] < hi and (r[1] == 3 or r[1] > 100) for r in rows)
    half = packed.read_files(spark, str(tmp_path / "a.bin"), "bin", start=str(hi))
    assert half.where(f"t > {hi}D").count() + 1 == half.count() == 200


def test_ranges_outside_the_times_are_not_read(tmp_path):
    rows = events(1000)
    (tmp_path / "a.bin").write_bytes(packed_bytes(rows))
    reader = packed.EventReader({"path": str(tmp_path / "a.bin"), "range": "100", "sorted": "true", "start": str(rows[250][0]), "stop": str(rows[350][0])})
    read = [sum(b.num_rows for b in reader.read(r)) for r in reader.partitions()]
    assert [i for i, n in enumerate(read) if n] == [2, 3] and sum(read) == 100


def test_layout_of_four_integers_shows_in_any_range(spark, tmp_path):
    """Only the last events' coordinates are too large for packed ones."""
    rows = [(float(t), 10, 20, 1) for t in range(50)] + [(900_000.0, 345, 259, -1)]
    (tmp_path / "ints").mkdir()
    (tmp_path / "ints" / "a.bin").write_bytes(b"".join(struct.pack("<4i", int(t), x, y, int(p > 0)) for t, x, y, p in rows))
    (tmp_path / "ints" / "b.bin").write_bytes(packed_bytes(rows))
    assert rows_of(packed.read_files(spark, str(tmp_path / "ints"), "bin", range="7")) == sorted(rows + rows)
    assert rows_of(files.read_bin(spark, str(tmp_path / "ints" / "a.bin"))) == sorted(rows)
    assert packed.read_files(spark, str(tmp_path / "ints" / "b.bin"), "bin", "packed").count() == 51


def test_archives_are_read_in_ranges_unless_compressed(spark, tmp_path):
    rows = events(300)
    t, x, y, p = (np.array(c) for c in zip(*rows, strict=True))
    np.savez(tmp_path / "a.npz", t=t, x=x.astype("i2"), y=y.astype("u2"), p=p.astype("i1"), W=346)
    np.savez_compressed(tmp_path / "b.npz", t=t.astype("i8"), x=x, y=y, p=p)
    a, b = (packed.read_files(spark, str(tmp_path / n), "npz", range="50") for n in ("a.npz", "b.npz"))
    assert (a.rdd.getNumPartitions(), b.rdd.getNumPartitions()) == (6, 1)
    assert rows_of(a) == rows_of(b) == sorted(rows)
    early = [packed.read_files(spark, str(tmp_path / n), "npz", stop=str(rows[10][0])).count() for n in ("a.npz", "b.npz")]
    assert early == [sum(r[0] < rows[10][0] for r in rows)] * 2
    both = files.read_npz(spark, f"file://{tmp_path}")
    assert both.count() == 600 and files.read_events(spark, str(tmp_path / "a.npz")).count() == 300


def test_writing_commits_all_parts_or_none(spark, tmp_path):
    rows, path = events(400), str(tmp_path / "out.bin")
    table = spark.createDataFrame(rows, EVENTS).repartition(3)
    packed.write_files(table, path)
    assert rows_of(files.read_events(spark, path)) == sorted(rows)
    packed.write_files(table, path)
    assert files.read_events(spark, path).count() == 800 and sorted(os.listdir(f"{path}/_commits")) == ["000000000000", "000000000001"]
    with pytest.raises(Exception, match="boom"):
        packed.write_files(table.withColumn("t", F.when(F.col("x") > 340, F.raise_error(F.lit("boom"))).otherwise(F.col("t"))), path)
    assert files.read_events(spark, path).count() == 800 and not [n for n in os.listdir(path) if n.startswith(".")]
    files.write_bin(table.limit(5), path)
    assert files.read_events(spark, path).count() == 5
    listed = [json.load(open(f"{path}/_commits/{c}")) for c in os.listdir(f"{path}/_commits")]
    assert len(listed) == 1 and sum(size for _, size in listed[0]) == 40


def test_a_stream_of_files_goes_on_where_it_stopped(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    one, two = events(100, 1), events(150, 2)

    def run():
        packed.stream_files(spark, path, range="40").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return rows_of(spark.read.parquet(out))

    packed.write_files(spark.createDataFrame(one, EVENTS), path)
    assert run() == sorted(one)
    assert run() == sorted(one)  # nothing new
    packed.write_files(spark.createDataFrame(two, EVENTS).repartition(2), path)
    assert run() == sorted(one + two)
    (tmp_path / "named").mkdir()
    (tmp_path / "named" / "000.bin").write_bytes(packed_bytes(one))
    reader = packed.EventStreamReader({"path": str(tmp_path / "named")})
    first = reader.latestOffset()
    (tmp_path / "named" / "001.bin").write_bytes(packed_bytes(two))
    assert [(r.file[-7:], r.last) for r in reader.partitions(first, reader.latestOffset())] == [("001.bin", 150)]
    assert [r.layout for r in reader.partitions(first, first)] == ["none"]


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        files.read_bin(spark, str(tmp_path / "nowhere.bin")).count()
    (tmp_path / "empty.bin").mkdir()
    assert files.read_bin(spark, str(tmp_path / "empty.bin")).count() == 0
    buffer = io.BytesIO()
    np.savez(buffer, t=np.zeros(0), x=np.zeros(0, "i2"), y=np.zeros(0, "i2"), p=np.zeros(0, "i1"))
    (tmp_path / "none.npz").write_bytes(buffer.getvalue())
    assert files.read_npz(spark, str(tmp_path / "none.npz")).count() == 0
