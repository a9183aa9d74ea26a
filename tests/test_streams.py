"""Streams with state against batches: any order of files, restarts, late rows, and what is left in the state."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.operators import clustering, denoise, tracking
from saccade.plans import registry
from saccade.sources.adapter import replay_events
from saccade.streaming import stateful
from saccade.streaming import streams as live

DETECTION = registry.DETECTION
COLS = ["scene", "track_id", "seq", "window_id", "cluster_id"]
FOLDER = "/root/testdata/sf0.001"


def detections(seed=2, windows=60):
    rng = np.random.default_rng(seed)
    return [(s, w, c, float(x), float(y)) for s in ("a", "b") for w in range(windows) for c, (x, y) in enumerate(rng.uniform(0, 120, (2, 2)))]


def folder_of(spark, tmp_path, rows, files=4):
    path, table = str(tmp_path / "in"), spark.createDataFrame(rows, DETECTION)
    for i in range(files):
        table.where(F.pmod(F.hash("window_id", "cluster_id"), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(path)
    return path, table


def test_shuffled_files_and_restarts_give_the_batchs_tracks(spark, tmp_path):
    path, table = folder_of(spark, tmp_path, detections())
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        stream = spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1).parquet(path)
        return live.run(stateful.link_stream(stream, late="2 seconds"), out, state)

    assert stateful.late_rows(go()) == 0
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(state)
    assert waiting.count() == table.count()  # all wait for the watermark
    spark.createDataFrame([("end", 500, 0, 0.0, 0.0)], DETECTION).write.mode("append").parquet(path)  # 2.5 s: releases the first half second
    go()
    opened = spark.read.format("statestore").option("stateVarName", "open").load(state)
    assert 0 < opened.count() <= 2 * 2 * 4 or opened.isEmpty()
    spark.createDataFrame([("end", 1_000_000, 0, 0.0, 0.0)], DETECTION).write.mode("append").parquet(path)
    go()
    got = spark.read.parquet(out).where("scene <> 'end'")
    want = tracking.link(table, scene=["scene"])
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, want.select(*COLS).collect()))
    for name in ("open", "waiting", "next"):  # ended scenes leave nothing behind
        rest = spark.read.format("statestore").option("stateVarName", name).load(state)
        assert rest.where("key.scene <> 'end'").isEmpty(), name


def test_tracks_leave_the_state_after_their_gap(spark, tmp_path):
    path, _ = folder_of(spark, tmp_path, [("a", 0, 0, 5.0, 5.0), ("b", 0, 0, 5.0, 5.0), ("b", 190, 0, 5.0, 5.0)], 1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame([("end", 220, 0, 0.0, 0.0)], DETECTION).write.mode("append").parquet(path)
    for _ in range(2):
        live.run(stateful.link_stream(spark.readStream.schema(DETECTION).parquet(path), late="0 seconds", step_ms=10), out, state)
    opened = spark.read.format("statestore").option("stateVarName", "open").load(state)
    assert opened.count() == 0
    nexts = spark.read.format("statestore").option("stateVarName", "next").load(state).select("key.scene", "value.*").collect()
    assert sorted(map(tuple, nexts)) == [("a", 1, 0), ("b", 2, 190)]


def test_rows_after_the_watermark_are_counted_and_dropped(spark, tmp_path):
    path, _ = folder_of(spark, tmp_path, [("a", w, 0, 5.0, 5.0) for w in range(3)] + [("a", 3000, 0, 5.0, 5.0)], 1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: stateful.link_stream(spark.readStream.schema(DETECTION).parquet(path), late="1 second")
    assert stateful.late_rows(live.run(stream(), out, state)) == 0
    spark.createDataFrame([("a", 1, 1, 5.0, 5.0), ("a", 2990, 1, 5.0, 5.0)], DETECTION).write.mode("append").parquet(path)
    assert stateful.late_rows(live.run(stream(), out, state)) == 1
    got = sorted((r.window_id, r.cluster_id) for r in spark.read.parquet(out).collect())
    assert (1, 1) not in got and got == [(0, 0), (1, 0), (2, 0)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_streams_give_their_batches_rows(spark):
    got = registry.QUERIES["streaming_track_link"](spark, FOLDER).select(*COLS[1:])
    d = clustering.DETECTORS["DBSCAN"]
    want = tracking.link(clustering.detect(replay_events(spark, FOLDER), d)[1], d.link_px, d.max_gap).select(*COLS[1:])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    adaptive = registry.QUERIES["density_adaptive_decayed"](spark, FOLDER).where("keep").select("event_id", "radius").collect()
    live_ids = {r.event_id for r in registry.QUERIES["streaming_density_adaptive"](spark, FOLDER).collect()}
    assert live_ids == {r.event_id for r in adaptive} and {r.radius for r in adaptive} == set(denoise.RADII)


def test_no_key_of_the_noise_filter_grows_with_the_stream(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(4000).selectExpr("id AS event_id", "id * 15.0D AS t", "int(id * 37 % 346) AS x", "int(id * id % 260) AS y", "1 AS p")
    rows.write.parquet(path)
    stream = lambda: stateful.noise_stream(spark.readStream.schema(rows.schema).parquet(path), 5, slab_us=10_000)
    live.run(stream(), out, state)
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(state)
    sizes = [r.n for r in waiting.groupBy("key").agg(F.sum(F.size("list_element.t")).alias("n")).collect()]
    assert max(sizes) < 1000  # a slab's 667 events and the 533 before it, in nine tiles; a third of all before
    spark.createDataFrame([(10**9, 10.0**9, 0, 0, 1)], rows.schema).write.mode("append").parquet(path)
    for _ in range(2):
        live.run(stream(), out, state)
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert got == sorted(r.event_id for r in denoise.ba_filter(rows, 5).collect()) and got
    assert spark.read.format("statestore").option("stateVarName", "last").load(state).isEmpty()  # ended slabs leave nothing
