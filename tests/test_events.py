"""Hand-made cases of the event operators, and known counts on the test tables."""

from __future__ import annotations

import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.functions.schema import RAIN, SNOW
from saccade.operators import clustering, denoise, features, nearest, streams, tracking
from saccade.sources import adapter, files, generators

EVENTS = "event_id long, t double, x int, y int, p int, label int"
TESTDATA = "/root/testdata"
needs_tables = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.001"), reason="no test tables")


def stream(spark, rows):
    """Events from (t, x, y[, p[, label]])."""
    full = [(i, float(r[0]), r[1], r[2], *(r[3:] or (1,)), *([] if len(r) > 4 else [0])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


# Noise filters


def brute_noise(rows, radius, dt):
    return [i for i, (t, x, y) in enumerate(rows) if any(abs(x - a) <= radius and abs(y - b) <= radius and s > t - dt for s, a, b in rows[:i])]


def test_noise_filter_borders(spark):
    rows = [(0, 50, 50), (8000, 50, 50), (15999, 50, 50), (15999, 52, 52), (15999, 300, 200), (16500, 303, 200)]
    kept = {r.event_id for r in denoise.ba_filter(stream(spark, rows), 2).collect()}
    assert kept == set(brute_noise(rows, 2, 8000)) == {2, 3}  # exactly dt later is too late; equal times go by event_id


@pytest.mark.parametrize("mode", ["multi_scale", "density_adaptive", "ba_filter"])
def test_noise_filter_matches_brute_force(spark, mode):
    rng = random.Random(1)
    rows = sorted((float(rng.randint(0, 60_000)), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(300))
    radius = {"multi_scale": 10, "density_adaptive": 8, "ba_filter": 2}[mode]
    got = sorted(r.event_id for r in denoise.denoise(stream(spark, rows), mode).collect())
    assert got == brute_noise(rows, radius, 8000.0)


def test_noise_filter_refuses_unknown_modes_and_takes_no_rows(spark):
    with pytest.raises(ValueError, match="mode"):
        denoise.denoise(stream(spark, [(0, 1, 1)]), "other")
    assert denoise.denoise(stream(spark, [(0, 1, 1)]).limit(0)).count() == 0


def test_noise_filters_send_no_side_of_a_join_to_all(spark):
    rows = stream(spark, [(i * 40.0, 7 * i % 346, 11 * i % 260) for i in range(400)])
    for least in (1, 3):
        kept = denoise.ba_filter(rows, 10, min_neighbours=least)
        kept.collect()
        assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_noise_filters_make_few_copies_of_an_event(spark):
    rows = stream(spark, [(i * 40.0, 7 * i % 346, 11 * i % 260) for i in range(4000)])
    new, old, _ = denoise._near(rows, 10, 8000.0)
    assert new.count() == rows.count() and old.count() < 4 * rows.count()  # 18 copies before


# Slices and windows


def test_reader_windows_drop_the_last_event_on_a_border(spark):
    rows = stream(spark, [(0, 1, 1), (4999, 1, 1), (5000, 1, 1), (10_000, 1, 1)])
    read = {r.event_id: r.window_id for r in streams.time_windows(rows, 5000.0).collect()}
    assert read == {0: 0, 1: 0, 2: 1}
    assert {r.event_id: r.window_id for r in streams.with_window(rows, 5000.0).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}
    assert streams.time_windows(stream(spark, [(7, 1, 1), (7, 2, 2)]), 5000.0).count() == 0


def test_summary_of_one_instant_has_no_rate(spark):
    r = streams.summary(stream(spark, [(7, 1, 2), (7, 3, 4, -1)])).first()
    assert (r.n_events, r.duration_us, r.event_rate, r.n_pos, r.n_neg, r.pos_pct) == (2, 0.0, 0.0, 1, 1, 50.0)
    assert streams.summary(stream(spark, [(7, 1, 2)]).limit(0)).first().n_events == 0


# Clustering


def labels_of(points, eps, k=5):
    x, y = (np.array(c, "f8") for c in zip(*points, strict=True))
    e = np.broadcast_to(np.asarray(eps, "f8"), x.shape)
    return clustering.expand(clustering._adjacent(x, y, None, e), np.full(len(x), k)).tolist()


def test_a_seed_needs_k_others():
    assert labels_of([(0, 0)] * 5, 10) == [-1] * 5
    assert labels_of([(0, 0)] * 6, 10) == [0] * 6


def test_points_that_are_not_core_bridge_only_after_the_seed():
    chain, seed = [(9, 0), (17, 0), (25, 0)], [(0, 0)] * 6  # the chain's own radius doesn't reach the seed
    assert labels_of(seed + chain, [10.0] * 6 + [8.5] * 3) == [0] * 9
    assert labels_of(chain + seed, [8.5] * 3 + [10.0] * 6) == [0, 0, -1] + [0] * 6


def slow_kernel(x, y, eps, k):
    """The kernel point by point, with a stack of single points."""
    near = [np.flatnonzero(np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2) <= eps[i]) for i in range(len(x))]
    labels, reached, cluster = np.full(len(x), -1), np.zeros(len(x), bool), 0
    for i in range(len(x)):
        if reached[i]:
            continue
        reached[i] = True
        if len(near[i]) <= k[i]:
            continue
        labels[near[i]] = cluster
        queue = near[i].tolist()
        while queue:
            j = queue.pop()
            reached[j] = True
            if len(near[j]) >= 2:
                labels[near[j]] = cluster
                for m in near[j][~reached[near[j]]].tolist():
                    reached[m] = True
                    if m not in queue:
                        queue.append(m)
        cluster += 1
    return labels


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_waves_over_cells_give_the_kernels_labels(monkeypatch, most):
    monkeypatch.setattr(clustering, "CANDIDATES", most)
    rng = np.random.default_rng(11)
    for _ in range(60):
        n = int(rng.integers(0, 160))
        x, y = rng.integers(0, rng.choice([30, 120]), n).astype("f8"), rng.integers(0, rng.choice([1, 90]), n).astype("f8")
        eps, k = rng.uniform(0.9, 12, n), rng.integers(1, 7, n)
        near = clustering._adjacent(x, y, None, eps)
        want = [set(np.flatnonzero(np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2) <= eps[i])) for i in range(n)]
        assert [set(near.of[a:b]) for a, b in zip(near.start[:-1], near.start[1:], strict=True)] == want
        assert clustering.expand(near, k).tolist() == slow_kernel(x, y, eps, k).tolist()
    z = rng.uniform(0, 5, n)
    deep = clustering._adjacent(x, y, z, eps)
    assert all(np.sqrt((x[o] - x[i]) ** 2 + (y[o] - y[i]) ** 2 + (z[o] - z[i]) ** 2) <= eps[i] for i in range(n) for o in deep.of[deep.start[i] : deep.start[i + 1]])


def test_later_clusters_take_border_points():
    points, eps = [(0, 0)] * 6 + [(9, 0)] + [(18, 0)] * 6, [10.0] * 6 + [0.9] + [10.0] * 6
    assert labels_of(points, eps) == [0] * 6 + [1] * 7


def test_thresholds_grow_towards_the_corners(spark):
    rows = stream(spark, [(0, 173, 130), (1, 0, 0)]).select("event_id", clustering.k_dual(5, 42.0, 25.0).alias("k"))
    assert {r.event_id: r.k for r in rows.collect()} == {0: 5, 1: 8}


def test_windows_with_few_events_and_third_dimension(spark):
    close = [(i, 100, 100) for i in range(7)]
    far = [(5000 + 600 * i, 100, 100) for i in range(7)]
    flat, deep = clustering.DETECTORS["DBSCAN"], clustering.DETECTORS["3D-DBSCAN"]
    found = clustering.detect(stream(spark, close + far + [(11_000, 5, 5)]), flat)[1].collect()
    assert sorted((r.window_id, r.n_events) for r in found) == [(0, 7), (1, 7)]
    assert sorted((r.window_id, r.n_events) for r in clustering.detect(stream(spark, close + far), deep)[1].collect()) == [(0, 7), (1, 7)]
    assert clustering.detect(stream(spark, close).limit(0), flat)[1].count() == 0


@needs_tables
@pytest.mark.parametrize(("name", "n_found", "noise", "n_tracks", "n_long"), [("DBSCAN", 41, 546, 10, 4), ("ADB-Opt", 34, 629, 6, 5), ("Dual-Opt", 16, 800, 7, 0)])
def test_detectors_give_the_known_counts(spark, name, n_found, noise, n_tracks, n_long):
    d = clustering.DETECTORS[name]
    clusters, found = clustering.detect(adapter.replay_events(spark, f"{TESTDATA}/sf0.001"), d)
    assert found.count() == n_found and clusters.where("cluster_id < 0").count() == noise
    members = tracking.link(found, d.link_px, d.max_gap)
    assert members.select("track_id").distinct().count() == n_tracks
    assert tracking.long_tracks(members, 4).select("track_id").distinct().count() == n_long


@needs_tables
def test_noise_filters_give_the_known_counts(spark):
    rows = adapter.replay_events(spark, f"{TESTDATA}/sf0.001")
    assert denoise.denoise(rows, "multi_scale").count() == denoise.ba_filter(rows, 10).count() == 819
    assert denoise.denoise(rows, "density_adaptive").count() == 780


# Tracks


def test_linker():
    one = tracking.Linker(40.0, 3)
    assert [one.add(0, 0, 0), one.add(0, 60, 0), one.add(1, 30, 0)] == [(0, 0), (1, 0), (0, 1)]  # the older track wins a tie
    two = tracking.Linker(40.0, 3)
    assert [two.add(0, 0, 0), two.add(0, 10, 0)] == [(0, 0), (0, 1)]  # one window, one track
    three = tracking.Linker(40.0, 3)
    assert [three.add(0, 0, 0), three.add(3, 0, 0), three.add(7, 0, 0)] == [(0, 0), (0, 1), (1, 0)]  # gaps of 3 and of 4
    four = tracking.Linker(40.0, 3)
    assert [four.add(0, 0, 0), four.add(1, 40, 0)] == [(0, 0), (1, 0)]  # exactly 40 is too far


def test_links_stay_inside_scenes(spark):
    rows = spark.createDataFrame([(s, w, 0, 10.0, 10.0) for s in ("a", "b") for w in range(3)], "scene string, window_id long, cluster_id long, cx double, cy double")
    got = sorted(tuple(r) for r in tracking.link(rows, scene=["scene"]).select("scene", "track_id", "seq").collect())
    assert got == [(s, 0, i) for s in ("a", "b") for i in range(3)]


DETECTED = "window_id long, cluster_id long, cx double, cy double"


def one_pass(rows, link_px=40.0, max_gap=3):
    one = tracking.Linker(link_px, max_gap)
    return sorted((*one.add(w, x, y), w, c) for w, c, x, y in sorted(rows))


@pytest.mark.parametrize(("span", "warm", "extent", "whole"), [(4, 0, 90, False), (5, 2, 150, False), (7, 7, 60, True), (32, 16, 200, False)])
def test_blocks_are_linked_as_one_stream_would_be(spark, monkeypatch, span, warm, extent, whole):
    """Blocks that begin with a wrong state, tracks over many blocks, gaps, and ties between old tracks (whole numbers)."""
    monkeypatch.setattr(tracking, "BLOCK", 7)
    rng, rows, w = random.Random(span), [], -9
    for _ in range(70):
        place = lambda: float(rng.randrange(0, extent, 10)) if whole else rng.uniform(0, extent)
        rows += [(w, c, place(), place()) for c in range(rng.randint(1, 3))]
        w += rng.choice([1, 1, 1, 2, 3, 4, 5]) if len(rows) % 40 else 30
    got = tracking.link(spark.createDataFrame(rows, DETECTED), span=span, warm=warm)
    assert sorted(tuple(r) for r in got.select("track_id", "seq", "window_id", "cluster_id").collect()) == one_pass(rows)


def test_ties_go_to_the_older_track_over_blocks(spark):
    """Two tracks cross blocks; the one that was first in a block is the younger one, and a tie between them comes later."""
    rows = [(0, 0, 0.0, 0.0), (1, 0, 100.0, 0.0), (3, 0, 100.0, 0.0), (4, 0, 0.0, 0.0), (5, 0, 100.0, 0.0), (6, 0, 0.0, 0.0), (7, 0, 100.0, 0.0), (8, 0, 50.0, 0.0), (9, 0, 60.0, 0.0)]
    got = tracking.link(spark.createDataFrame(rows, DETECTED), link_px=60.0, span=4, warm=1)
    assert sorted(tuple(r) for r in got.select("track_id", "seq", "window_id", "cluster_id").collect()) == one_pass(rows, 60.0)


def test_no_group_of_linking_is_larger_than_a_block(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tracking, "_linked_blocks", lambda rows, *a, f=tracking._linked_blocks: (seen.append(rows), f(rows, *a))[1])
    rows = [(w, c, 5.0 * c, 3.0 * (w % 4)) for w in range(400) for c in range(2)]  # one could-link component
    got = tracking.link(spark.createDataFrame(rows, DETECTED))
    assert sorted(tuple(r) for r in got.select("track_id", "seq", "window_id", "cluster_id").collect()) == one_pass(rows)
    sizes = [r["count"] for r in seen[0].groupBy("_block").count().collect()]
    assert len(sizes) == 13 and max(sizes) <= 2 * (tracking.SPAN + tracking.WARM)


def test_linking_nothing(spark):
    assert tracking.link(spark.createDataFrame([], DETECTED)).count() == 0


def test_windows_of_scenes_begin_with_their_own_first_events(spark):
    rows = stream(spark, [(100, 1, 1), (5099, 1, 1), (7000, 1, 1), (12_100, 1, 1)]).withColumn("scene", F.when(F.col("event_id") < 2, "a").otherwise("b"))
    got = {r.event_id: r.window_id for r in streams.with_window(rows, 5000.0, ["scene"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1}


def test_pixel_and_lidar_radii(spark):
    rows = stream(spark, [(i, 100 + i % 3, 100) for i in range(20)] + [(30, 300, 200)])
    for kind in ("pixel", "lidar"):
        d = clustering.Detector(kind, 1e-4, -0.02, 10.0, radius_of=kind)
        dense = {r.event_id: (r.k, r.eps) for r in clustering.with_density(rows, d).collect()}
        k = max(1, math.floor(1e-4 * 300 * 300 - 0.02 * 300 + 10))
        eps = 1e-4 * 300 * 300 - 0.02 * 300 + 10 if kind == "pixel" else 0.7 * math.sqrt((300 - 100) * k / (21 * math.pi))
        assert dense[20][0] == k and math.isclose(dense[20][1], max(eps, 0.9))
        (r,) = clustering.eps_stats(clustering.with_density(rows, d)).collect()
        assert r.min <= r.mean <= r.max
        assert [x.n_clusters for x in clustering.n_clusters(clustering.kernel_clusters(rows, d)).collect()] == [1]


def test_vote_takes_the_lowest_of_equal_labels(spark):
    rows = spark.createDataFrame([(1, 3), (1, 2), (1, -1), (1, -1), (2, -1), (3, 11)], "track_id long, label int")
    assert {r.track_id: r.gt_class for r in tracking.vote(rows, ["track_id"]).collect()} == {1: 2, 2: -1, 3: 11}


# Features

TRACKED = "track_id long, seq long, cx double, cy double, x_min int, x_max int, y_min int, y_max int, n_events long, pol_ratio double, t_center double"


def brute_features(rows):
    cx, cy, t = (np.array([r[i] for r in rows], "f8") for i in (2, 3, 10))
    n, half = len(rows), len(rows) // 2
    dur = 1.0 if n == 1 else (t[-1] - t[0]) / 1000
    dx, dy = (c[-1] - c[0] if n <= 2 else c[half:].mean() - c[:half].mean() for c in (cx, cy))
    resid = None
    if n > 2:
        line = np.polyval(np.polyfit(t - t.mean(), cx, 1), t - t.mean()) if np.ptp(t) else np.full(n, cx.mean())
        resid = float(np.std(cx - line))
    osc = float(np.abs(np.fft.rfft(cy - cy.mean()))[1 : n // 2].max()) if n > 4 else 0.0
    return dur, dx / (dur + 1e-6), dy / (dur + 1e-6), math.hypot(dx, dy) / (dur + 1e-6), osc, resid


def test_track_features_match_brute_force(spark):
    rng = random.Random(3)
    tracks = {}
    for k, n in enumerate([1, 2, 3, 4, 5, 8, 13]):
        tracks[k] = [(k, j, rng.uniform(0, 300), rng.uniform(0, 200), 10, 10 + rng.randint(1, 30), 5, 5 + rng.randint(1, 30), rng.randint(5, 50), rng.random(), 2500.0 + 5000 * j) for j in range(n)]
    tracks[90] = [(90, j, float(j), 2.0 * j, 1, 5, 1, 5, 9, 0.5, 2500.0) for j in range(4)]  # all in one window
    rows = spark.createDataFrame([r for v in tracks.values() for r in v], TRACKED)
    for r in features.trajectory(rows, ["track_id"]).collect():
        mine = tracks[r.track_id]
        dur, sx, sy, speed, osc, resid = brute_features(mine)
        assert (r.duration_ms, r.n, r.total_events) == (dur, len(mine), sum(x[8] for x in mine))
        assert np.allclose([r.speed_x, r.speed_y, r.speed, r.osc_amp], [sx, sy, speed, osc], rtol=1e-6, atol=1e-6)
        assert r.width == np.median([x[5] - x[4] for x in mine]) and r.height == np.median([x[7] - x[6] for x in mine])
        assert (r.resid is None and r.straightness == 1.0) if resid is None else math.isclose(r.resid, resid, rel_tol=1e-6, abs_tol=1e-6)


def test_polarity_of_short_and_alternating_tracks(spark):
    rows = [(1, i, float(i), (-1) ** i) for i in range(4)] + [(2, i, float(i), 1) for i in range(3)] + [(3, i, float(i), p) for i, p in enumerate([1, 1, -1, -1, -1, 1])]
    events = spark.createDataFrame(rows, "track_id long, event_id long, t double, p int")
    got = {r.track_id: (r.n_events, r.flips, r.flip_rate, r.mean_run) for r in features.polarity(events, ["track_id"]).collect()}
    assert got == {1: (4, 3, 1.0, 1.0), 3: (6, 2, 0.4, 2.0)}  # three events are too few
    lengths = sorted((r.run, r.p, r.length) for r in features.runs(events, ["track_id"]).where("track_id = 3").collect())
    assert lengths == [(0, 1, 2), (1, -1, 3), (2, 1, 1)]


def test_sequences_are_thinned_or_filled(spark):
    events = spark.createDataFrame([(1, i, 10.0 * i, 173, 130, 1) for i in range(10)] + [(2, i, 1.0 * i, i % 346, 5, -1) for i in range(600)], "track_id long, event_id long, t double, x int, y int, p int")
    got = {r.track_id: np.array(r.seq) for r in features.sequences(events, ["track_id"]).collect()}
    assert got[1].shape == got[2].shape == (256, 4)
    assert np.allclose(got[1][9], [0.5, 0.5, 1.0, 1.0]) and not got[1][10:].any()
    assert np.allclose(got[2][:, 0] * 346, [math.floor(i * 600 / 256) % 346 for i in range(256)])


# Sources


def rows_of(df):
    return sorted((r.t, r.x, r.y, r.p) for r in df.collect())


WANT = [(1.0, 10, 20, 1), (2.5, 30, 40, -1)]


def test_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Timestamp_US,x,y,POL\n1,10,20,1\n2.5,30,40,0\n")
    (tmp_path / "b.txt").write_text("1,10,20,1\n2.5,30,40,-1\n")
    assert rows_of(files.read_events(spark, str(tmp_path / "a.csv"))) == rows_of(files.read_events(spark, str(tmp_path / "b.txt"))) == WANT
    files.write_csv(files.read_events(spark, str(tmp_path / "a.csv")), str(tmp_path / "out.csv"))
    assert rows_of(files.read_events(spark, str(tmp_path / "out.csv"))) == WANT


def test_csv_with_true_and_false(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,y,polarity\n1,10,20,True\n2.5,30,40,False\n")
    (tmp_path / "b.csv").write_text("1,10,20, true\n2.5,30,40,0\n")
    assert rows_of(files.read_events(spark, str(tmp_path / "a.csv"))) == rows_of(files.read_events(spark, str(tmp_path / "b.csv"))) == WANT


def test_archives_come_back_with_their_sizes(spark, tmp_path):
    events = spark.createDataFrame(WANT, "t double, x int, y int, p int")
    names = files.write_npz(events.coalesce(1), f"file://{tmp_path}/out", 640, 480)
    assert rows_of(files.read_npz(spark, f"file://{tmp_path}/out/{names[0]}")) == WANT and len(names) == 1
    np.savez(tmp_path / "plain.npz", t=np.zeros(1))
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for p in (f"file://{tmp_path}/out", f"file://{tmp_path}/plain.npz") for r in files.sizes_of(spark, p).collect()}
    assert sizes == {names[0]: (640, 480), "plain.npz": (346, 260)}


def test_npz_and_packed_files(spark, tmp_path):
    t, x, y, p = (np.array(c) for c in zip(*WANT, strict=True))
    np.savez(tmp_path / "a.npz", t=t, x=x.astype("i2"), y=y.astype("i2"), p=p.astype("i1"))
    assert rows_of(files.read_events(spark, str(tmp_path / "a.npz"))) == WANT
    whole = [(7.0, 10, 20, 1), (9.0, 345, 259, -1)]
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack("<Q", int(t) << 32 | x << 16 | y << 1 | (p > 0)) for t, x, y, p in whole))
    assert rows_of(files.read_events(spark, str(tmp_path / "a.bin"))) == whole
    (tmp_path / "b.bin").write_bytes(b"".join(struct.pack("<4i", int(t), x, y, int(p > 0)) for t, x, y, p in [(70_000.0, 10, 20, 1), (2_000_000.0, 345, 259, -1)]))
    assert rows_of(files.read_events(spark, str(tmp_path / "b.bin"))) == [(70_000.0, 10, 20, 1), (2_000_000.0, 345, 259, -1)]


def test_unknown_files_are_refused(spark):
    for path in ("a.h5", ""):
        with pytest.raises(ValueError, match=r"path|reader"):
            files.read_events(spark, path)


def test_scenes_are_the_same_however_they_are_dealt(spark):
    def total(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = generators.add_weather(generators.objects(spark), "medium", "light", 200_000.0)
        return rows.agg(F.count("*"), F.sum(F.xxhash64("t", "x", "y", "p", "label") % 1_000_003)).first()

    assert total(3) == total(4)
    scene = generators.objects(spark)
    assert 25_000 < scene.count() < 36_000
    weather = generators.add_weather(scene, "heavy", "medium", 200_000.0)
    counts = {r.label: r["count"] for r in weather.groupBy("label").count().collect()}
    assert set(counts) == {-1, 0, 1, 2, 3, 4, 5, RAIN, SNOW}
    ids = generators.numbered(scene)
    assert ids.agg(F.min("event_id"), F.max("event_id"), F.count_distinct("event_id")).first() == (0, scene.count() - 1, scene.count())


def brute_densities(rows, decay, half=4):
    """The map as it is, pixel by pixel and event by event."""
    m, out = np.zeros((260, 346)), []
    for _, x, y in rows:
        out.append(m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1].mean())
        m *= decay
        m[y, x] += 1
    return out


@pytest.mark.parametrize(("decay", "longest"), [(0.9, 65_536), (0.97, 16), (0.9995, 65_536), (0.999, 50)])
def test_local_density_matches_the_decayed_map(spark, monkeypatch, decay, longest):
    monkeypatch.setattr(denoise, "LONGEST", longest)
    rng = random.Random(5)
    rows = sorted((float(rng.randint(0, 30_000)), rng.choice([0, 1, 345, rng.randint(0, 20)]), rng.choice([0, 259, 258, rng.randint(0, 15)])) for _ in range(500))
    got = {r.event_id: r.density for r in denoise.local_density(stream(spark, rows), decay).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], brute_densities(rows, decay), rtol=1e-9, atol=1e-12)


def test_adaptive_radii_narrow_where_events_are_dense(spark):
    rng = random.Random(7)
    rows = sorted((float(rng.randint(0, 40_000)), rng.choice([50, 51, 52, rng.randint(40, 80)]), rng.choice([50, 51, rng.randint(30, 90)])) for _ in range(600))
    dense, radii = (0.1, 0.4), {}
    for i, d in enumerate(brute_densities(rows, 0.99)):
        radii[i] = 2 if d > dense[1] else 4 if d > dense[0] else 8
    assert set(radii.values()) == {2, 4, 8}
    want = [i for i, (t, x, y) in enumerate(rows) if any(abs(x - a) <= radii[i] and abs(y - b) <= radii[i] and s > t - 3000 for s, a, b in rows[:i])]
    got = denoise.density_adaptive(stream(spark, rows), 3000.0, 0.99, dense=dense)
    assert sorted(r.event_id for r in got.collect()) == want and len(want) < len(rows)
    assert got.columns == ["event_id", "t", "x", "y", "p", "label"]
    with pytest.raises(ValueError, match="decay"):
        denoise.local_density(stream(spark, rows), 1.0)


def test_default_densities_never_narrow_the_radius(spark):
    plan = denoise.with_radius(stream(spark, [(0, 1, 1)]))
    assert [r.radius for r in plan.collect()] == [8]
    assert max(brute_densities([(i, 0, 0) for i in range(3000)], denoise.DECAY)) < denoise.DENSE[0]


def test_nearest_earlier_partner(spark):
    rng = random.Random(8)
    rows = [(s, w, c, float(rng.randrange(0, 120, 10)), float(rng.randrange(0, 60, 10))) for s in ("a", "b") for w in range(-4, 12) for c in range(rng.randint(0, 3))]
    table = spark.createDataFrame(rows, "scene string, window_id long, cluster_id long, cx double, cy double").withColumn("gap", F.lit("clash"))
    got = nearest.nearest_before(table, table, 30.0, 3, ["window_id", "cluster_id"], by=["scene"])
    want = []
    for s, w, c, x, y in rows:
        found = [((x - a) ** 2 + (y - b) ** 2, w - v, v, d) for t, v, d, a, b in rows if t == s and 1 <= w - v <= 3 and (x - a) ** 2 + (y - b) ** 2 < 900]
        best = min(found, default=None)
        want.append((s, w, c, *((math.sqrt(best[0]), best[1], best[2], best[3]) if best else (None,) * 4)))
    assert sorted(map(tuple, got.select("scene", "window_id", "cluster_id", "distance", "gap", "near_window_id", "near_cluster_id").collect()), key=repr) == sorted(want, key=repr)
    assert any(r[3] is None for r in want) and any(r[4] == 3 for r in want)


def test_nearest_looks_at_few_candidates_where_rows_are_dense(spark):
    rng = random.Random(3)
    rows = [(w, c, float(rng.randrange(100)), float(rng.randrange(100))) for w in range(12) for c in range(60)] + [(w, 99, 400.0, 10.0 * w) for w in range(0, 12, 3)]
    table = spark.createDataFrame(rows, "window_id long, cluster_id long, cx double, cy double")
    looked, plain = [], nearest._candidates

    def counted(*args):
        looked.append(plain(*args).count())
        return plain(*args)

    nearest._candidates = counted
    try:
        got = nearest.nearest_before(table, table, 40.0, 3, ["window_id", "cluster_id"]).collect()
    finally:
        nearest._candidates = plain
    want = []
    for w, c, x, y in rows:
        best = min(((x - a) ** 2 + (y - b) ** 2, w - v, v, d) for v, d, a, b in [*rows, (-9, 0, 1e9, 1e9)] if 1 <= w - v <= 3 and (x - a) ** 2 + (y - b) ** 2 < 1600) if any(1 <= w - v <= 3 and (x - a) ** 2 + (y - b) ** 2 < 1600 for v, _, a, b in rows) else None
        want.append((w, c, *((math.sqrt(best[0]), *best[1:]) if best else (None,) * 4)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r[2] and 10 < r[2] for r in want) and any(r[2] == 30.0 for r in want)
    by_cells = sum(w // 3 - v // 3 in (0, 1) and abs(x // 40 - a // 40) <= 1 and abs(y // 40 - b // 40) <= 1 for w, _, x, y in rows for v, _, a, b in rows)
    assert len(looked) == 2 and sum(looked) < by_cells / 2  # cells of the whole distance and gap


def test_detections_need_no_join(spark):
    d = clustering.DETECTORS["DBSCAN"]
    rows = stream(spark, [(i, 50 + i % 3, 50) for i in range(30)])
    clusters, found = clustering.detect(rows, d)
    assert clusters.columns == ["window_id", "event_id", "cluster_id"]
    assert " Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    joined = clustering.detections(rows, clusters, d)
    assert found.collect() == joined.collect() and found.count() == 1
