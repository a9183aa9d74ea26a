"""The benchmark, learned filters, streams and rankings, on small scenes."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.functions import scratch
from saccade.operators import clustering, denoise, features, learning, network, ranking, tracking, weather
from saccade.plans import benchmark, registry


def test_benchmark_scores_the_grid(spark):
    scores = benchmark.run(spark, ["DBSCAN"], ["Clean", "HeavyRain"], duration_ms=100.0, trees=10, max_iter=3, epochs=3)
    rows = {(r["filter"], r.scene): r.accuracy for r in scores.collect()}
    assert len(rows) == 8 and all(0 <= v <= 1 for v in rows.values())
    assert rows["none", "Clean"] > 0.5 and rows["gradient_boost", "HeavyRain"] >= rows["none", "HeavyRain"]
    assert benchmark.ranked(scores).count() == 4


def test_registered_models_have_the_operators_sizes(monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    seen = {}
    for name in ("read", "replay_events", "rounded", "_two_kinds", "_fitted"):
        monkeypatch.setattr(registry, name, MagicMock())
    registry._two_kinds.return_value = MagicMock(), MagicMock()
    monkeypatch.setattr(registry, "_classes", lambda *a: (8, 3))
    monkeypatch.setattr(registry, "F", MagicMock())
    for module, name in ((registry.benchmark, "run_recorded"), (registry.benchmark, "ranked"), (learning, "forest"), (learning, "mlp"), (learning, "cross_validated"), (learning, "as_features"), (learning, "report"), (learning, "confusion"), (weather, "train"), (weather, "split")):
        sizes = {k: v.default for k, v in inspect.signature(getattr(module, name)).parameters.items() if v.default is not v.empty}
        made = MagicMock(return_value=(MagicMock(), MagicMock()) if name == "split" else None)
        monkeypatch.setattr(module, name, made)
        seen[name] = made, sizes
    for name in ("benchmark_ranking", "mlp_predict", "random_forest_predict", "classification_report", "cross_validation", "weather_gbt_filter"):
        if name == "cross_validation":
            learning.cross_validated.return_value = [1.0]
        registry.QUERIES[name](MagicMock(), "")
    assert list(seen["run_recorded"][0].call_args.args[2]) == list(clustering.DETECTORS) and len(clustering.DETECTORS) == 7
    assert (seen["run_recorded"][1]["trees"], seen["run_recorded"][1]["max_iter"]) == (200, 100)
    for name in ("forest", "mlp", "cross_validated", "train", "run_recorded"):
        assert seen[name][0].called and not any(set(c.kwargs) & {"trees", "depth", "hidden", "max_iter", "folds"} for c in seen[name][0].call_args_list)
    assert seen["mlp"][0].call_args.args == (8, 3) and seen["forest"][0].call_args.args == ()


def test_scenes_on_one_clock_keep_their_tracks_apart(spark):
    events = benchmark.scenes(spark, ["Clean", "LightSnow"], duration_ms=60.0)
    tracks = benchmark.scene_tracks(events, clustering.DETECTORS["ADB-Opt"])
    assert {r.scene for r in tracks.select("scene").distinct().collect()} <= {"Clean", "LightSnow"}
    assert tracks.groupBy("scene", "track_id").count().where("count > 1").isEmpty()


def track(spark, **kw):
    row = {c: 0.0 for c in features.NAMES} | {"track_id": 1} | kw
    return spark.createDataFrame([row])


def test_rules_and_their_guard(spark):
    small = {"width": 4.0, "height": 9.0, "total_events": 30.0, "duration_ms": 4.0}
    assert weather.rule_based(track(spark, **small)).first().is_weather
    assert not weather.rule_based(track(spark, **small | {"duration_ms": 21.0})).first().is_weather
    clean, gone = weather.split(track(spark, **small))
    assert clean.isEmpty() and gone.count() == 1
    for mode in ("other", "logistic"):
        with pytest.raises(ValueError, match=mode if mode == "logistic" else "mode"):
            weather.split(track(spark, **small), mode)


def test_polarity_decisions(spark):
    rows = spark.createDataFrame([(0.1, 1.5, 400, 9), (0.5, 2.0, 100, 4), (0.5, 2.0, 100, 3), (0.5, 2.0, 300, 9), (None, None, None, 2)], "flip_rate double, mean_run double, n_events long, n_windows long")
    got = [r.decision for r in weather.polarity_filter(rows).collect()]
    assert got == ["weather_rain", "weather_snow", "real", "real", "real"]


def test_network_gives_probabilities():
    w = network.random_weights()
    x = np.random.default_rng(1).random((3, 256, 4)).astype("f4")
    p = network.forward(x, w)
    assert p.shape == (3, 3) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    got = network.conv(x.transpose(0, 2, 1), w["stem"], w["stem_b"])
    padded = np.pad(x.transpose(0, 2, 1), ((0, 0), (0, 0), (3, 3)))
    assert np.allclose(got[1, 5, 100], (padded[1, :, 100:107] * w["stem"][5]).sum() + w["stem_b"][5], atol=1e-4)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(3)
    w = {k: v.astype("f8") for k, v in network.random_weights().items()}
    x, y, share = rng.random((4, 32, 4)).astype("f4"), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 3.0])
    _, g = network.gradients(x, y, share, w)
    assert set(g) == set(w) and all(g[k].shape == w[k].shape for k in w)
    for k in ("stem", "stem_b", "r0_1", "r2_s", "r3_2", "r5_2b", "fc1", "fc2_b"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        losses = []
        for d in (1e-4, -1e-4):
            moved = w | {k: w[k].copy()}
            moved[k][at] += d
            losses.append(network.gradients(x, y, share, moved)[0])
        assert np.isclose((losses[0] - losses[1]) / 2e-4, g[k][at], rtol=0.05), k


def test_the_network_learns(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(48):
        s = rng.random((32, 4)) * 0.2
        s[:, i % 3] += 0.8
        rows.append((s.tolist(), i % 3))
    table = spark.createDataFrame(rows, "seq array<array<double>>, cls int")
    weights, losses = network.train(table, epochs=6, batch=8, tasks=2)
    by = [r.loss for r in losses.orderBy("epoch").collect()]
    assert by[-1] < 0.5 * by[0]
    got = network.score(table, weights).collect()
    assert sum(int(np.argmax([r.p_real, r.p_rain, r.p_snow])) == r.cls for r in got) >= 44


def test_weights_come_back(spark, tmp_path):
    w = {"a": np.arange(6, dtype="f4").reshape(2, 3), "b": np.zeros(2, "f4")}
    network.save_weights(spark, w, str(tmp_path / "w"))
    back = network.load_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(w) and all(np.array_equal(back[k], w[k]) for k in w)


def test_scaling_splits_and_reports(spark):
    rows = spark.createDataFrame([(i, float(i), 5.0, i % 2) for i in range(20)], "k long, a double, b double, label int")
    got = learning.scaled(rows, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.max(F.abs("b"))).first()
    assert abs(got[0]) < 1e-9 and abs(got[1] - 1) < 1e-9 and got[2] == 0.0
    parts = {(r.label, r.is_test): r["count"] for r in learning.stratified(rows, "label", "k").groupBy("label", "is_test").count().collect()}
    assert parts == {(0, True): 2, (0, False): 8, (1, True): 2, (1, False): 8}
    matrix = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 4)], "actual int, predicted int, n long")
    got = {r.cls: (r.support, r.precision, r.recall) for r in learning.report(matrix).collect()}
    assert got == {0: (4, 1.0, 0.75), 1: (4, 0.8, 1.0)}
    with pytest.raises(ValueError, match="labelled"):
        learning.fit(rows.withColumn("label", F.lit(-1)), learning.forest())


def test_training_report_and_balance(spark):
    rng = np.random.default_rng(5)
    rows = [{c: float(rng.normal(i % 2, 0.3)) for c in features.NAMES} | {"track_id": i} for i in range(40)]
    table = spark.createDataFrame(rows)
    got = weather.trained_report(table.where("track_id % 2 = 0"), table.where("track_id % 2 = 1"), copies=1, max_iter=2, folds=2).collect()
    assert [r.metric for r in got] == ["cv_f1", "cv_f1", "accuracy"] + ["importance"] * 3 and got[0].value > 0.8  # judged on tracks that no fold has copies of
    uneven = spark.createDataFrame([(i, 0 if i < 600 else 1) for i in range(800)], "k long, label int")
    made = learning.balanced(uneven, "label", "k")
    counts = {r.label: (r.n, r.first) for r in made.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("copy") == 0).alias("first")).collect()}
    assert counts == {0: (600, 600), 1: (600, 200)}


@pytest.mark.parametrize("block", [4096, 7])
def test_draws_are_exact_and_the_same_however_rows_are_dealt(spark, monkeypatch, block):
    monkeypatch.setattr(learning, "DRAWS", block)
    rows = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 53 else None) for i in range(63)], "k long, label string")
    made = [sorted((r.label or "", r.k, r.copy) for r in learning.balanced(rows.repartition(n), "label", "k").collect()) for n in (1, 5)]
    assert made[0] == made[1] and len(made[0]) == 150
    assert {x: sum(r[0] == x for r in made[0]) for x in ("a", "b", "")} == {"a": 50, "b": 50, "": 50}
    assert sorted(r[2] for r in made[0] if r[0] == "b") == [0, 0, 0, *range(1, 48)] and len({r[1] for r in made[0] if r[0] == "b"}) == 3
    assert learning.balanced(rows.limit(0), "label", "k").count() == 0


def test_folds_of_the_report_hold_no_copies_of_what_is_judged(spark, monkeypatch):
    """Features without any bearing on the kind: copies of a track in other folds would give it away."""
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([{c: float(rng.normal()) for c in features.NAMES} | {"track_id": i} for i in range(60)])
    got = {(r.metric, r.name): r.value for r in weather.trained_report(table.where("track_id % 2 = 0"), table.where("track_id % 2 = 1"), copies=3, max_iter=3, folds=3).collect()}
    assert got["cv_f1", "mean"] < 0.75 < got["accuracy", "train"]


def test_recorded_scenes_take_their_weather_from_buckets(spark):
    events = spark.createDataFrame([(1000.0 * i, 50, 60, 1, 0) for i in range(40)], "t double, x int, y int, p int, label int")
    falling = spark.createDataFrame([(400.0 * i, 50, 60, 1, 10 + i % 2, i) for i in range(100)], "t double, x int, y int, p int, label int, bucket int")
    rows = benchmark.recorded_scenes(events, falling, list(benchmark.SCENES), denoised=False)
    got = {r.scene: (r.o, r.r, r.s) for r in rows.groupBy("scene").agg(*[F.count_if(F.expr(e)).alias(n) for e, n in (("label < 10", "o"), ("label = 10", "r"), ("label = 11", "s"))]).collect()}
    assert got == {"Clean": (40, 0, 0), "LightRain": (40, 2, 0), "MedRain": (40, 4, 0), "HeavyRain": (40, 8, 0), "LightSnow": (40, 0, 2), "MedSnow": (40, 0, 4), "Rain+Snow": (40, 4, 2)}
    taught = benchmark.recorded_scenes(events, falling, [*benchmark.TRAINING], 40, denoised=False).where("label >= 10")
    assert taught.count() == 12 and taught.agg(F.min("t")).first()[0] == 400.0 * 40
    assert rows.agg(F.count("*") == F.count_distinct("event_id")).first()[0]


def test_results_and_models_come_back(spark, tmp_path):
    from saccade.sources import files

    scores = spark.createDataFrame([("DBSCAN", "none", "Clean", 0.5), ("ADB-Opt", "both", "Rain+Snow", 0.75)], "detector string, filter string, scene string, accuracy double")
    files.write_results(scores, str(tmp_path / "scores"))
    back = spark.read.json(str(tmp_path / "scores")).select(*scores.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scores.collect()))
    rows = learning.as_features(spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "k long, v array<double>, label int"), "v")
    model = learning.fit(rows, learning.forest(trees=3, depth=2))
    learning.save(model, str(tmp_path / "model"))
    again = learning.load(str(tmp_path / "model"))
    plain = lambda m: [(r.k, r.prediction, r.confidence) for r in learning.predicted(rows, m).orderBy("k").collect()]
    assert plain(again) == plain(model)


def test_summary_has_all_levels(spark):
    scores = spark.createDataFrame([("a", "x", "Clean", 1.0), ("a", "x", "MedRain", 0.0), ("a", "y", "Clean", 0.5), ("b", "x", "Clean", 0.25)], "detector string, filter string, scene string, accuracy double")
    got = {(r.detector, r["filter"], r.level): (r.n, round(r.avg, 6), r.min, r.max) for r in ranking.summary(scores).collect()}
    assert got["a", "x", 0] == (2, 0.4, 0.0, 1.0) and got["a", None, 1][0] == 3 and got[None, None, 3] == (4, round(1.75 / 4.5, 6), 0.0, 1.0) and len(got) == 6


def test_ranking_breaks_ties_by_name(spark):
    avgs = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.9), ("b", "x", 0.9), ("b", "y", 0.9)], "detector string, filter string, avg double")
    assert [(r.detector, r["filter"]) for r in ranking.best(avgs, "detector", "avg", "filter").orderBy("detector").collect()] == [("a", "y"), ("b", "x")]
    assert sorted(r["rank"] for r in ranking.ranked(avgs).collect()) == [1, 1, 1, 4]
    assert [r.is_new_best for r in ranking.running_best(avgs, "detector", "filter").orderBy("detector", "filter").collect()] == [True, True, False, False]


def test_training_reads_few_partitions(spark):
    rows = spark.range(0, 5000, 1, 40).withColumn("x", F.col("id") * 2)
    few = learning.compact(rows)
    assert few.rdd.getNumPartitions() == 1 and few.agg(F.sum("x")).first()[0] == 5000 * 4999


def test_jobs_run_side_by_side(spark):
    both = threading.Barrier(2)
    assert scratch.side_by_side(spark, lambda: both.wait(30) * 0 + spark.range(3).count(), lambda: both.wait(30) * 0 + 7) == [3, 7]


def test_tracks_are_clustered_once(spark):
    rows = spark.createDataFrame([(i, 400.0 * i, 50 + i % 3, 50, 1, 0) for i in range(80)], "event_id long, t double, x int, y int, p int, label int")
    tracked, found = benchmark.tracks_of(rows, clustering.DETECTORS["DBSCAN"], min_length=2)
    for out in (tracked, found):
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.total_events for r in found.collect()] == [75]  # the last window has five events only, which is noise


def test_forests_grow_in_parts_of_few_partitions(spark, monkeypatch, tmp_path):
    seen, plain = [], learning.RandomForestClassifier._fit
    monkeypatch.setattr(learning.RandomForestClassifier, "_fit", lambda self, rows: seen.append((self.getNumTrees(), rows.rdd.getNumPartitions())) or plain(self, rows))
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rng.normal(i % 3, 0.8, 4).tolist(), i % 3) for i in range(240)], "k long, v array<double>, label int").repartition(12)
    rows = learning.as_features(table, "v")
    model = learning.fit(rows, learning.forest(trees=60, depth=4))
    assert sorted(seen) == [(20, 1)] * 3
    got = {r.k: r for r in learning.predicted(rows, model).collect()}
    parts = [{r.k: np.array(r[f"_votes{i}"]) for r in m.transform(rows).collect()} for i, m in enumerate(model.stages[:-1])]
    for k, r in got.items():
        votes = sum(p[k] for p in parts)
        assert np.allclose(r.rawPrediction, votes) and abs(votes.sum() - 60) < 1e-6 and np.allclose(r.probability, votes / 60)
        assert r.prediction == votes.argmax() and abs(r.confidence - votes.max() / 60) < 1e-9
    assert len(got) == 240 and not any(c.startswith("_") for c in learning.predicted(rows, model).columns)
    assert sum(r.prediction == r.label for r in got.values()) > 200
    learning.save(model, str(tmp_path / "model"))
    again = learning.predicted(rows, learning.load(str(tmp_path / "model"))).collect()
    assert all(r.prediction == got[r.k].prediction for r in again) and learning.predicted(rows.limit(0), model).count() == 0


def test_validation_fits_a_model_a_fold_only(spark, monkeypatch):
    seen, plain = [], learning.fit
    monkeypatch.setattr(learning, "fit", lambda rows, model, label="label": seen.append({r.f for r in rows.select("f").distinct().collect()}) or plain(rows, model, label))
    monkeypatch.setattr(learning.RandomForestClassifier, "_fit", lambda self, rows, fit=learning.RandomForestClassifier._fit: seen.append(rows.count()) or fit(self, rows))
    rows = learning.as_features(spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2, i % 3) for i in range(30)], "k long, v array<double>, label int, f int"), "v")
    assert learning.cross_validated(rows, learning.forest(trees=3, depth=2), folds=3, fold="f") == [1.0]
    assert seen == [{1, 2}, 20, {0, 2}, 20, {0, 1}, 20]  # none on all rows, which nobody would look at
    assert learning.cross_validated(rows, learning.forest(trees=3, depth=2), folds=2) == [1.0]


def test_perceptrons_learn_from_even_partitions(spark, monkeypatch):
    seen, plain = [], learning.MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(learning.MultilayerPerceptronClassifier, "_fit", lambda self, rows: seen.extend(rows.rdd.glom().map(len).collect()) or plain(self, rows))
    rows = learning.as_features(spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(200)], "k long, v array<double>, label int").coalesce(1), "v")
    model = learning.fit(rows, learning.mlp(2, 2, (3,), max_iter=20))
    assert len(seen) == spark.sparkContext.defaultParallelism and sum(seen) == 200 and max(seen) - min(seen) <= len(seen)
    assert learning.predicted(rows, model).where("prediction = label").count() == 200


def test_the_network_learns_from_all_rows(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(x, y, share, w, room=None):
        seen.add(len(y))
        return float(x.sum()), {k: np.zeros_like(a) for k, a in w.items()}

    monkeypatch.setattr(network, "gradients", counted)
    cell = F.array(*[(F.col("id") + i).cast("double") for i in range(4)])
    weights, losses = network.train(spark.range(4100).select(F.array(cell, cell).alias("seq"), (F.col("id") % 3).alias("cls")), epochs=1)
    assert seen.value == 4100 and losses.count() == 1
    first = network.random_weights(42)
    for k, a in weights.items():  # nothing but decay, as gradients are 0: pieces come back in their places
        assert a.shape == first[k].shape and np.allclose(a, first[k] * (0.3 if k in {f"r{i}_2" for i in range(6)} else 1.0), rtol=1e-4, atol=1e-7)


def test_thresholds_come_from_all_rows(spark, monkeypatch):
    assert [learning.bins(n) for n in (0, 500, 10_000)] == [32] * 3 and all(learning.bins(n) ** 2 >= n for n in (10_001, 123_457, 10**7))
    seen = []
    monkeypatch.setattr(weather.GBTClassifier, "_fit", lambda self, rows, fit=weather.GBTClassifier._fit: seen.append((rows.count(), self.getMaxBins())) or fit(self, rows))
    rows = spark.range(2400).select("id", *[((F.col("id") * (i + 3)) % 1009).cast("double").alias(c) for i, c in enumerate(features.NAMES)])
    weather.train(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), max_iter=1)
    assert seen == [(12_000, 110)]


def test_detectors_share_a_pass(spark, monkeypatch):
    """Windows of two scenes, in batches that cut through them: what each detector finds alone, and its clusters' events."""
    monkeypatch.setattr(clustering, "EVENTS", 70)
    rng = np.random.default_rng(11)
    spots = rng.integers(20, 240, (6, 2))
    rows = [(s, i, float(50 * i), *(int(v) for v in spots[rng.integers(6)] + rng.integers(-9, 10, 2)), int(rng.choice([-1, 1])), int(rng.integers(-1, 3))) for s in ("a", "b") for i in range(900 if s == "a" else 640)]
    rows += [("c", i, 20_000.0 * (i // 4), 50, 50, 1, 0) for i in range(12)]  # windows of fewer events than k
    events = spark.createDataFrame(rows, "scene string, event_id long, t double, x int, y int, p int, label int")
    found = clustering.clustered(events, list(clustering.DETECTORS.values()), ["scene"])
    got = found.collect()
    cells = [c for c in found.columns if c not in ("detector", "events")]
    for name, d in clustering.DETECTORS.items():
        clusters, alone = clustering.detect(events, d, ["scene"])
        assert sorted(tuple(r[c] for c in cells) for r in got if r.detector == name) == sorted(tuple(r[c] for c in cells) for r in alone.collect()), name
        kept = {(r.scene, r.window_id, r.cluster_id) for r in got if r.detector == name}
        ids = sorted((r.scene, r.window_id, r.cluster_id, e.event_id) for r in got if r.detector == name for e in r.events)
        assert ids == sorted(tuple(r) for r in clusters.select("scene", "window_id", "cluster_id", "event_id").collect() if (r.scene, r.window_id, r.cluster_id) in kept)
    assert len({r.detector for r in got}) == 7 and all([e.t for e in r.events] == sorted(e.t for e in r.events) for r in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("RepartitionByExpression") == 1


def test_noise_filter_joins_once(spark):
    rows = spark.createDataFrame([(1, 0.0, 5, 5), (2, 10.0, 6, 6), (2, 20.0, 200, 200), (None, 30.0, 6, 6), (3, 40.0, None, 6)], "event_id long, t double, x int, y int")
    kept = denoise.denoise(rows)
    assert [tuple(r) for r in kept.collect()] == [(2, 10.0, 6, 6)]  # each event by itself, whatever others are called
    assert kept.columns == rows.columns and kept._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_cluster_sequences_are_those_of_the_events(spark):
    rng = np.random.default_rng(2)
    rows = [(k, c, c * 900 + i, float(rng.integers(0, 400)), int(rng.integers(346)), int(rng.integers(260)), int(rng.choice([-1, 1])), 0) for k in (1, 2) for c in range(3) for i in range(k * 60)]
    events = spark.createDataFrame(rows, "track_id long, cluster_id long, event_id long, t double, x int, y int, p int, label int")
    held = events.groupBy("track_id", "cluster_id").agg(F.collect_list(F.struct("t", "event_id", "x", "y", "p", "label")).alias("events"))
    seqs = lambda made: {r.track_id: r.seq for r in made.collect()}
    assert seqs(features.cluster_sequences(held, ["track_id"])) == seqs(features.sequences(events, ["track_id"]))
