"""The whole benchmark as a plan: scenes, detectors, filters, accuracies and their ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.functions.schema import RAIN, SNOW
from saccade.functions.scratch import side_by_side, stored
from saccade.operators import clustering, denoise, features, learning, network, ranking, tracking, weather
from saccade.sources import generators

#: The conditions' rain and snow.
SCENES = {"Clean": (None, None), "LightRain": ("light", None), "MedRain": ("medium", None), "HeavyRain": ("heavy", None), "LightSnow": (None, "light"), "MedSnow": (None, "medium"), "Rain+Snow": ("medium", "light")}

#: The scene that filters learn weather from.
TRAINING = {"Heavy rain and medium snow": ("heavy", "medium")}

#: Scenes lie this far apart on one clock, farther than noise filters and tracks reach.
APART_US, APART_IDS = 1_000_000.0, 10_000_000


def _members(events: DataFrame, detectors: list[clustering.Detector], min_length: int | None, group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with their detections, members with their clusters' events) of tracks by several detectors that link alike.
    Windows are shuffled once for all detectors, clusters carry their events along, and only events in clusters are kept."""
    group, d = ["detector", *(group or [])], detectors[0]
    of = [*group, "window_id", "cluster_id"]
    clusters = stored(clustering.clustered(events, detectors, group[1:]))
    found = clusters.drop("events")
    members = stored(tracking.long_tracks(tracking.link(found, d.link_px, d.max_gap, group), min_length or d.min_length, group))
    return members.join(found, of), members.join(clusters.select(*of, "events"), of)


def tracks_of(events: DataFrame, d: clustering.Detector, min_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with their detections, features with gt_class and polarity) of a stream's tracks."""
    tracked, own = _members(events, [d], min_length)
    key, tracked = ["track_id"], tracked.drop("detector")
    own = stored(own.select(*key, F.inline("events")))
    out = features.trajectory(tracked, key).join(tracking.vote(own, key), key, "left")
    pol = features.polarity(own, key).drop("pol_ratio")
    out = out.join(pol, key, "left").withColumn("n_windows", F.col("n"))
    return tracked, out


def scene(spark: SparkSession, name: str, duration_ms: float = 200.0, seed: int = 42, weather_seed: int = 123) -> DataFrame:
    rain, snow = (SCENES | TRAINING)[name]
    made = generators.objects(spark, duration_ms, seed=seed)
    return generators.numbered(generators.add_weather(made, rain, snow, duration_ms * 1000, weather_seed))


def clean_scene(spark: SparkSession, name: str, **kw) -> DataFrame:
    return denoise.denoise(scene(spark, name, **kw))


def scenes(spark: SparkSession, names: list[str], duration_ms: float = 200.0, seed: int = 42, weather_seed: int = 123) -> DataFrame:
    """Several scenes as one stream with a scene column, one after the other on one clock, noise filtered."""
    made = [scene(spark, n, duration_ms, seed, weather_seed).withColumns({"scene": F.lit(n), "t": F.col("t") + i * APART_US, "event_id": F.col("event_id") + i * APART_IDS}) for i, n in enumerate(names)]
    return denoise.denoise(stored(reduce(DataFrame.unionByName, made)))


def scene_tracks(events: DataFrame, d: clustering.Detector, min_length: int | None = None) -> DataFrame:
    """(scene, track_id, the track features, gt_class, seq) of all scenes at once."""
    return all_tracks(events, [d], min_length).drop("detector")


def all_tracks(events: DataFrame, detectors: list[clustering.Detector], min_length: int | None = None, group: tuple[str, ...] = ("scene",)) -> DataFrame:
    """scene_tracks() of several detectors, with a detector column; detectors that link alike share a pass."""
    key, alike = ["detector", *group, "track_id"], {}
    for d in detectors:
        alike.setdefault((d.window_us, d.link_px, d.max_gap, d.min_length), []).append(d)

    def tracks(some: list[clustering.Detector]) -> DataFrame:
        tracked, own = _members(events, some, min_length, [*group])
        labels = own.select(*key, F.explode("events.label").alias("label"))
        return features.trajectory(tracked, key).join(tracking.vote(labels, key), key).join(features.cluster_sequences(own, key), key)

    return reduce(DataFrame.unionByName, [tracks(some) for some in alike.values()])


def accuracies(tracks: DataFrame, filters: dict) -> DataFrame:
    """(detector, filter, scene, accuracy) of predicted tracks (detector, scene, gt_class, predicted and a
    boolean column for each filter, true where it removes the track). A removed track doesn't count; a
    weather track left over counts as wrong."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), gone.alias("gone")) for n, gone in filters.items()])).alias("f")
    rows = tracks.select("detector", "scene", "gt_class", "predicted", each).select("detector", "scene", "f.filter", F.when(~F.col("f.gone") & (F.col("gt_class") >= 0), (F.col("predicted") == F.col("gt_class")).cast("double")).alias("ok"))
    return rows.groupBy("detector", "filter", "scene").agg(F.coalesce(F.avg("ok"), F.lit(0.0)).alias("accuracy"))


#: Hundredths of a weather table that make each level of rain or snow in recorded scenes.
SHARES = {None: 0, "light": 4, "medium": 8, "heavy": 16}


def recorded_scenes(events: DataFrame, falling: DataFrame, names: list[str], first: int = 0, denoised: bool = True) -> DataFrame:
    """Scenes as scenes() makes them, from a recording (t, x, y, p, label) and weather events of the same form (and
    a bucket from 0 to 99): each scene is the recording with the buckets that its rain and snow take, from
    ``first`` on, so that scenes to learn from can have weather of their own."""
    return _recorded(events, falling, [(0, n, first) for n in names], denoised).drop("set")


def _recorded(events: DataFrame, falling: DataFrame, parts: list[tuple[int, str, int]], denoised: bool = True) -> DataFrame:
    """Scenes of several sets (a column) as one stream: (set, scene, first bucket) of each."""
    kinds = SCENES | TRAINING
    levels = F.array(*[F.struct(F.lit(k).alias("set"), F.lit(n).alias("scene"), F.lit(i).alias("i"), F.lit(first).alias("first"), F.lit(SHARES[kinds[n][0]]).alias("rain"), F.lit(SHARES[kinds[n][1]]).alias("snow")) for i, (k, n, first) in enumerate(parts)])
    cells = ["t", "x", "y", "p", "label"]
    clean = events.select(*cells, F.explode(levels).alias("s"))
    share = F.when(F.col("label") == RAIN, F.col("s.rain")).otherwise(F.col("s.snow"))
    bucket = F.pmod(F.col("bucket") - F.col("s.first"), F.lit(100))
    bad = falling.select(*cells, "bucket", F.explode(levels).alias("s")).where(bucket < share).select(*cells, "s")
    end = events.agg(F.max("t")).scalar()
    both = clean.unionByName(bad).select("s.set", "s.scene", (F.col("t") + F.col("s.i") * (end + APART_US)).alias("t"), "x", "y", "p", "label")
    rows = stored(both.withColumn("event_id", F.xxhash64("scene", "t", "x", "y", "p", "label")))
    rows = stored(denoise.numbered(rows, "number").drop("event_id").withColumnRenamed("number", "event_id"))
    return denoise.denoise(rows) if denoised else rows


def run(spark: SparkSession, detectors: list[str], names: list[str] | None = None, duration_ms: float = 200.0, trees: int = 200, max_iter: int = 100, epochs: int = 12) -> DataFrame:
    """evaluated() on synthetic scenes; filters learn from scenes of other seeds."""
    teach = [scenes(spark, n, duration_ms, weather_seed=seed).withColumn("set", F.lit(i)) for i, n, seed in ((1, ["Clean", *TRAINING], 42), (2, [*TRAINING], 99))]
    return evaluated(spark, detectors, stored(reduce(DataFrame.unionByName, teach)), stored(scenes(spark, names or list(SCENES), duration_ms)), trees, max_iter, epochs)


def run_recorded(events: DataFrame, falling: DataFrame, detectors: list[str], names: list[str] | None = None, trees: int = 200, max_iter: int = 100, epochs: int = 12) -> DataFrame:
    """evaluated() on a recording and weather events; filters learn from weather that no scene has."""
    parts = [*[(0, n, 0) for n in names or SCENES], (1, "Clean", 40), *[(k, n, first) for k, first in ((1, 40), (2, 70)) for n in TRAINING]]
    rows = stored(_recorded(events, falling, parts))
    return evaluated(events.sparkSession, detectors, rows.where("set > 0"), rows.where("set = 0").drop("set"), trees, max_iter, epochs)


def evaluated(spark: SparkSession, detectors: list[str], teach: DataFrame, test: DataFrame, trees: int = 200, max_iter: int = 100, epochs: int = 12) -> DataFrame:
    """(detector, filter, scene, accuracy): every detector without a filter, with gradient boosting, with the
    network and with both, over the scenes of test. The classifier learns from the clean scene of teach, the filters from
    that and from a rainy and snowy one, which is of set 1 for boosting and of set 2 for the network. Detections are made
    once; the detectors and what is learned, none of which needs another's results, run side by side."""
    gt = F.col("gt_class")

    def learned() -> list:
        tracks = stored(all_tracks(teach, [clustering.DETECTORS["DBSCAN"]], 2, ("set", "scene")).drop("detector"))
        taught, deep = tracks.where("set = 1").drop("set", "seq"), tracks.where("set = 2 OR scene = 'Clean'").where(gt >= 0)
        objects, rain_snow = taught.where("gt_class between 0 and 9"), taught.where("gt_class >= 10")
        forest = Pipeline(stages=[*weather.assembled(), learning.forest("gt_class", trees).setMaxBins(learning.bins(objects.count()))])
        classes = deep.select("seq", F.when(gt == RAIN, 1).when(gt == SNOW, 2).otherwise(0).alias("cls"))
        return side_by_side(spark, lambda: weather.train(objects, rain_snow, max_iter=max_iter), lambda: network.train(classes, epochs)[0], lambda: forest.fit(learning.compact(objects)))

    (boosted, weights, classifier), made = side_by_side(spark, learned, lambda: all_tracks(test, [clustering.DETECTORS[d] for d in detectors]))
    tracks = network.score(made, weights).withColumn("deep", F.col("p_rain") + F.col("p_snow") > 0.5).drop("seq")
    kept = tracks.columns
    rows = boosted.transform(tracks).select(*kept, (F.col("prediction") == 1.0).alias("learned"))
    rows = classifier.transform(rows).select("detector", "scene", "gt_class", "learned", "deep", F.col("prediction").cast("int").alias("predicted"))
    gb, dl = F.col("learned"), F.col("deep")
    return accuracies(stored(rows), {"none": F.lit(False), "gradient_boost": gb, "network": dl, "both": gb | dl})


def ranked(scores: DataFrame) -> DataFrame:
    """(detector, filter, avg, rank) by the conditions' weights."""
    return ranking.ranked(ranking.averages(scores))
