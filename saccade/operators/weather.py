"""Weather filters over tracks: fixed rules, polarity physics, learned classifiers, and their combination."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccade.operators.features import NAMES
from saccade.operators.learning import bins, compact, hashed_ranks

#: Fixed values of the polarity filter.
RAIN_FLIP, RAIN_RUN, RAIN_SLACK, SNOW_EVENTS, SNOW_WINDOWS, SNOW_FLIP, SNOW_DENSITY = 0.28, 6.0, 1.4, 250, 6, 0.35, 30.0
MODES = ("rules", "logistic", "gradient_boost", "both")


def rain_rule() -> Column:
    w, h, dur, n = (F.col(c) for c in ("width", "height", "duration_ms", "total_events"))
    return ((w < 6) & (h > 1.5 * w)) | ((w * h < 60) & (dur < 8)) | ((F.col("speed_y") > 3.0) & (w < 8)) | ((dur < 5) & (n < 60))


def snow_rule() -> Column:
    w, h, dur, n, v, a = (F.col(c) for c in ("width", "height", "duration_ms", "total_events", "speed", "aspect"))
    round_ = (a > 0.5) & (a < 2.0) & (w < 14) & (h < 14) & (v < 1.2)
    return round_ | ((n < 40) & (dur < 15) & (w < 12)) | ((F.col("density") < 0.05) & (v < 1.5) & (n < 50))


def real_guard() -> Column:
    return (F.col("width") > 12) | (F.col("height") > 18) | (F.col("total_events") > 100) | (F.col("duration_ms") > 20)


def rule_based(tracks: DataFrame) -> DataFrame:
    """tracks with rain, snow and is_weather by the rules; large, long or busy tracks are never weather."""
    return tracks.withColumns({"rain": rain_rule(), "snow": snow_rule(), "is_weather": (rain_rule() | snow_rule()) & ~real_guard()})


def polarity_class(windows: str = "n_windows", rain_flip: float = RAIN_FLIP, rain_run: float = RAIN_RUN, snow_events: int = SNOW_EVENTS, snow_windows: int = SNOW_WINDOWS, snow_flip: float = SNOW_FLIP, snow_density: float = SNOW_DENSITY) -> Column:
    """real, rain or snow from flip_rate, mean_run, n_events and the number of windows; a track without
    polarity features (null) is real."""
    fr, n, w = F.col("flip_rate"), F.col("n_events"), F.col(windows)
    rain = (fr < rain_flip) | ((F.col("mean_run") > rain_run) & (fr < rain_flip * RAIN_SLACK))
    snow = (n < snow_events) & (w < snow_windows) & (fr >= snow_flip) & (F.try_divide(n, F.greatest(w, F.lit(1))) < snow_density)
    return F.when(fr.isNull(), "real").when(rain, "weather_rain").when(snow, "weather_snow").otherwise("real")


def polarity_filter(tracks: DataFrame) -> DataFrame:
    """tracks with decision and weather_score (1 for weather)."""
    rows = tracks.withColumn("decision", polarity_class())
    return rows.withColumn("weather_score", F.col("decision").startswith("weather").cast("double"))


def assembled() -> list:
    return [VectorAssembler(inputCols=NAMES, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def augmented(tracks: DataFrame, copies: int, sigma: float, seed: int = 42) -> DataFrame:
    """tracks and ``copies`` noisy copies of each: every feature moves by sigma of its deviation times a normal draw from a hash."""
    from saccade.sources.generators import normal

    stds = tracks.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in NAMES]).first().asDict()  # 15 numbers
    rows = tracks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    key = [c for c in ("scene", "track_id", "row") if c in rows.columns] or NAMES[:4]
    moved = {c: F.col(c) + F.when(F.col("copy") > 0, F.lit(stds[c] * sigma) * normal(seed, c, "copy", *key)).otherwise(0.0) for c in NAMES}
    return rows.withColumns(moved)


def train(clean: DataFrame, weather: DataFrame, kind: str = "gradient_boost", copies: int = 4, seed: int = 42, max_iter: int = 100) -> PipelineModel:
    """A classifier of tracks as weather (1) or not (0); the two sets are augmented and scaled."""
    rows = clean.select("*", F.lit(0.0).alias("weather")).unionByName(weather.select("*", F.lit(1.0).alias("weather")), allowMissingColumns=True)
    rows = compact(augmented(rows, copies, 0.03, seed)).persist()  # every iteration reads it again
    n = {r["weather"]: r["count"] for r in rows.groupBy("weather").count().collect()}
    total = sum(n.values())
    rows = rows.withColumn("balance", F.when(F.col("weather") == 1.0, total / (2.0 * max(1, n.get(1.0, 0)))).otherwise(total / (2.0 * max(1, n.get(0.0, 0)))))
    if kind == "logistic":
        model = LogisticRegression(labelCol="weather", weightCol="balance", regParam=1.0 / max(1, total), maxIter=max_iter)
    else:
        model = GBTClassifier(labelCol="weather", maxIter=max_iter, maxDepth=4, maxBins=bins(total), stepSize=0.1, seed=seed)
    fitted = Pipeline(stages=[*assembled(), model]).fit(rows)
    rows.unpersist()
    return fitted


def trained_report(clean: DataFrame, weather: DataFrame, copies: int = 4, seed: int = 42, max_iter: int = 100, folds: int = 5, top: int = 3, key: str = "track_id") -> DataFrame:
    """(metric, name, value): mean and deviation of the folds' F1 of gradient boosting, its accuracy on what it
    learned from, and the most important features. A fold is a share of the tracks of either kind, by rank of
    hash; a track's noisy copies are in its fold, and only tracks themselves are judged, so nothing that a
    model is judged by has a likeness among what it learned from. Folds are fitted side by side."""
    model = train(clean, weather, "gradient_boost", copies, seed, max_iter)
    rows = clean.select("*", F.lit(0.0).alias("weather")).unionByName(weather.select("*", F.lit(1.0).alias("weather")), allowMissingColumns=True)
    ranks = hashed_ranks(rows, "weather", key)
    least = ranks.groupBy("weather").agg(F.max("_all").alias("n")).agg(F.min("n")).first()[0]
    folds = max(2, min(folds, least or 0))
    rows = compact(augmented(ranks.withColumn("_fold", F.pmod("_rank", F.lit(folds))).drop("_rank", "_all"), copies, 0.03, seed)).persist()
    booster = GBTClassifier(labelCol="weather", maxIter=max_iter, maxDepth=4, maxBins=bins(rows.count()), stepSize=0.1, seed=seed)
    judge = MulticlassClassificationEvaluator(labelCol="weather", metricName="fMeasureByLabel", metricLabel=1.0)

    def f1(fold: int) -> float:
        fitted = Pipeline(stages=[*assembled(), booster]).fit(rows.where(F.col("_fold") != fold))
        return judge.evaluate(fitted.transform(rows.where((F.col("_fold") == fold) & (F.col("copy") == 0))))

    with ThreadPoolExecutor(folds) as side_by_side:
        scores = np.array(list(side_by_side.map(inheritable_thread_target(clean.sparkSession)(f1), range(folds))))
    accuracy = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("weather")).cast("double"))).first()[0]
    rows.unpersist()
    weights = sorted(zip(NAMES, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:top]
    found = [("cv_f1", "mean", float(scores.mean())), ("cv_f1", "std", float(scores.std())), ("accuracy", "train", float(accuracy))]
    return clean.sparkSession.createDataFrame([*found, *(("importance", n, w) for n, w in weights)], "metric string, name string, value double")


def split(tracks: DataFrame, mode: str = "rules", model: PipelineModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, weather) tracks."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode != "rules" and model is None:
        raise ValueError(f"{mode} needs a model")
    rows, flag = rule_based(tracks), F.col("is_weather")
    if mode != "rules":
        rows = model.transform(rows)
        learned = F.col("prediction") == 1.0
        flag = flag & learned if mode == "both" else learned
    return rows.where(~flag).select(*tracks.columns), rows.where(flag).select(*tracks.columns)


def combined(tracks: DataFrame, model: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """(kept tracks, report): the classifier first, then the polarity filter; counts of what each removed."""
    rows = polarity_filter(model.transform(tracks))
    gb, ptf = F.col("prediction") == 1.0, F.col("weather_score") == 1.0
    report = rows.agg(F.count("*").alias("input"), F.count_if(gb).alias("gb_removed"), F.count_if(~gb & ptf).alias("ptf_removed"), F.count_if(~gb & ~ptf).alias("final_kept"))
    return rows.where(~gb & ~ptf).select(*tracks.columns), report
