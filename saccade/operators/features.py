"""Track features: trajectory (15, and two more in 3-D), polarity, and event sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccade.functions.schema import HEIGHT, WIDTH

NAMES = ["width", "height", "aspect", "total_events", "duration_ms", "speed", "speed_x", "speed_y", "direction", "pol_ratio", "density", "cx_norm", "cy_norm", "straightness", "osc_amp"]


def trajectory(tracked: DataFrame, key: list[str]) -> DataFrame:
    """The 15 features of tracks, from their detections in order of seq, and resid (the deviation from a
    line whose reciprocal straightness is)."""
    w = Window.partitionBy(*key)
    half = F.expr("_n div 2")
    rows = tracked.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("seq")) - 1)
    rows = rows.withColumn("_mx", F.avg("cx").over(w)).withColumn("_my", F.avg("cy").over(w)).withColumn("_mt", F.avg("t_center").over(w))
    early = F.when(F.col("_n") <= 2, F.col("_r") == 0).otherwise(F.col("_r") < half)
    late = F.when(F.col("_n") <= 2, F.col("_r") == F.col("_n") - 1).otherwise(F.col("_r") >= half)
    dt, dx = F.col("t_center") - F.col("_mt"), F.col("cx") - F.col("_mx")

    def move(c: str) -> Column:
        return F.avg(F.when(late, F.col(c))) - F.avg(F.when(early, F.col(c)))

    agg = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.median(F.col("x_max") - F.col("x_min")).alias("width"), F.median(F.col("y_max") - F.col("y_min")).alias("height"),
        F.sum("n_events").alias("total_events"), ((F.max_by("t_center", "seq") - F.min_by("t_center", "seq")) / 1000).alias("_dur"),
        move("cx").alias("_dx"), move("cy").alias("_dy"), F.avg("pol_ratio").alias("pol_ratio"),
        (F.avg("cx") / WIDTH).alias("cx_norm"), (F.avg("cy") / HEIGHT).alias("cy_norm"),
        F.sum(dt * dx).alias("_tx"), F.sum(dt * dt).alias("_tt"), F.sum(dx * dx).alias("_xx"),
    )
    dur = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("_dur"))
    resid = F.sqrt(F.greatest(F.lit(0.0), F.col("_xx") - F.coalesce(F.try_divide(F.col("_tx") * F.col("_tx"), F.col("_tt")), F.lit(0.0))) / F.col("n"))
    agg = agg.withColumn("duration_ms", dur).withColumn("resid", F.when(F.col("n") > 2, resid))
    per = F.col("duration_ms") + 1e-6
    out = agg.select(
        *key, "n", "width", "height", (F.col("width") / (F.col("height") + 1e-6)).alias("aspect"), "total_events", "duration_ms",
        (F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2) / per).alias("speed"), (F.col("_dx") / per).alias("speed_x"), (F.col("_dy") / per).alias("speed_y"),
        F.atan2("_dy", "_dx").alias("direction"), "pol_ratio", (F.col("total_events") / (F.col("width") * F.col("height") + 1)).alias("density"),
        "cx_norm", "cy_norm", F.when(F.col("n") > 2, 1 / (F.col("resid") + 1e-6)).otherwise(1.0).alias("straightness"), "resid",
    )
    return out.join(oscillation(rows, key), key, "left").withColumn("osc_amp", F.coalesce("osc_amp", F.lit(0.0)))


def oscillation(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., osc_amp): the largest amplitude of the discrete Fourier transform of cy less its mean, over
    bins 1 to n div 2 - 1, for tracks of more than four detections. Bins of a track are rows."""
    bins = rows.where("_n > 4").select(*key, "_n", "_r", (F.col("cy") - F.col("_my")).alias("v"), F.explode(F.expr("sequence(1, cast(_n div 2 as int) - 1)")).alias("b"))
    a = F.col("b") * F.col("_r") * (2 * math.pi) / F.col("_n")
    sums = bins.groupBy(*key, "b").agg(F.sum(F.col("v") * F.cos(a)).alias("c"), F.sum(F.col("v") * F.sin(a)).alias("s"))
    return sums.groupBy(*key).agg(F.max(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)).alias("osc_amp"))


def depth(events: DataFrame, tracks: DataFrame, key: list[str]) -> DataFrame:
    """(key..., t_span_ms, ev_density_3d) from a track's events (key..., t) and its width and height."""
    spans = events.groupBy(*key).agg(((F.max("t") - F.min("t")) / 1000).alias("t_span_ms"), F.count("*").alias("_e"))
    area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    return spans.join(tracks, key).select(*key, "t_span_ms", (F.col("_e") / (area * F.greatest("t_span_ms", F.lit(0.01)))).alias("ev_density_3d"))


def polarity(events: DataFrame, key: list[str], least: int = 4) -> DataFrame:
    """(key..., n_events, flips, flip_rate, mean_run, pol_ratio) of tracks of at least ``least`` events, in order of (t, event_id)."""
    w = Window.partitionBy(*key).orderBy("t", "event_id")
    rows = events.withColumn("_flip", (F.col("p") != F.lag("p").over(w)).cast("int"))
    n, flips = F.count("*"), F.coalesce(F.sum("_flip"), F.lit(0))
    agg = rows.groupBy(*key).agg(n.alias("n_events"), flips.alias("flips"), F.avg((F.col("p") > 0).cast("double")).alias("pol_ratio")).where(F.col("n_events") >= least)
    return agg.select(*key, "n_events", "flips", (F.col("flips") / F.greatest(F.col("n_events") - 1, F.lit(1))).alias("flip_rate"), (F.col("n_events") / (F.col("flips") + 1)).alias("mean_run"), "pol_ratio")


def runs(events: DataFrame, key: list[str]) -> DataFrame:
    """(key..., run, p, length): stretches of equal polarity, numbered from 0."""
    w = Window.partitionBy(*key).orderBy("t", "event_id")
    rows = events.withColumn("_flip", F.coalesce((F.col("p") != F.lag("p").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "run", "p").agg(F.count("*").alias("length"))


def sequences(events: DataFrame, key: list[str], length: int = 256) -> DataFrame:
    """(key..., seq): ``length`` steps of [x, y, time, polarity] scaled to 0..1, in order of (t, event_id): longer
    tracks are thinned evenly, shorter ones filled up with zeros."""
    return _steps(events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "x", "y", "p"))).alias("a")), key, length)


def cluster_sequences(clusters: DataFrame, key: list[str], length: int = 256) -> DataFrame:
    """sequences() of rows that have a cluster's events each: an array of structs that begin with t and event_id."""
    return _steps(clusters.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("events"))).alias("a")), key, length)


def _steps(rows: DataFrame, key: list[str], length: int) -> DataFrame:
    rows = rows.select(*key, "a", F.get("a", F.lit(0))["t"].alias("t0"), (F.get("a", F.size("a") - 1)["t"] - F.get("a", F.lit(0))["t"]).alias("span"))
    n = F.size("a")
    at = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(n >= length, F.floor(i * n / length).cast("int")).otherwise(i))

    def step(i: Column) -> Column:
        e = F.get(F.col("a"), i)
        cell = F.array(e["x"] / float(WIDTH), e["y"] / float(HEIGHT), (e["t"] - F.col("t0")) / F.greatest(F.col("span"), F.lit(1.0)), (e["p"] + 1) / 2.0)
        return F.when(i < n, cell).otherwise(F.array(*[F.lit(0.0)] * 4))

    return rows.select(*key, F.transform(at, step).alias("seq"))
