"""Scores of detectors and filters over weather conditions: weighted averages, rankings and the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conditions and their weights.
CONDITIONS = {"Clean": 1.0, "LightRain": 1.2, "MedRain": 1.5, "HeavyRain": 1.5, "LightSnow": 1.0, "MedSnow": 1.2, "Rain+Snow": 1.5}


def weight(scene: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in CONDITIONS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, scene), F.lit(1.0))


def averages(scores: DataFrame) -> DataFrame:
    """(detector, filter, avg) from (detector, filter, scene, accuracy), by the conditions' weights."""
    w = weight(F.col("scene"))
    return scores.groupBy("detector", "filter").agg((F.sum(w * F.col("accuracy")) / F.sum(w)).alias("avg"))


def ranked(avgs: DataFrame) -> DataFrame:
    """avgs with rank; combinations are few, whatever the input."""
    return avgs.withColumn("rank", F.rank().over(Window.orderBy(F.desc("avg"))))


def best(rows: DataFrame, group: str, by: str, *ties: str) -> DataFrame:
    """The row of the largest ``by`` in each group; ties go to the least of the tie columns."""
    w = Window.partitionBy(group).orderBy(F.desc(by), *ties)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def running_best(avgs: DataFrame, *order: str) -> DataFrame:
    """avgs with best_so_far and is_new_best in the order given."""
    w = Window.orderBy(*order)
    before = F.max("avg").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return avgs.withColumns({"best_so_far": F.max("avg").over(w.rowsBetween(Window.unboundedPreceding, 0)), "is_new_best": before.isNull() | (F.col("avg") > before)})


def threshold_sweep(rows: DataFrame, value: str, label: str, thresholds: list[float]) -> DataFrame:
    """For each threshold, the share of each label's rows below and above it: thresholds are rows of an array."""
    each = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    v, t = F.col(value), F.col("threshold")
    return rows.select(label, value, each).groupBy("threshold", label).agg(F.avg((v < t).cast("double")).alias("below"), F.avg((v > t).cast("double")).alias("above"), F.count("*").alias("n"))


def histogram(rows: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(group, bin, n): counts in equal bins from low to high; the last bin is closed, values outside are left out."""
    v = F.col(value)
    b = F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins)).cast("int")
    return rows.where((v >= low) & (v <= high)).groupBy(group, b.alias("bin")).agg(F.count("*").alias("n"))


def spread(rows: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def summary(scores: DataFrame) -> DataFrame:
    """Weighted averages and extremes of accuracy by detector and filter, by detector, and over all, in one pass
    (level: 0, 1, 3): a null name stands for all."""
    w = weight(F.col("scene"))
    cells = [F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), (F.sum(w * F.col("accuracy")) / F.sum(w)).alias("avg"), F.min("accuracy").alias("min"), F.max("accuracy").alias("max")]
    return scores.rollup("detector", "filter").agg(*cells)
