"""Object classification: scaling, augmentation, splits, classifiers and their evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccade.functions.scratch import side_by_side, stored


def scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population deviation (1 where it is 0)."""
    sums = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    cells = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    return rows.crossJoin(F.broadcast(sums)).select(*[cells.get(c, F.col(c)).alias(c) for c in rows.columns])  # one row of sums


def hashed_ranks(rows: DataFrame, label: str, key: str) -> DataFrame:
    """rows with _rank (from 1) among the _all rows of their label, in order of md5(key). Ranks come from 4096
    ranges of the hash that are counted and sorted apart, so that no label gathers in one task."""
    md5 = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    cut = rows.withColumn("_md5", md5).withColumn("_range", F.substring("_md5", 1, 3))
    counts = cut.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    counts = counts.select(label, "_range", F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_md5", key)) + F.col("_before")
    one, two = cut.alias("a"), counts.alias("b")
    out = one.join(two, F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}")) & (F.col("a._range") == F.col("b._range"))).select("a.*", "_before", "_all")
    return out.withColumn("_rank", rank.cast("long")).select(*rows.columns, "_rank", "_all")


def stratified(rows: DataFrame, label: str, key: str, test_share: float = 0.2) -> DataFrame:
    """rows with is_test: floor(test_share * n) rows of every label, in order of md5(key)."""
    return hashed_ranks(rows, label, key).withColumn("is_test", F.col("_rank") <= F.floor(F.col("_all") * test_share)).select(*rows.columns, "is_test")


def as_features(rows: DataFrame, array: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def mlp(n_in: int, n_out: int, hidden: tuple[int, ...] = (128, 64, 32), label: str = "label", max_iter: int = 60, seed: int = 42):
    return MultilayerPerceptronClassifier(layers=[n_in, *hidden, n_out], labelCol=label, maxIter=max_iter, seed=seed)


def forest(label: str = "label", trees: int = 200, depth: int = 12, seed: int = 42):
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def bins(n: int) -> int:
    """maxBins of a tree model that is to take its thresholds from all of n rows: MLlib samples maxBins ** 2 of them, or 10,000."""
    return max(32, math.isqrt(n - 1) + 1) if n > 10_000 else 32


#: Rows of a partition that a trainer goes over again and again.
TASK_ROWS = 131_072


def compact(rows: DataFrame) -> DataFrame:
    """rows as a table of few partitions: a trainer starts a task for each of them hundreds of times, so small tables
    must not be spread over as many partitions as a shuffle leaves."""
    kept = stored(rows)
    return kept.coalesce(max(1, math.ceil(kept.count() / TASK_ROWS)))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all cores: a trainer whose passes are arithmetic waits for the fullest partition in each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, math.ceil(rows.count() / (cores * TASK_ROWS))))


#: Trees that are grown together. A forest's counts by node, feature, bin and class cross the shuffle once for each
#: partition, 17 GB for 200 trees and ten classes, so rows lie in few partitions and the trees are what is dealt out.
PART_TREES = 25


def _summed(*parts: pd.Series) -> pd.DataFrame:  # in SQL each use of a sum would walk all trees again
    votes = sum(np.array(p.to_list(), "f8").reshape(len(p), -1) for p in parts)
    shares = votes / votes.sum(axis=1, keepdims=True)
    best = shares.argmax(axis=1).astype("f8") if len(votes) else np.empty(0)
    return pd.DataFrame({"votes": list(votes), "shares": list(shares), "best": best})


class Votes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """rawPrediction, probability and prediction of a forest that was grown in parts: the sums of its parts' votes, as
    one forest of all their trees would have them."""

    parts = Param(Params._dummy(), "parts", "number of parts", typeConverter=TypeConverters.toInt)

    def _transform(self, rows: DataFrame) -> DataFrame:
        names = [f"_votes{i}" for i in range(self.getOrDefault(self.parts))]
        summed = F.pandas_udf(_summed, "votes array<double>, shares array<double>, best double")
        out = rows.withColumn("_new", summed(*[vector_to_array(c) for c in names]))
        made = {"rawPrediction": array_to_vector("_new.votes"), "probability": array_to_vector("_new.shares"), "prediction": F.col("_new.best")}
        return out.withColumns(made).drop(*names, "_new")


def grown(rows: DataFrame, model: RandomForestClassifier, label: str = "label") -> PipelineModel:
    """The forest of rows (features, label), its trees in parts that are grown side by side."""
    parts = math.ceil(model.getNumTrees() / PART_TREES)
    few = compact(rows.select("features", label)).persist()  # every part reads it

    def part(i: int):
        trees = model.getNumTrees() // parts + (i < model.getNumTrees() % parts)
        own = {model.numTrees: trees, model.seed: model.getSeed() + 1_000_003 * i, model.rawPredictionCol: f"_votes{i}", model.probabilityCol: "", model.predictionCol: ""}
        return model.copy(own).fit(few)

    made = side_by_side(rows.sparkSession, *[lambda i=i: part(i) for i in range(parts)])
    few.unpersist()
    votes = Votes()
    votes.set(votes.parts, parts)
    return PipelineModel([*made, votes])


def fit(rows: DataFrame, model, label: str = "label") -> PipelineModel:
    """A model of the rows whose label isn't noise."""
    known = rows.where(F.col(label) >= 0)
    if known.isEmpty():
        raise ValueError("no labelled rows")
    if isinstance(model, RandomForestClassifier) and model.getNumTrees() > PART_TREES:
        return grown(known, model, label)
    if isinstance(model, MultilayerPerceptronClassifier):
        known = spread(known)
    return Pipeline(stages=[model]).fit(known)


def predicted(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with prediction and confidence (the largest probability)."""
    out = model.transform(rows)
    return out.withColumn("confidence", F.array_max(vector_to_array("probability")))


def confusion(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from a confusion matrix."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = matrix.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("found"))
    rows = by_actual.join(by_predicted, "cls", "left")
    precision, recall = F.coalesce(F.col("tp") / F.col("found"), F.lit(0.0)), F.col("tp") / F.col("support")
    return rows.select("cls", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def accuracy(rows: DataFrame, gt: str = "gt_class", prediction: str = "prediction") -> Column:
    """Share of correct predictions over rows with a ground truth; 0 if none has one."""
    return F.coalesce(F.avg(F.when(F.col(gt) >= 0, (F.col(prediction) == F.col(gt)).cast("double"))), F.lit(0.0))


def cross_validated(rows: DataFrame, model, folds: int = 5, metric: str = "accuracy", label: str = "label", fold: str | None = None) -> list[float]:
    """The mean of the folds' metric. Folds are random, or those that a column of numbers from 0 gives. One model is held at a time."""
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    number = F.col(fold).cast("int") if fold else F.floor(F.rand(42) * folds).cast("int")
    rows = stored(rows.withColumn("_fold", number))  # drawn once
    scores = [judge.evaluate(fit(rows.where(F.col("_fold") != i), model, label).transform(rows.where(F.col("_fold") == i))) for i in range(folds)]
    return [sum(scores) / folds]


#: Draws that one row of a label's counts becomes at a time.
DRAWS = 4096


def balanced(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """rows with each label exactly as frequent as the most frequent one: the rows of rarer labels, and as many
    draws from them with replacement as are missing (column copy: 0 for a row itself, else the draw's number).
    A draw is a hash of seed, label and number, modulo the label's rows; it finds its row by rank."""
    name = F.coalesce(F.col(label).cast("string"), F.lit("null"))
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))  # a row a label
    missing = counts.withColumn("_missing", counts.agg(F.max("_n")).scalar() - F.col("_n")).where("_missing > 0")
    blocks = missing.select(label, "_n", "_missing", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_missing") - 1) / DRAWS))).alias("_b"))
    last = F.least(F.col("_missing"), (F.col("_b") + 1) * DRAWS)
    draws = blocks.repartition(label, "_b").select(label, "_n", F.explode(F.sequence(F.col("_b") * DRAWS + 1, last)).alias("copy"))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.col("copy").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = draws.select(F.col(label).alias("_label"), "copy", (F.pmod(digits, F.col("_n")) + 1).alias("_rank"))
    ranks = hashed_ranks(rows, label, key)
    drawn = ranks.join(draws, F.col(label).eqNullSafe(F.col("_label")) & (ranks["_rank"] == draws["_rank"])).select(*rows.columns, "copy")
    return rows.withColumn("copy", F.lit(0).cast("long")).unionByName(drawn)


def importances(model, names: list[str], top: int = 5) -> list[tuple[str, float]]:
    """The largest feature importances of a fitted tree model."""
    return sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:top]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
