"""Event streams from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a sensor stream on the replay clock: an event every 15 microseconds."""
    return to_stream(read(spark, sf_dir, "events"))


def to_stream(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(-1)
    return events.select(
        "event_id",
        (F.col("event_id") * F.lit(15.0)).alias("t"),
        (F.col("user_id") * 37 % 346).cast("int").alias("x"),
        F.least(F.lit(259), F.floor(F.col("value") * 1.5)).cast("int").alias("y"),
        F.when(kind.isin("click", "view", "signup"), 1).otherwise(-1).alias("p"),
        label.alias("label"),
    )
