"""The same analytics on streams: windows over event time. Noise filter and track linking: stateful."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saccade.functions.scratch import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """The events table as a stream; event time is a timestamp, as watermarks need."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return _windowed(rows, "event_type")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _windowed(events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")))


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return _windowed(events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id"), "user_id")


def _windowed(groups, *keys: str) -> DataFrame:
    rows = groups.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select(text("w.start").alias("start"), text("w.end").alias("stop"), *keys, "n", "total")


def run(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Appends what the stream gives to the folder out, until all that is there has been read; goes on from state."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drained(stream: DataFrame, *closing: Callable[[], None]) -> DataFrame:
    """What the stream gives in append mode once all that is there has been read, as a table. Watermarks hold
    windows back until later events have come: after each of closing, which adds such events, the stream starts
    again and goes on."""
    spark, base = stream.sparkSession, shared_dir(stream.sparkSession)
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{base}/none")
    for step in (None, *closing):
        if step:
            step()
        run(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/none").unionByName(spark.read.schema(stream.schema).parquet(f"{base}/out"))


def closable(spark: SparkSession, folder: str) -> tuple[DataFrame, Callable[[], None]]:
    """The events table as a stream, and what closes it: one event a year after its last one and a milliard
    numbers on, whose own windows are never given out."""
    path = f"{shared_dir(spark)}/closing"
    empty = spark.createDataFrame([], EVENTS)
    empty.write.parquet(path)

    def close() -> None:
        last = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet").agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
        far = {"ts": F.col("ts") + F.expr("INTERVAL 1 YEAR"), "event_id": F.col("event_id") + 1_000_000_000}
        row = last.select(*[far.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.dtypes])
        row.write.mode("append").parquet(path)

    return events_stream(spark, folder).unionByName(events_stream(spark, path, "*.parquet")), close
