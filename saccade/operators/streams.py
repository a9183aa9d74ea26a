"""Slices, windows and summaries of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_time(events: DataFrame, start: float, stop: float) -> DataFrame:
    return events.where((F.col("t") >= start) & (F.col("t") < stop))


def slice_region(events: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return events.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def with_first(events: DataFrame, scene: list[str] | None = None) -> DataFrame:
    """events with _first, the time of the first event (a scalar subquery) or of each scene's own (a row a scene)."""
    if scene:
        return events.join(F.broadcast(events.groupBy(*scene).agg(F.min("t").alias("_first"))), scene)
    return events.withColumn("_first", events.agg(F.min("t")).scalar())


def with_window(events: DataFrame, window_us: float, scene: list[str] | None = None) -> DataFrame:
    """events with window_id, counted from the first event or from each scene's own."""
    return with_first(events, scene).withColumn("window_id", F.floor((F.col("t") - F.col("_first")) / window_us)).drop("_first")


def time_windows(events: DataFrame, window_us: float) -> DataFrame:
    """As with_window(), but for readers that stop at the last event's time: an event exactly there on
    a border is outside, and a stream of one instant has no window."""
    first, last = events.agg(F.min("t")).scalar(), events.agg(F.max("t")).scalar()
    rows = events.withColumn("window_id", F.floor((F.col("t") - first) / window_us))
    return rows.where(first + F.col("window_id") * window_us < last)


def summary(events: DataFrame) -> DataFrame:
    """One row: counts by polarity, extent in time and space, events a second (0 for no duration)."""
    n = F.count("*")
    span = F.max("t") - F.min("t")
    pos = F.count_if(F.col("p") > 0)
    return events.agg(
        n.alias("n_events"), span.alias("duration_us"), (span / 1000).alias("duration_ms"),
        F.coalesce(F.try_divide(n, span * F.lit(1e-6)), F.lit(0.0)).alias("event_rate"),
        pos.alias("n_pos"), (n - pos).alias("n_neg"), F.try_divide(pos * F.lit(100.0), n).alias("pos_pct"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )


def rate_histogram(events: DataFrame, bins: int = 79) -> DataFrame:
    """Counts of object, rain and snow events in equal bins over the stream; the last bin is closed."""
    first, last = events.agg(F.min("t")).scalar(), events.agg(F.max("t")).scalar()
    b = F.least(F.lit(bins - 1), F.floor((F.col("t") - first) / (last - first) * bins))
    kind = F.col("label")
    return events.where(last > first).groupBy(b.alias("bin")).agg(F.count_if((kind >= 0) & (kind < 10)).alias("objects"), F.count_if(kind == 10).alias("rain"), F.count_if(kind == 11).alias("snow"), F.count("*").alias("total"))
