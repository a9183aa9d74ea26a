"""The event schema, sensor constants and labels."""

from __future__ import annotations

from pyspark.sql import types as T

WIDTH, HEIGHT = 346, 260
WINDOW_US = 5000.0
#: Object classes, noise, rain and snow.
CLASSES = {0: "Car", 1: "Pedestrian", 2: "Cyclist", 3: "Ball", 4: "Drone", 5: "Truck"}
NOISE, RAIN, SNOW = -1, 10, 11

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("p", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
])
