"""Synthetic scenes as DataFrames: moving objects, rain and snow. Randomness comes from hashes of
(seed, row), so that a scene is the same however Spark partitions the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.functions.schema import HEIGHT, NOISE, RAIN, SNOW, WIDTH

#: Class, width, height, speed x, speed y, events a step, motion.
OBJECTS = [(0, 55, 22, 3.5, 0.1, 16, "straight"), (1, 16, 48, 0.7, 0.0, 10, "bounce"), (2, 26, 34, 1.8, 0.1, 13, "straight"), (3, 12, 12, 3.2, 2.5, 8, "arc"), (4, 13, 10, 2.5, 2.5, 7, "zigzag"), (5, 80, 30, 1.5, 0.0, 20, "straight")]
#: Class and starting place of each object.
PLACES = [(0, 10, 90), (1, 60, 55), (2, 120, 175), (3, 30, 30), (4, 200, 100), (5, 10, 200), (0, 10, 140), (1, 180, 40)]
STEPS = 400
#: Drops a second, streak lengths, speeds in px/ms, spread.
RAIN_LEVELS = {"light": (200, 3, 8, 8, 15, 1), "medium": (600, 5, 15, 10, 20, 2), "heavy": (1500, 8, 25, 12, 25, 2)}
#: Flakes a second, radii, speeds in px/ms, drift.
SNOW_LEVELS = {"light": (50, 2, 6, 0.5, 2.0, 0.5), "medium": (150, 3, 10, 0.8, 3.0, 1.0), "heavy": (400, 4, 14, 1.0, 4.0, 2.0)}


def uniform(seed: int, salt: str, *keys: str) -> Column:
    """In (0, 1), from a hash of the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, salt: str, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, salt + "a", *keys))) * F.cos(6.283185307179586 * uniform(seed, salt + "b", *keys))


def about(mean: Column, seed: int, salt: str, *keys: str) -> Column:
    """A count near the mean, as a Poisson draw is for means that aren't small."""
    return F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * normal(seed, salt, *keys))).cast("int")


def objects(spark: SparkSession, duration_ms: float = 200.0, n_objects: int = 6, noise_rate: float = 0.05, seed: int = 42, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(t, x, y, p, label): events on the sides of moving boxes, and noise of noise_rate times as many."""
    places = [(i, *OBJECTS[c], sx, sy) for i, (c, sx, sy) in enumerate(PLACES[:n_objects])]
    table = spark.createDataFrame(places, "obj int, cls int, w int, h int, vx double, vy double, dens int, motion string, sx int, sy int")
    steps = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    s, m = F.col("step"), F.col("motion")
    far = F.when(m == "arc", 0.45).when(m == "zigzag", 0.3).otherwise(0.55)
    dx = F.col("vx") * s * far * F.when(m == "zigzag", F.signum(F.sin(s * 0.06))).otherwise(1.0)
    dy = F.when(m == "bounce", 8 * F.sin(s * 0.09)).otherwise(F.col("vy") * s * far * F.when(m == "zigzag", F.signum(F.cos(s * 0.06))).otherwise(1.0) - F.when(m == "arc", 0.004 * s * s).otherwise(0.0))

    def inside(v: Column, half: Column, most: int) -> Column:
        return F.least(F.greatest(v, half + 1), F.lit(most) - half - 1)

    cx = inside(F.col("sx") + dx + 0.4 * normal(seed, "x", "obj", "step"), F.expr("w div 2"), width)
    cy = inside(F.col("sy") + dy + 0.4 * normal(seed, "y", "obj", "step"), F.expr("h div 2"), height)
    steps = steps.withColumns({"cx": cx, "cy": cy, "n": about(F.col("dens").cast("double"), seed, "n", "obj", "step")}).where("n > 0")
    rows = steps.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    key = ("obj", "step", "k")
    side, u = F.floor(4 * uniform(seed, "side", *key)).cast("int"), uniform(seed, "along", *key) - 0.5
    x = F.col("cx") + F.when(side == 2, -F.col("w") / 2).when(side == 3, F.col("w") / 2).otherwise(u * F.col("w"))
    y = F.col("cy") + F.when(side == 0, -F.col("h") / 2).when(side == 1, F.col("h") / 2).otherwise(u * F.col("h"))
    dt = duration_ms * 1000.0 / STEPS
    t = s * dt + dt * uniform(seed, "t", *key)
    made = rows.select(t.alias("t"), F.least(F.greatest(x, F.lit(0)), F.lit(width - 1)).cast("int").alias("x"), F.least(F.greatest(y, F.lit(0)), F.lit(height - 1)).cast("int").alias("y"), F.when(side < 2, 1).otherwise(-1).alias("p"), F.col("cls").alias("label"))
    noise = made.agg(F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.count("*") * noise_rate).cast("int")))).alias("k"))
    noise = noise.select((duration_ms * 1000.0 * uniform(seed, "nt", "k")).alias("t"), F.floor(width * uniform(seed, "nx", "k")).cast("int").alias("x"), F.floor(height * uniform(seed, "ny", "k")).cast("int").alias("y"), F.when(uniform(seed, "np", "k") < 0.5, 1).otherwise(-1).alias("p"), F.lit(NOISE).alias("label"))
    return made.unionByName(noise)


def _on_sensor(rows: DataFrame, t0: float, duration_us: float, width: int, height: int, label: int) -> DataFrame:
    rows = rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height) & (F.col("t") >= t0) & (F.col("t") < t0 + duration_us))
    return rows.select("t", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "p", F.lit(label).alias("label"))


def rain(spark: SparkSession, level: str, duration_us: float, t0: float = 0.0, seed: int = 123, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Streaks: positive events on a drop's upper half, negative ones below."""
    rate, l0, l1, v0, v1, r = RAIN_LEVELS[level]
    drops = spark.range(int(rate * duration_us / 1e6)).withColumnRenamed("id", "d")
    u = lambda s: uniform(seed, s, "d")
    drops = drops.withColumns({"x0": F.floor(u("x") * width), "y0": F.floor(u("y") * (height // 3)), "len": F.floor(l0 + u("l") * (l1 - l0)), "v": v0 + u("v") * (v1 - v0), "at": t0 + u("t") * duration_us, "drift": u("s") * 0.6 - 0.3})
    drops = drops.withColumn("n", about(F.col("len") * 3.0, seed, "n", "d")).where("n > 0")
    rows = drops.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("q", uniform(seed, "q", "d", "k"))
    q = F.col("q")
    rows = rows.select((F.col("at") + q * F.col("len") / F.col("v") * 1000).alias("t"), (F.col("x0") + F.col("drift") * q * F.col("len") + r * normal(seed, "dx", "d", "k")).alias("x"), (F.col("y0") + q * F.col("len") + 0.5 * r * normal(seed, "dy", "d", "k")).alias("y"), F.when(q < 0.5, 1).otherwise(-1).alias("p"))
    return _on_sensor(rows, t0, duration_us, width, height, RAIN)


def snow(spark: SparkSession, level: str, duration_us: float, t0: float = 0.0, seed: int = 123, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Slow flat blobs of mixed polarity."""
    rate, r0, r1, v0, v1, drift = SNOW_LEVELS[level]
    flakes = spark.range(int(rate * duration_us / 1e6)).withColumnRenamed("id", "d")
    u = lambda s: uniform(seed, "s" + s, "d")
    flakes = flakes.withColumns({"x0": F.floor(u("x") * width), "y0": F.floor(u("y") * height), "r": F.floor(r0 + u("r") * (r1 - r0)), "v": v0 + u("v") * (v1 - v0), "at": t0 + u("t") * duration_us, "drift": (u("d") * 2 - 1) * drift})
    flakes = flakes.withColumn("n", about(2.0 * F.col("r") * F.col("r"), seed, "sn", "d")).where("n > 0")
    rows = flakes.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    rows = rows.withColumns({"q": uniform(seed, "sq", "d", "k"), "a": 6.283185307179586 * uniform(seed, "sa", "d", "k"), "rr": F.col("r") * uniform(seed, "sr", "d", "k")})
    rows = rows.select((F.col("at") + F.col("q") * 2 * F.col("r") / F.col("v") * 1000).alias("t"), (F.col("x0") + F.col("drift") * F.col("q") * 2 * F.col("r") + F.col("rr") * F.cos("a")).alias("x"), (F.col("y0") + F.col("q") * 2 * F.col("r") + 0.5 * F.col("rr") * F.sin("a")).alias("y"), F.when(uniform(seed, "sp", "d", "k") < 0.45, -1).otherwise(1).alias("p"))
    return _on_sensor(rows, t0, duration_us, width, height, SNOW)


def numbered(scene: DataFrame) -> DataFrame:
    """The scene with event_id in order of time: 2 ms slices are counted and sorted apart."""
    from pyspark.sql import Window

    cut = scene.withColumn("_slice", F.floor(F.col("t") / 2000.0))
    counts = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = counts.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_slice").orderBy("t", "x", "y", "p", "label")
    return cut.withColumn("_r", F.row_number().over(order)).join(before, "_slice").select((F.col("_before") + F.col("_r") - 1).alias("event_id"), *scene.columns)


def add_weather(clean: DataFrame, rain_level: str | None, snow_level: str | None, duration_us: float, seed: int = 123) -> DataFrame:
    """clean (t, x, y, p, label) with rain and snow events added to it."""
    spark, out = clean.sparkSession, clean.select("t", "x", "y", "p", "label")
    if rain_level:
        out = out.unionByName(rain(spark, rain_level, duration_us, seed=seed))
    if snow_level:
        out = out.unionByName(snow(spark, snow_level, duration_us, seed=seed))
    return out


def weather_stats(scene: DataFrame) -> DataFrame:
    n_rain, n_snow = F.count_if(F.col("label") == RAIN), F.count_if(F.col("label") == SNOW)
    return scene.agg(F.count("*").alias("total"), n_rain.alias("rain"), n_snow.alias("snow"), F.try_divide((n_rain + n_snow) * 100.0, F.count("*")).alias("weather_pct"))
