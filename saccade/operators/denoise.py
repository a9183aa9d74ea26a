"""Background-activity filters: an event stays if an earlier one is near it in space and time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccade.functions.schema import HEIGHT, WIDTH
from saccade.operators.tracking import running

MODES = ("ba_filter", "multi_scale", "density_adaptive")
#: What remains of a pixel's density after each event, pixels around an event whose mean is its
#: local density, densities above which the radius is the second and the third of RADII.
DECAY, HALF, DENSE, RADII = 0.995, 4, (15.0, 40.0), (8, 4, 2)
#: Events in a block of the density's sums, at most; time slices in which events are numbered.
LONGEST, SLICE_US = 65_536, 2000.0


#: Sides of the noise filters' cells, in reaches: an event's row goes to few cells beside its own.
CELLS = 4
#: Columns of a cell.
CELL = ("_cx", "_cy", "_ct")


def _near(events: DataFrame, radius: int, dt_us: float, own: str | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Later events, earlier events and when the two are near: at most radius apart on both axes (or the later
    event's own radius, a column, up to that) and less than dt_us. Space and time are cut into cells of several such
    sizes, so that this is an equi-join: a later event is in its own cell, an earlier one in all that it reaches."""
    size, long = CELLS * (radius + 1), CELLS * dt_us
    place = lambda c: F.floor(c / size).cast("int")
    tick = lambda c: F.floor(c / long)
    reached = lambda c: F.explode(F.sequence(place(F.col(c) - radius), place(F.col(c) + radius)))
    old = events.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select(F.col("event_id").alias("other"), F.col("t").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    old = old.select("*", F.explode(F.sequence(tick(F.col("t0")), tick(F.col("t0") + dt_us))).alias("_ct"))
    old = old.select("*", reached("x0").alias("_cx")).select("*", reached("y0").alias("_cy"))
    new = events.select("*", place(F.col("x")).alias("_cx"), place(F.col("y")).alias("_cy"), tick(F.col("t")).alias("_ct"))
    before = (F.col("t0") < F.col("t")) | ((F.col("t0") == F.col("t")) & (F.col("other") < F.col("event_id")))
    reach = F.col(own) if own else F.lit(radius)
    close = (F.abs(F.col("x") - F.col("x0")) <= reach) & (F.abs(F.col("y") - F.col("y0")) <= reach)
    return new, old, before & close & (F.col("t0") > F.col("t") - dt_us)


def ba_filter(events: DataFrame, radius: int, dt_us: float = 8000.0, min_neighbours: int = 1, own: str | None = None) -> DataFrame:
    """events with at least min_neighbours earlier ones near them (its own pixel counts). own: a column with
    each event's radius, up to ``radius``, which no other event's matters for. Both joins are merged: their sides grow
    with the stream, and what Spark guesses of their sizes knows nothing of the cells, so it would send one to all."""
    new, old, fits = _near(events, radius, dt_us, own)
    keys = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in CELL]
    both = new.alias("n"), old.alias("o").hint("merge"), [*keys, fits]
    if min_neighbours <= 1:  # an event is in one cell, so it stays once at most, with all its columns
        return both[0].where("event_id IS NOT NULL").join(*both[1:], "left_semi").select(*events.columns)
    kept = both[0].join(*both[1:]).groupBy("event_id").count().where(F.col("count") >= min_neighbours).select("event_id")
    return events.join(kept.hint("merge"), "event_id", "left_semi")


def numbered(events: DataFrame, name: str = "number") -> DataFrame:
    """events with their number from 0 in order of time and event_id; slices of time are counted and sorted apart."""
    cut = events.withColumn("_slice", F.floor(F.col("t") / SLICE_US).cast("long"))
    counts = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = running(counts, F.sum, "_n", [], "_slice", inclusive=False)
    place = F.row_number().over(Window.partitionBy("_slice").orderBy("t", "event_id")) - 1
    return cut.withColumn("_place", place).join(before, "_slice").select(*events.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def local_density(events: DataFrame, decay: float = DECAY, half: int = HALF) -> DataFrame:
    """(event_id, density): the mean, over the pixels at most half away on both axes and on the sensor, of a map
    to which each earlier event added 1 at its pixel, and which each event since has multiplied by decay.

    Sums over the square are made in two steps, as it is a product: an event adds to the 2 * half + 1 cells
    (x, y) of its row, and asks the cells of its column. A cell's decayed sum up to each event is a running
    sum of decay ** -number, over blocks of numbers short enough for these to stay exact; what earlier
    blocks left is carried on, as far back as a double can tell.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    rate = -math.log(decay)
    span = max(1, min(LONGEST, int(27 / rate)))  # decay ** -span is about 5e11
    back = math.ceil(55 / (rate * span))
    rows = numbered(events.select("event_id", "t", "x", "y"), "_i").withColumn("_block", F.floor(F.col("_i") / span).cast("long"))
    lo = lambda c: F.greatest(F.col(c) - half, F.lit(0))
    hi = lambda c, n: F.least(F.col(c) + half, F.lit(n - 1))
    power = lambda e: F.pow(F.lit(decay), e)
    offset = F.col("_i") - F.col("_block") * span
    cell = ["_px", "_py", "_block"]
    add = rows.select(F.explode(F.sequence(lo("x"), hi("x", WIDTH))).alias("_px"), F.col("y").alias("_py"), "_block", "_i", power(-offset).alias("_w"), F.lit(None).cast("long").alias("event_id"))
    ask = rows.select(F.col("x").alias("_px"), F.explode(F.sequence(lo("y"), hi("y", HEIGHT))).alias("_py"), "_block", "_i", F.lit(0.0).alias("_w"), "event_id")
    ahead = Window.partitionBy(*cell).orderBy("_i").rangeBetween(Window.unboundedPreceding, -1)
    sums = add.unionByName(ask).withColumn("_s", F.sum("_w").over(ahead)).where("event_id IS NOT NULL")
    left = add.groupBy(*cell).agg((F.sum("_w") * power(F.lit(span - 1))).alias("_t"))  # at the block's end
    left = left.select("_px", "_py", "_block", "_t", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_k"))
    left = left.groupBy("_px", "_py", (F.col("_block") + F.col("_k")).alias("_block")).agg(F.sum(F.col("_t") * power((F.col("_k") - 1) * span)).alias("_t"))
    value = power(offset - 1) * F.coalesce("_s", F.lit(0.0)) + power(offset) * F.coalesce("_t", F.lit(0.0))
    total = sums.join(left, cell, "left").groupBy("event_id").agg(F.sum(value).alias("_sum"))
    area = (hi("x", WIDTH) - lo("x") + 1) * (hi("y", HEIGHT) - lo("y") + 1)
    return total.join(events.select("event_id", area.alias("_area")), "event_id").select("event_id", (F.col("_sum") / F.col("_area")).alias("density"))


def with_radius(events: DataFrame, decay: float = DECAY, half: int = HALF, dense: tuple[float, float] = DENSE, radii: tuple[int, int, int] = RADII) -> DataFrame:
    """events with radius: the first of radii where the local density is at most the first of dense, and so on. With
    values at which no density can get above dense (the default ones) nothing is summed up."""
    wide, medium, tight = radii
    if 1 / (1 - decay) <= dense[0] * (half + 1) ** 2:  # all events at one pixel in a corner
        return events.withColumn("radius", F.lit(wide))
    d = F.col("density")
    radius = F.when(d > dense[1], tight).when(d > dense[0], medium).otherwise(wide)
    return events.join(local_density(events, decay, half), "event_id").withColumn("radius", radius).drop("density")


def density_adaptive(events: DataFrame, dt_us: float = 8000.0, decay: float = DECAY, half: int = HALF, dense: tuple[float, float] = DENSE, radii: tuple[int, int, int] = RADII) -> DataFrame:
    """events with an earlier one at most their radius away, which is smaller where events are dense."""
    rows = with_radius(events, decay, half, dense, radii)
    return ba_filter(rows, max(radii), dt_us, own="radius").select(*events.columns)


def denoise(events: DataFrame, mode: str = "multi_scale", dt_us: float = 8000.0, radii: tuple[int, ...] = (2, 5, 10), radius: int = 2) -> DataFrame:
    """ba_filter: one radius. multi_scale: any of several radii, which is the largest alone, as the smaller
    squares lie in it. density_adaptive: the radius by local density."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "density_adaptive":
        return density_adaptive(events, dt_us)
    return ba_filter(events, radius if mode == "ba_filter" else max(radii), dt_us)


def with_keep(events: DataFrame, kept: DataFrame) -> DataFrame:
    """events with keep: whether the filter kept it."""
    flag = kept.select("event_id", F.lit(True).alias("keep"))
    return events.join(flag, "event_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
