"""As-of nearest neighbours: the best earlier partner of each row within a time gap and a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.functions.scratch import stored

#: What share of the distance is searched first; sides of the cells, in distances and gaps.
FIRST, CELLS = 0.25, 2


def _candidates(ask: DataFrame, have: DataFrame, px: float, max_gap: int, by: list[str]) -> DataFrame:
    """ask (by..., _t, _x, _y, ...) with each row of have (by..., _t0, _x0, _y0, ...) that may be less than px away and 1 to
    max_gap earlier. Space and time are cut into cells of CELLS such sizes, so that this is an equi-join: a row of ask
    is in its own cell, one of have in all that it reaches."""
    place = lambda c: F.floor(c / (CELLS * px))
    tick = lambda c: F.floor(c / (CELLS * max_gap))
    reached = lambda c: F.explode(F.sequence(place(F.col(c) - px), place(F.col(c) + px)))
    one = ask.withColumns({"_cx": place(F.col("_x")), "_cy": place(F.col("_y")), "_ct": tick(F.col("_t"))})
    two = have.select("*", F.explode(F.sequence(tick(F.col("_t0") + 1), tick(F.col("_t0") + max_gap))).alias("_ct"))
    two = two.select("*", reached("_x0").alias("_cx")).select("*", reached("_y0").alias("_cy"))
    return one.join(two, [*by, "_cx", "_cy", "_ct"])


def _best(ask: DataFrame, have: DataFrame, px: float, max_gap: int, key: list[str], by: list[str]) -> DataFrame:
    """ask with _best: the least partner less than px away, or null."""
    dx, dy, gap = F.col("_x") - F.col("_x0"), F.col("_y") - F.col("_y0"), F.col("_t") - F.col("_t0")
    pairs = _candidates(ask, have, px, max_gap, by).withColumns({"_d": dx * dx + dy * dy, "gap": gap})
    pairs = pairs.where((F.col("gap") >= 1) & (F.col("gap") <= max_gap) & (F.col("_d") < px * px))
    best = F.min(F.struct("_d", "gap", *[f"near_{c}" for c in key])).alias("_best")
    return ask.join(pairs.groupBy(*by, *key).agg(best), [*by, *key], "left")


def nearest_before(left: DataFrame, right: DataFrame, max_px: float, max_gap: int, key: list[str], time: str = "window_id", x: str = "cx", y: str = "cy", by: list[str] | None = None) -> DataFrame:
    """left (key, time, x, y, by...) with distance, gap and near_<key> of its nearest row of right that is 1 to max_gap
    earlier and less than max_px away; of equally near ones the latest, then the least by key. Rows without a
    partner have nulls; by: columns that both must share.

    Where rows are dense, most have a partner much nearer than max_px. So a share of the distance is searched first: whoever
    finds a partner there has compared all that are as near. Only the others are searched for up to max_px. Each row
    keeps the least of its candidates by an aggregate that is combined before the shuffle, so none gather.
    """
    by = by or []
    cells = [F.col(time).alias("_t"), F.col(x).alias("_x"), F.col(y).alias("_y")]
    ask = stored(left.select(*by, *key, *cells))
    have = ask if right is left else right.select(*by, *key, *cells)
    have = have.select(*by, *[F.col(c).alias(f"near_{c}") for c in key], *[F.col(c).alias(f"{c}0") for c in ("_t", "_x", "_y")])
    have = have if right is left else stored(have)
    first = stored(_best(ask, have, FIRST * max_px, max_gap, key, by))
    rest = _best(first.where("_best IS NULL").drop("_best"), have, max_px, max_gap, key, by)
    both = first.where("_best IS NOT NULL").unionByName(rest)
    return both.select(*by, *key, F.sqrt("_best._d").alias("distance"), "_best.gap", *[F.col(f"_best.near_{c}") for c in key])
