"""Noise filter and track linking on streams whose events come late and in any order.

Rows wait in their key's state until the watermark has passed them; a timer then releases them in order
of time, so that what comes out is what a batch over the same rows gives, however files were dealt.
Rows later than the watermark are dropped and counted by Spark (late_rows). Timers stand on a grid of
``step_ms``; a key has one for its first row that waits and one for its end, so it has few of them. State is lists of rows, which Spark's state reader shows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from saccade.functions.schema import HEIGHT, WIDTH, WINDOW_US
from saccade.operators.tracking import Linker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of a density below this nothing is kept.
LEAST_DENSITY = 1e-12


def on_rocks(spark: SparkSession) -> None:
    """The state store that these operators need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def late_rows(query: StreamingQuery) -> int:
    """Rows of an ended query's last batches that came after the watermark and were dropped."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def due(ms: float, step_ms: int) -> int:
    """When rows of this time are complete: the next place on the grid."""
    return (int(ms // step_ms) + 1) * step_ms


def passed(timers, expired, step_ms: int) -> int:
    """The last place on the grid that the watermark has passed: a first timer does the work of all that are due."""
    return max(expired.getExpiryTimeInMs(), timers.getCurrentWatermarkInMs() // step_ms * step_ms)


#: Rows that become Python values, or an element of the state, at a time.
PART = 8192
CELLS = ("t", "event_id", "x", "y", "p", "own")


class NoiseFilter(StatefulProcessor):
    """A tile's pixels over a slab of time (or over all time, where radii depend on density): last times, and densities."""

    def __init__(self, tile: int, radius: int, dt_us: float, step_ms: int, adaptive: dict | None, scene: list[str], slab_us: float | None):
        self.tile, self.radius, self.dt_us, self.step_ms, self.adaptive, self.scene, self.slab_us = tile, radius, dt_us, step_ms, adaptive, scene, slab_us
        self.edge = max(radius, adaptive["half"] if adaptive else 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        cells = "t array<double>, event_id array<long>, x array<int>, y array<int>, p array<int>, own array<boolean>"
        self.waiting = handle.getListState("waiting", cells)  # an element for each part of a batch: a call for each row would be slow
        self.last = handle.getListState("last", "x int, y int, t double, density double, number long")

    def _end(self, key) -> float:
        """When a key's slab ends, in microseconds."""
        return (int(key[-1]) + 1) * self.slab_us if self.slab_us else math.inf

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            self.waiting.appendValue(tuple(part[c].tolist() for c in CELLS))
            self.handle.registerTimer(due(part["t"].min() / 1000, self.step_ms))
        if self.slab_us:
            self.handle.registerTimer(due(self._end(key) / 1000, self.step_ms))  # what is left of an ended slab goes
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = passed(timerValues, expiredTimerInfo, self.step_ms) * 1000
        over = upto >= self._end(key)
        parts = [[np.asarray(c) for c in part] for part in self.waiting.get()] if self.waiting.exists() else []
        rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
        early = rows[0] < upto if parts else np.zeros(0, bool)
        if not early.any():
            if over:
                self.last.clear()
            return
        rest = [c[~early] for c in rows]
        self.waiting.clear()
        if len(rest[0]):
            self.waiting.put([tuple(c[a : a + PART].tolist() for c in rest) for a in range(0, len(rest[0]), PART)])
            self.handle.registerTimer(due(rest[0].min() / 1000, self.step_ms))
        placed = early & ~pd.isna(rows[2]) & ~pd.isna(rows[3])  # what has no place is near nothing
        ready = [c[placed].astype(k) for c, k in zip(rows, ("f8", "i8", "i8", "i8", "i8", "?"), strict=True)]
        order, n = np.lexsort(ready[::-1]), int(placed.sum())
        if not n:
            return
        ready = [c[order] for c in ready]
        edge, size = self.edge, self.tile + 2 * self.edge
        x0, y0 = int(key[-3]) * self.tile - edge, int(key[-2]) * self.tile - edge
        last, density, number = np.full((size, size), -np.inf), np.zeros((size, size)), np.zeros((size, size), "i8")
        for x, y, t, d, m in self.last.get() if self.last.exists() else []:
            last[y, x], density[y, x], number[y, x] = t, d, m
        kept = np.zeros(n, bool)
        for a in range(0, n, PART):
            for at, (t, i, x, y, _, own) in enumerate(zip(*(c[a : a + PART].tolist() for c in ready), strict=True), a):
                px, py = x - x0, y - y0
                if own:
                    r = self._radius(density, number, i, x, y, px, py) if self.adaptive else self.radius
                    kept[at] = last[max(0, py - r) : py + r + 1, max(0, px - r) : px + r + 1].max() > t - self.dt_us
                if self.adaptive:
                    density[py, px] = density[py, px] * self.adaptive["decay"] ** (i - number[py, px]) + 1
                    number[py, px] = i
                last[py, px] = t
        live = (last > float(ready[0][-1]) - self.dt_us) & (not over)
        if self.adaptive:
            live |= density * self.adaptive["decay"] ** np.maximum(ready[1][-1] - number, 0.0) > LEAST_DENSITY
        ys, xs = np.nonzero(live)
        state = [(int(x), int(y), float(last[y, x]), float(density[y, x]), int(number[y, x])) for x, y in zip(xs, ys, strict=True)]
        self.last.put(state) if state else self.last.clear()
        if kept.any():
            t, i, x, y, p = (c[kept] for c in ready[:-1])
            yield pd.DataFrame({c: [v] * len(t) for c, v in zip(self.scene, key, strict=False)} | {"event_id": i, "t": t, "x": x, "y": y, "p": p})

    def _radius(self, density: np.ndarray, number: np.ndarray, i: int, x: int, y: int, px: int, py: int) -> int:
        half, (first, second), (wide, medium, tight) = self.adaptive["half"], self.adaptive["dense"], self.adaptive["radii"]
        near = np.s_[max(0, py - half) : py + half + 1, max(0, px - half) : px + half + 1]
        total = (density[near] * self.adaptive["decay"] ** np.maximum(i - 1 - number[near], 0.0)).sum()
        area = (min(x + half, WIDTH - 1) - max(x - half, 0) + 1) * (min(y + half, HEIGHT - 1) - max(y - half, 0) + 1)
        return tight if total / area > second else medium if total / area > first else wide

    def close(self) -> None:
        pass


def noise_stream(events: DataFrame, radius: int = 10, dt_us: float = 8000.0, tile: int | None = None, late: str = "1 second", step_ms: int = 10, adaptive: dict | None = None, scene: list[str] | None = None, slab_us: float = 1e6) -> DataFrame:
    """(scene..., event_id, t, x, y, p) of a stream's events that have an earlier one at most radius away on both axes and less
    than dt_us before; events may come in any order, by up to ``late``. The sensor is cut into tiles, which
    also see the events around them, and time into slabs, which also see the dt_us before them, so that no key of the
    state grows with the stream; sensors (scene: columns that name them) are apart. adaptive: decay, half, dense and radii of
    denoise.with_radius(), for a radius by local density; event_id must then number the events, from any number on without
    gaps. Densities depend on all events before, so time is not cut then, and tiles are smaller."""
    on_rocks(events.sparkSession)
    radius = max(adaptive["radii"]) if adaptive else radius
    edge = max(radius, adaptive["half"] if adaptive else 0)
    tile = tile or (32 if adaptive else 128)
    slab = None if adaptive else max(slab_us, dt_us)

    def tiles(c: str, size: int):
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - edge) / tile)), F.least(F.lit((size - 1) // tile), F.floor((F.col(c) + edge) / tile)))).alias(f"t{c}")

    ts = F.timestamp_micros(F.col("t").cast("long") + 1)  # a watermark begins at 0, and what isn't later is late
    timed = events.withColumn("ts", ts).withWatermark("ts", late)
    scene, kinds = scene or [], dict(events.dtypes)
    slabs = F.explode(F.sequence(F.floor(F.col("t") / slab), F.floor((F.col("t") + dt_us) / slab))) if slab else F.lit(0).cast("long")
    rows = timed.select(*scene, "ts", "event_id", "t", "x", "y", "p", tiles("x", WIDTH)).select("*", tiles("y", HEIGHT)).select("*", slabs.alias("tt"))
    out = ", ".join([*(f"{c} {kinds[c]}" for c in scene), "event_id long, t double, x int, y int, p int"])
    own = (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty"))
    if slab:
        own &= F.floor(F.col("t") / slab) == F.col("tt")
    return rows.withColumn("own", own).groupBy(*scene, "tx", "ty", "tt").transformWithStateInPandas(NoiseFilter(tile, radius, dt_us, step_ms, adaptive, scene, slab), out, "Append", "EventTime")


class TrackLinker(StatefulProcessor):
    """A scene's open tracks, the detections that wait, the next track's number and the last window seen."""

    def __init__(self, link_px: float, max_gap: int, window_us: float, step_ms: int, idle_ms: int):
        self.link_px, self.max_gap, self.window_us, self.step_ms, self.idle_ms = link_px, max_gap, window_us, step_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "window_id long, cluster_id long, cx double, cy double")
        self.open = handle.getListState("open", "track_id long, window_id long, cx double, cy double, length long")
        self.next = handle.getValueState("next", "track_id long, window_id long")

    def _end(self, window: int) -> float:
        """Milliseconds at which a window ends."""
        return (window + 1) * self.window_us / 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            cells = part[["window_id", "cluster_id", "cx", "cy"]]
            self.waiting.appendList([(int(w), int(c), float(x), float(y)) for w, c, x, y in cells.itertuples(index=False)])
            self.handle.registerTimer(due(self._end(int(part["window_id"].min())), self.step_ms))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = passed(timerValues, expiredTimerInfo, self.step_ms)
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if self._end(r[0]) < now], [r for r in rows if self._end(r[0]) >= now]
        next_id, seen = self.next.get() if self.next.exists() else (0, -1)
        linker = Linker(self.link_px, self.max_gap, list(self.open.get()) if self.open.exists() else [], next_id)
        found = [(*linker.add(w, x, y), w, c) for w, c, x, y in ready]
        if rest:
            self.handle.registerTimer(due(self._end(rest[0][0]), self.step_ms))
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            seen = max(seen, ready[-1][0])
            self.next.update((linker.next_id, seen))
            self.handle.registerTimer(due(self._end(seen + self.max_gap + 1), self.step_ms))
            self.handle.registerTimer(due(self._end(seen) + self.idle_ms, self.step_ms))
        linker.expire(math.ceil(now * 1000 / self.window_us) - 1)  # the first window that may still come
        tracks = [(int(i), int(w), float(x), float(y), int(n)) for i, w, x, y, n in linker.open]
        self.open.put(tracks) if tracks else self.open.clear()
        if not rest and not tracks and now >= self._end(seen) + self.idle_ms:
            self.next.clear()
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["scene", "track_id", "seq", "window_id", "cluster_id"])

    def close(self) -> None:
        pass


def link_stream(detections: DataFrame, link_px: float = 40.0, max_gap: int = 3, window_us: float = WINDOW_US, late: str = "1 second", step_ms: int = 100, idle_ms: int = 60_000) -> DataFrame:
    """(scene, track_id, seq, window_id, cluster_id) of a stream of detections (scene, window_id, cluster_id, cx, cy) that
    may come in any order, by up to ``late`` of their windows' times. Tracks leave the state when nothing can
    join them any more; a scene for which the watermark is idle_ms past its last window has ended, and its
    numbering goes too."""
    on_rocks(detections.sparkSession)
    ends = F.timestamp_micros(((F.col("window_id") + 1) * window_us).cast("long"))
    rows = detections.withColumn("ts", ends).withWatermark("ts", late)
    out = "scene string, track_id long, seq long, window_id long, cluster_id long"
    return rows.groupBy("scene").transformWithStateInPandas(TrackLinker(link_px, max_gap, window_us, step_ms, idle_ms), out, "Append", "EventTime")
