"""Density clustering of each window's events.

Radii and thresholds are column expressions; neighbour counts, core points and classic DBSCAN are
joins inside a window. The expanding kernel depends on the order of events and is a grouped function:
a window is one group, of as many events as a sensor makes in one window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccade.functions.schema import HEIGHT, WIDTH, WINDOW_US
from saccade.operators.streams import with_first, with_window


@dataclass(frozen=True)
class Detector:
    """c2, c1, base: radius as a polynomial of the distance from the centre (or of x); k: neighbours needed."""

    name: str
    c2: float = 0.0
    c1: float = 0.0
    base: float = 10.0
    k: int = 5
    radius_of: str = "radial"
    dual: tuple[float, float] | None = None
    t_scale_us: float | None = None
    window_us: float = WINDOW_US
    link_px: float = 40.0
    max_gap: int = 3
    min_length: int = 4


#: The named configurations.
DETECTORS = {d.name: d for d in (
    Detector("DBSCAN"),
    Detector("ADB-Hard", 1e-4, -0.02, 10.0),
    Detector("ADB-Opt", 2e-4, -0.03, 9.5),
    Detector("Dual-Hard", 1e-4, -0.02, 10.0, dual=(42.0, 25.0)),
    Detector("Dual-Opt", 2e-4, -0.03, 9.5, dual=(42.0, 25.0)),
    Detector("3D-DBSCAN", t_scale_us=500.0),
    Detector("3D-ADB-Opt", 2e-4, -0.03, 9.5, t_scale_us=500.0),
)}
LEAST_EPS = 0.9


def _poly(v: Column, c2: float, c1: float, base: float) -> Column:
    return F.lit(c2) * v * v + F.lit(c1) * v + F.lit(base)


def centre_distance() -> Column:
    dx, dy = F.col("x") - WIDTH / 2, F.col("y") - HEIGHT / 2
    return F.sqrt(dx * dx + dy * dy)


def eps_radial(c2: float, c1: float, base: float) -> Column:
    return F.greatest(_poly(centre_distance(), c2, c1, base), F.lit(LEAST_EPS))


def eps_xpos(c2: float, c1: float, base: float) -> Column:
    return F.greatest(_poly(F.col("x"), c2, c1, base), F.lit(LEAST_EPS))


def k_xpos(c2: float, c1: float, base: float) -> Column:
    return F.greatest(F.floor(_poly(F.col("x"), c2, c1, base)), F.lit(1)).cast("int")


def k_dual(k: int, centre: float, edge: float) -> Column:
    """Half-even rounding; grows from k at the centre to k * centre / edge at the corners."""
    d = F.least(F.greatest(centre_distance() / math.hypot(WIDTH / 2, HEIGHT / 2), F.lit(0.0)), F.lit(1.0))
    local = F.lit(centre) * (1 - d) + F.lit(edge) * d
    return F.greatest(F.lit(2), F.rint(F.lit(k * centre) / F.greatest(local, F.lit(1.0)))).cast("int")


def lidar_radius(span: Column, n: Column, k: Column, dims: int = 2) -> Column:
    """The radius in which k of n points lie if they fill a volume of this extent evenly."""
    eps = 0.7 * F.pow(span * k * math.gamma(dims / 2 + 1) / (n * math.sqrt(math.pi**dims)), F.lit(1.0 / dims))
    return F.greatest(eps, F.lit(LEAST_EPS))


def eps_lidar(rows: DataFrame, k: int, dims: int = 2) -> DataFrame:
    """(window_id, eps) from each window's extent over both axes together and its number of points."""
    span = F.greatest(F.max("x"), F.max("y")) - F.least(F.min("x"), F.min("y"))
    return rows.groupBy("window_id").agg(F.count("*").alias("n"), lidar_radius(span, F.count("*"), F.lit(k), dims).alias("eps"))


def with_density(events: DataFrame, d: Detector, scene: list[str] | None = None) -> DataFrame:
    """events with window_id, eps and k of a detector. radius_of: radial (from the centre; k is the
    detector's), pixel (both from x) or lidar (k from x, eps from the window's extent and that k)."""
    return _dense(with_window(events, d.window_us, scene), d, scene)


def _dense(rows: DataFrame, d: Detector, scene: list[str] | None = None) -> DataFrame:
    if d.radius_of in ("pixel", "lidar"):
        rows = rows.withColumn("k", k_xpos(d.c2, d.c1, d.base))
        if d.radius_of == "pixel":
            return rows.withColumn("eps", eps_xpos(d.c2, d.c1, d.base))
        key = [*(scene or []), "window_id"]
        extent = rows.groupBy(*key).agg((F.greatest(F.max("x"), F.max("y")) - F.least(F.min("x"), F.min("y"))).alias("_span"), F.count("*").alias("_m"))
        return rows.join(extent, key).withColumn("eps", lidar_radius(F.col("_span"), F.col("_m"), F.col("k"))).drop("_span", "_m")
    eps = (eps_xpos if d.radius_of == "xpos" else eps_radial)(d.c2, d.c1, d.base)
    k = k_dual(d.k, *d.dual) if d.dual else F.lit(d.k)
    return rows.withColumn("eps", eps).withColumn("k", k)


def eps_stats(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., min, max, mean) of the radii of with_density(); key: window_id if none is given."""
    return rows.groupBy(*(key or ["window_id"])).agg(F.min("eps").alias("min"), F.max("eps").alias("max"), F.avg("eps").alias("mean"))


def n_clusters(clusters: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., n_clusters): clusters of each window, 0 where all events are noise."""
    return clusters.groupBy(*(key or ["window_id"])).agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"))


def neighbours(rows: DataFrame, eps: float) -> DataFrame:
    """(window_id, a, b): pairs of a window's events at most eps apart, each with itself too. Cells of
    the radius make it an equi-join."""
    cell = lambda c: F.floor(F.col(c) / eps)
    one = rows.select("window_id", F.col("event_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*[cell("x") + i for i in (-1, 0, 1)])).alias("cx"), cell("y").alias("_cy"))
    one = one.select("window_id", "a", "ax", "ay", "cx", F.explode(F.array(*[F.col("_cy") + i for i in (-1, 0, 1)])).alias("cy"))
    two = rows.select("window_id", F.col("event_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return one.join(two, ["window_id", "cx", "cy"]).where(dx * dx + dy * dy <= eps * eps).select("window_id", "a", "b")


def neighbour_counts(rows: DataFrame, eps: float) -> DataFrame:
    return neighbours(rows, eps).groupBy("window_id", F.col("a").alias("event_id")).agg(F.count("*").alias("n"))


def core_points(rows: DataFrame, eps: float, min_samples: int) -> DataFrame:
    return neighbour_counts(rows, eps).where(F.col("n") >= min_samples).select("window_id", "event_id")


@dataclass(frozen=True)
class Neighbours:
    """Neighbours of each point as runs of one array: those of point i are of[start[i]:start[i + 1]]."""

    start: np.ndarray
    of: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    def around(self, points: np.ndarray) -> np.ndarray:
        """The neighbours of all points, one after another."""
        lo, n = self.start[points], self.start[points + 1] - self.start[points]
        return self.of[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]


#: Candidates that are looked at together.
CANDIDATES = 1 << 20


def _adjacent(x: np.ndarray, y: np.ndarray, z: np.ndarray | None, eps: np.ndarray) -> Neighbours:
    """The points within eps[i] of each point i, itself included. Points lie in cells of the largest radius, sorted by
    row and column, so that a point's candidates are three runs; all runs are looked at together."""
    n = len(x)
    size = max(float(eps.max(initial=0.0)), 1e-9)
    col, row = np.floor((x - x.min(initial=0)) / size).astype("i8"), np.floor((y - y.min(initial=0)) / size).astype("i8")
    width = int(col.max(initial=0)) + 3
    cell = row * width + col + 1
    order = np.argsort(cell, kind="stable")
    held = cell[order]
    runs = cell[:, None] + np.array([-width, 0, width])
    lo, hi = np.searchsorted(held, runs - 1, "left"), np.searchsorted(held, runs + 1, "right")
    found, counts = [], np.zeros(n, "i8")
    total = np.cumsum((hi - lo).sum(axis=1))
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(CANDIDATES, int(total[-1]) if n else 0, CANDIDATES)) + 1, n))
    for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
        first, many = lo[a:b].ravel(), (hi - lo)[a:b].ravel()
        other = order[np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
        own = np.repeat(np.arange(a, b), (hi - lo)[a:b].sum(axis=1))
        d = (x[other] - x[own]) ** 2 + (y[other] - y[own]) ** 2
        if z is not None:
            d = d + (z[other] - z[own]) ** 2
        near = np.sqrt(d) <= eps[own]
        found.append(other[near])
        counts[a:b] = np.bincount(own[near] - a, minlength=b - a)
    return Neighbours(np.append(0, np.cumsum(counts)), np.concatenate(found) if found else np.empty(0, "i8"))


def expand(near: Neighbours, k: np.ndarray) -> np.ndarray:
    """Labels (0 and up, -1 for noise) of the expanding kernel, in the order of the points.

    A point not reached yet with more than k neighbours (itself included) starts a cluster; its
    neighbours all join it and expand. A point with two neighbours or more expands, core or not: its
    neighbours join too, taken from other clusters if need be, and those not reached before expand.
    Which points a cluster gets doesn't depend on the order of its points, so they expand in waves.
    """
    counts = near.counts()
    labels, reached, cluster = np.full(len(near), -1), np.zeros(len(near), bool), 0
    for i in np.flatnonzero(counts > k).tolist():
        if reached[i]:
            continue
        wave = near.of[near.start[i] : near.start[i + 1]]
        reached[: i + 1] = True  # those before were looked at in their turn
        labels[wave] = cluster
        while len(wave):
            reached[wave] = True
            joined = near.around(wave[counts[wave] >= 2])
            labels[joined] = cluster
            wave = np.unique(joined[~reached[joined]])
        cluster += 1
    return labels


def kernel_clusters(events: DataFrame, d: Detector, scene: list[str] | None = None, cells: list[str] | None = None) -> DataFrame:
    """(scene..., window_id, event_id, cluster_id) of the events of windows with at least k events; -1 is noise. cells: other
    columns of events that come along, so that nothing has to be joined to get them back."""
    scene, cells = scene or [], cells or []
    needed = [*scene, "window_id", "event_id", "t", "x", "y", "eps", "k"]
    rows = with_density(events, d, scene).select(*needed, *[c for c in cells if c not in needed])
    scale, least = d.t_scale_us, d.k

    def cluster(w: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values(["t", "event_id"])
        out = w[[*scene, "window_id", "event_id", *cells]].copy()
        if len(w) < least:
            return out.iloc[:0].assign(cluster_id=pd.Series(dtype="int64"))
        z = None if scale is None else w["t"].to_numpy() / scale
        near = _adjacent(w["x"].to_numpy("f8"), w["y"].to_numpy("f8"), z, w["eps"].to_numpy())
        out["cluster_id"] = expand(near, w["k"].to_numpy())
        return out

    kinds = dict(events.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in scene] + ["window_id long, event_id long"] + [f"{c} {kinds[c]}" for c in cells] + ["cluster_id long"])
    return rows.groupBy(*scene, "window_id").applyInPandas(cluster, schema)


def _pairs(x: np.ndarray, y: np.ndarray, group: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, other, square of their distance): a group's points at most reach apart, each with itself too, in order
    of the first. As _adjacent(), with cells of each group of their own."""
    n, size = len(x), max(reach, 1e-9)
    col, row = np.floor((x - x.min(initial=0)) / size).astype("i8"), np.floor((y - y.min(initial=0)) / size).astype("i8")
    width, height = int(col.max(initial=0)) + 3, int(row.max(initial=0)) + 3
    cell = (group * height + row + 1) * width + col + 1
    order = np.argsort(cell, kind="stable")
    held = cell[order]
    runs = cell[:, None] + np.array([-width, 0, width])
    lo, hi = np.searchsorted(held, runs - 1, "left"), np.searchsorted(held, runs + 1, "right")
    total = np.cumsum((hi - lo).sum(axis=1))
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(CANDIDATES, int(total[-1]) if n else 0, CANDIDATES)) + 1, n))
    found = []
    for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
        first, many = lo[a:b].ravel(), (hi - lo)[a:b].ravel()
        other = order[np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
        own = np.repeat(np.arange(a, b), (hi - lo)[a:b].sum(axis=1))
        d = (x[other] - x[own]) ** 2 + (y[other] - y[own]) ** 2
        near = np.sqrt(d) <= reach
        found.append((own[near], other[near], d[near]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def expand_all(near: Neighbours, k: np.ndarray, group: np.ndarray) -> np.ndarray:
    """expand() of many groups of points (ascending numbers from 0) at once: in each round every group's wave goes on by
    one step, or its next cluster begins. Rounds are as many as the longest group's waves, whatever the number of groups."""
    counts, groups = near.counts(), int(group[-1]) + 1 if len(group) else 0
    labels, reached, place = np.full(len(near), -1), np.zeros(len(near), bool), np.empty(len(near), "i8")
    cluster, last = np.full(groups, -1), np.full(groups, -1)  # each group's number of the cluster, and the point it began at
    seeds, wave = np.flatnonzero(counts > k), np.empty(0, "i8")
    while True:
        busy = np.zeros(groups, bool)
        busy[group[wave]] = True
        seeds = seeds[~reached[seeds]]
        of = group[seeds]
        begin = seeds[np.append(True, of[1:] != of[:-1])[: len(of)] & ~busy[of]]
        if len(begin):
            last[group[begin]] = begin  # those before were looked at in their turn
            cluster[group[begin]] += 1
            joined = near.around(begin)
            labels[joined] = cluster[group[joined]]
            wave = np.append(wave, joined)
        if not len(wave):
            return labels
        reached[wave] = True
        joined = near.around(wave[counts[wave] >= 2])
        of = group[joined]
        labels[joined] = cluster[of]
        new = joined[~reached[joined] & (joined > last[of])]
        place[new] = np.arange(len(new))
        wave = new[place[new] == np.arange(len(new))]  # once each


#: Events whose windows are clustered together, about.
EVENTS = 1 << 16
#: Tasks for each core that windows are dealt to: a task's windows are sorted, and clustered as they come.
TASKS = 3
PLACED = "cx double, cy double, x_min int, x_max int, y_min int, y_max int, n_events long, pol_ratio double, t_min_us double, t_max_us double, t_span_ms double, t_center double"
OWN = "t double, event_id long, x int, y int, p int, label int"


def clustered(events: DataFrame, detectors: list[Detector], scene: list[str] | None = None) -> DataFrame:
    """(detector, scene..., window_id, cluster_id, the columns of detections(), events): what detect() finds by each of
    several detectors of one window length, with each cluster's events (OWN) in order of time. Windows are shuffled
    once for all detectors, and neighbours are looked for once, in the largest radius; many windows are clustered together."""
    scene, (window_us,) = scene or [], {d.window_us for d in detectors}
    key = [*scene, "window_id"]
    rows = with_first(events, scene).withColumn("window_id", F.floor((F.col("t") - F.col("_first")) / window_us))
    rows = rows.select(*key, "event_id", F.col("t").cast("double"), *[F.col(c).cast("int") for c in ("x", "y", "p", "label")], "_first")
    tasks = max(TASKS * events.sparkSession.sparkContext.defaultParallelism, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if any(d.radius_of == "lidar" for d in detectors):  # a join
        rows = _all_dense(rows, detectors, scene).repartition(tasks, *key).sortWithinPartitions(*key, "t", "event_id")
    else:
        rows = _all_dense(rows.repartition(tasks, *key).sortWithinPartitions(*key, "t", "event_id"), detectors, scene)

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in key:
            v = table[c].combine_chunks()
            v = (v if c == "window_id" else v.dictionary_encode().indices.fill_null(-1)).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= EVENTS:
                table = pa.Table.from_batches(held).combine_chunks()
                first = begins(table)
                if len(first) > 1:  # the last window may go on
                    yield from windows(table.slice(0, int(first[-1])), first[:-1])
                    table = table.slice(int(first[-1]))
                held, n = table.to_batches(), len(table)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from windows(table, begins(table))

    def windows(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, sizes = len(table), np.diff(np.append(first, len(table)))
        table = table.combine_chunks()
        cell = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in table.column_names if c not in scene}
        x, y, t, group = cell["x"].astype("f8"), cell["y"].astype("f8"), cell["t"], np.repeat(np.arange(len(first)), sizes)
        own, other, square = _pairs(x, y, group, max(float(cell[f"eps{i}"].max()) for i in range(len(detectors))))
        flat, of, counts, ks = np.sqrt(square), [], [], []
        for i, d in enumerate(detectors):
            z = None if d.t_scale_us is None else t / d.t_scale_us
            near = (flat if z is None else np.sqrt(square + (z[other] - z[own]) ** 2)) <= cell[f"eps{i}"][own]
            of.append(other[near] + n * i)
            counts.append(np.bincount(own[near], minlength=n))
            ks.append(np.where(sizes[group] < d.k, n, cell[f"k{i}"]))  # windows of fewer events have no clusters
        all_groups = np.concatenate([group + len(first) * i for i in range(len(detectors))])
        near = Neighbours(np.append(0, np.cumsum(np.concatenate(counts))), np.concatenate(of))
        labels = expand_all(near, np.concatenate(ks), all_groups).reshape(len(detectors), n)
        for i, d in enumerate(detectors):
            at = np.flatnonzero(labels[i] >= 0)
            place = group[at] * (n + 1) + labels[i][at]
            order = np.argsort(place, kind="stable")
            at, place = at[order], place[order]
            starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
            many = np.diff(np.append(starts, len(at)))
            enough = np.repeat(many >= d.k, many)
            at, many = at[enough], many[many >= d.k]
            if not len(many):
                continue
            ends = np.cumsum(many)
            starts = ends - many
            heads, total = at[starts], lambda v, how=np.add, at=at, starts=starts: how.reduceat(v[at], starts)
            low, high = total(t, np.minimum), total(t, np.maximum)
            cells = [pa.array([d.name] * len(many)), *[table[c].combine_chunks().take(pa.array(heads)) for c in scene], pa.array(cell["window_id"][heads]), pa.array(labels[i][heads])]
            cells += [total(x) / many, total(y) / many, *[total(cell[c], how) for c in ("x", "y") for how in (np.minimum, np.maximum)]]
            cells += [many, total((cell["p"] > 0).astype("f8")) / many, low, high, (high - low) / 1000, cell["_first"][heads] + (cell["window_id"][heads] + 0.5) * window_us]
            names = [f.split()[0] for f in OWN.split(", ")]
            held = pa.StructArray.from_arrays([table[c].combine_chunks().take(pa.array(at)) for c in names], names)
            cells.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), held))
            out = ["detector", *key, "cluster_id", *[f.split()[0] for f in PLACED.split(", ")], "events"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], out)

    kinds = dict(events.dtypes)
    schema = ", ".join(["detector string", *[f"{c} {kinds[c]}" for c in scene], "window_id long, cluster_id long", PLACED, f"events array<struct<{OWN.replace(' ', ':').replace(',:', ',')}>>"])
    return rows.mapInArrow(run, schema)


def _all_dense(rows: DataFrame, detectors: list[Detector], scene: list[str]) -> DataFrame:
    """rows with eps and k of each detector, by its number."""
    for i, d in enumerate(detectors):
        rows = _dense(rows, d, scene).withColumnsRenamed({"eps": f"eps{i}", "k": f"k{i}"})
    return rows


def dbscan_clusters(rows: DataFrame, eps: float = 10.0, min_samples: int = 5) -> DataFrame:
    """(window_id, event_id, cluster_id) by classic DBSCAN: cluster_id is the smallest core event_id of
    the cluster, a border event joins the smallest of its core neighbours' clusters, -1 is noise.
    A window is one group; core events are joined along their neighbours there."""

    def cluster(w: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values("event_id").reset_index(drop=True)
        near = _adjacent(w["x"].to_numpy("f8"), w["y"].to_numpy("f8"), None, np.full(len(w), float(eps)))
        core = near.counts() >= min_samples
        root = np.full(len(w), len(w))
        for i in np.flatnonzero(core).tolist():
            if root[i] < len(w):
                continue
            wave = np.array([i])
            while len(wave):
                root[wave] = i
                joined = near.around(wave)
                wave = np.unique(joined[core[joined] & (root[joined] == len(w))])
        of = np.where(core[near.of], root[near.of], len(w))
        least = np.minimum.reduceat(of, near.start[:-1]) if len(w) else root  # each point is its own neighbour
        ids = w["event_id"].to_numpy()
        out = np.append(ids, -1)[np.where(core, root, least)]
        return pd.DataFrame({"window_id": w["window_id"], "event_id": ids, "cluster_id": out})

    return rows.select("window_id", "event_id", "x", "y").groupBy("window_id").applyInPandas(cluster, "window_id long, event_id long, cluster_id long")


#: Columns of events that detections are made of.
CARRIED = ["t", "x", "y", "p"]


def detections(events: DataFrame, clusters: DataFrame, d: Detector, scene: list[str] | None = None) -> DataFrame:
    """A row for each cluster of at least k events: its window, centre, box, size and share of positive events.
    clusters that have the events' CARRIED columns with them are not joined to events."""
    scene = scene or []
    joined = clusters.where("cluster_id >= 0")
    if not {*CARRIED} <= {*clusters.columns}:
        joined = joined.join(events, [*scene, "event_id"])
    rows = joined.groupBy(*scene, "window_id", "cluster_id").agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.count("*").alias("n_events"), F.avg((F.col("p") > 0).cast("double")).alias("pol_ratio"),
        F.min("t").alias("t_min_us"), F.max("t").alias("t_max_us"), ((F.max("t") - F.min("t")) / 1000).alias("t_span_ms"),
    )
    rows = rows.where(F.col("n_events") >= d.k)
    half = (F.col("window_id") + 0.5) * d.window_us
    if scene:
        return rows.join(events.groupBy(*scene).agg(F.min("t").alias("_first")), scene).withColumn("t_center", F.col("_first") + half).drop("_first")
    return rows.withColumn("t_center", events.agg(F.min("t")).scalar() + half)


def detect(events: DataFrame, d: Detector, scene: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, detections) of a detector."""
    clusters = kernel_clusters(events, d, scene, CARRIED)
    return clusters.drop(*CARRIED), detections(events, clusters, d, scene)
