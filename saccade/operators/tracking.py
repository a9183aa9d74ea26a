"""Tracks from detections: greedy nearest neighbours in time order, in blocks that agree."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccade.functions.scratch import stored

#: Numbers in a block of running().
BLOCK = 4096
#: Windows in a block of link(), and windows before it that its first state comes from.
SPAN, WARM = 32, 16


class Linker:
    """Open tracks of one scene. A detection goes to the track whose last detection is nearest, closer
    than link_px and at most max_gap windows ago; the older track wins a tie. Several detections of one
    window may join one track. tied: whether a tie was between two of the tracks that were open at first."""

    def __init__(self, link_px: float, max_gap: int, state: list | None = None, next_id: int = 0):
        self.link_px, self.max_gap, self.next_id, self.first_id, self.tied = link_px, max_gap, next_id, next_id, False
        self.open: list[list] = [list(s) for s in state or []]  # id, window, cx, cy, length
        self.window: int | None = None  # the last one that tracks were closed for

    def add(self, window: int, cx: float, cy: float) -> tuple[int, int]:
        """(track, number of the detection in it)"""
        if window != self.window:
            self.expire(window)
        if self.open:
            d = [math.sqrt((cx - o[2]) ** 2 + (cy - o[3]) ** 2) for o in self.open]
            least = min(d)
            if least < self.link_px:
                if not self.tied and d.count(least) > 1 and sum(o[0] < self.first_id for o, e in zip(self.open, d, strict=True) if e == least) > 1:
                    self.tied = True
                o = self.open[d.index(least)]
                o[1:] = [window, cx, cy, o[4] + 1]
                return o[0], o[4] - 1
        self.open.append([self.next_id, window, cx, cy, 1])
        self.next_id += 1
        return self.next_id - 1, 0

    def expire(self, window: int) -> None:
        """Closes the tracks that nothing from this window on can join."""
        self.open, self.window = [o for o in self.open if window - o[1] <= self.max_gap], window


PLACE = "struct<window_id:long,cluster_id:long>"
OPEN = "struct<window_id:long,cluster_id:long,cx:double,cy:double,track:long>"
BLOCKS = f"members array<struct<track:long,seq:long,window_id:long,cluster_id:long>>, before array<{PLACE}>, after array<{OPEN}>, tied boolean"


def _linked_blocks(rows: DataFrame, scene: list[str], link_px: float, max_gap: int, span: int) -> DataFrame:
    """(scene..., _block, BLOCKS): a row for each block of span windows. rows: detections by block; those of windows
    before it are linked first, or with _rank they are the open tracks' last detections, in order of age."""
    key, kinds = [*scene, "_block"], dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        start = int(g["_block"].iloc[0]) * span
        g = g.sort_values(["_rank", "window_id", "cluster_id"], kind="stable")
        linker, last = Linker(link_px, max_gap), {}
        ahead, own = g[g["window_id"] < start], g[g["window_id"] >= start]
        for w, c, x, y, rank in ahead[["window_id", "cluster_id", "cx", "cy", "_rank"]].itertuples(index=False):
            if rank == rank and rank is not None:
                linker.open.append([linker.next_id, int(w), x, y, 0])
                linker.next_id += 1
                last[linker.next_id - 1] = int(w), int(c)
            else:
                last[linker.add(int(w), x, y)[0]] = int(w), int(c)
        linker.expire(start)
        before = [last[o[0]] for o in linker.open]
        linker = Linker(link_px, max_gap, [[i, *o[1:4], 0] for i, o in enumerate(linker.open)], len(before))
        last, members = dict(enumerate(before)), []
        for w, c, x, y in own[["window_id", "cluster_id", "cx", "cy"]].itertuples(index=False):
            track, seq = linker.add(int(w), x, y)
            members.append({"track": track, "seq": seq, "window_id": int(w), "cluster_id": int(c)})
            last[track] = int(w), int(c)
        linker.expire(start + span)
        after = [{"window_id": last[o[0]][0], "cluster_id": last[o[0]][1], "cx": o[2], "cy": o[3], "track": o[0]} for o in linker.open]
        made = {c: [g[c].iloc[0]] for c in key} | {"members": [members], "before": [[{"window_id": w, "cluster_id": c} for w, c in before]], "after": [after], "tied": [linker.tied]}
        return pd.DataFrame(made) if members else pd.DataFrame(made).iloc[:0]

    schema = ", ".join([f"{c} {kinds[c]}" for c in scene] + ["_block long", BLOCKS])
    return rows.select(*key, "window_id", "cluster_id", "cx", "cy", "_rank").groupBy(*key).applyInPandas(run, schema)


def _places(c: str) -> Column:
    return F.transform(c, lambda o: F.struct(o["window_id"].alias("window_id"), o["cluster_id"].alias("cluster_id")))


def _again(rows: DataFrame, given: DataFrame, scene: list[str], link_px: float, max_gap: int, span: int) -> DataFrame:
    """Blocks linked again, from the open tracks (scene..., _block, given) that they are to begin with."""
    key = [*scene, "_block"]
    own = rows.join(given.select(*key), key, "left_semi").withColumn("_rank", F.lit(None).cast("long"))
    first = given.select(*key, F.posexplode("given").alias("_rank", "_o")).select(*key, "_o.window_id", "_o.cluster_id", "_o.cx", "_o.cy", F.col("_rank").cast("long"))
    return _linked_blocks(own.unionByName(first), scene, link_px, max_gap, span)


def _resolved(blocks: DataFrame, scene: list[str], any_open: bool) -> DataFrame:
    """(scene..., _block, track, track_id, _ahead): each block's tracks with their numbers in the scene and how many
    detections they have in earlier blocks. Tracks that go on from block to block are chains; pointers to
    parents are doubled until all point at the first block's track."""
    key = [*scene, "_block"]
    nodes = blocks.select(*key, F.explode("members").alias("m")).groupBy(*key, F.col("m.track").alias("track")).agg(F.count("*").alias("n"), F.min(F.struct("m.window_id", "m.cluster_id")).alias("first"))
    none = F.lit(None).cast("long")
    if any_open:
        below = blocks.select(*key, F.posexplode("before").alias("track", "o")).select(*key, F.col("track").cast("long"), "o.*", (F.col("_block") - 1).alias("_up_block"))
        above = blocks.select(*scene, F.col("_block").alias("_up_block"), F.explode("after").alias("o")).select(*scene, "_up_block", "o.window_id", "o.cluster_id", F.col("o.track").alias("_up"))
        parents = below.join(above, [*scene, "_up_block", "window_id", "cluster_id"]).select(*key, "track", "_up_block", "_up")
        sizes = nodes.select(*scene, F.col("_block").alias("_up_block"), F.col("track").alias("_up"), F.col("n").alias("_ahead"))
        nodes = nodes.join(parents, [*key, "track"], "left").join(sizes, [*scene, "_up_block", "_up"], "left")
        nodes = stored(nodes.select(*key, "track", "n", "first", "_up_block", "_up", F.coalesce("_ahead", F.lit(0).cast("long")).alias("_ahead")))
        while True:
            up = nodes.where("_up IS NOT NULL").select(*scene, F.col("_block").alias("_up_block"), F.col("track").alias("_up"), F.col("_up_block").alias("_far_block"), F.col("_up").alias("_far"), F.col("_ahead").alias("_more"))
            if up.isEmpty() or nodes.join(up, [*scene, "_up_block", "_up"], "left_semi").isEmpty():
                break
            on = nodes.join(up, [*scene, "_up_block", "_up"], "left")
            far = lambda c, d: F.coalesce(d, c).alias(c)
            nodes = stored(on.select(*key, "track", "n", "first", far("_up_block", F.col("_far_block")), far("_up", F.col("_far")), (F.col("_ahead") + F.coalesce("_more", F.lit(0))).alias("_ahead")))
    else:
        nodes = nodes.select("*", none.alias("_up_block"), none.alias("_up"), F.lit(0).cast("long").alias("_ahead"))
    roots = nodes.where("_up IS NULL").select(*scene, F.col("_block").alias("_up_block"), F.col("track").alias("_up"), "first.window_id", "first.cluster_id")
    place = F.row_number().over(Window.partitionBy(*scene, "window_id").orderBy("cluster_id")) - 1
    counts = roots.groupBy(*scene, "window_id").agg(F.count("*").alias("_n"))
    ahead = running(counts, F.sum, "_n", scene, "window_id", inclusive=False)
    roots = roots.withColumn("_place", place).join(ahead, [*scene, "window_id"])
    roots = roots.select(*scene, "_up_block", "_up", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias("track_id"))
    own = nodes.withColumns({"_up_block": F.coalesce("_up_block", "_block"), "_up": F.coalesce("_up", "track")})
    return own.join(roots, [*scene, "_up_block", "_up"]).select(*key, "track", "track_id", "_ahead")


def link(detections: DataFrame, link_px: float = 40.0, max_gap: int = 3, scene: list[str] | None = None, span: int = SPAN, warm: int = WARM) -> DataFrame:
    """(scene..., track_id, seq, window_id, cluster_id); tracks are numbered in each scene by their first detections.

    Greedy linking is a chain through the whole stream, but what one window hands to the next is little:
    the last detections of the tracks that are open. Blocks of span windows are linked in parallel, each
    after ``warm`` windows before it, by when its open tracks are mostly those of the whole stream. Then
    each block's first state is compared with what the block before it left; blocks that began with
    another state are linked again with the right one, until all agree. By induction from the first
    block the result is that of one pass. A tie between tracks that are older than a block goes by the tracks'
    numbers; blocks that have met one are checked against the numbers that come out. No group is larger
    than a block, whatever the stream.
    """
    scene, span = scene or [], max(span, max_gap + 1)
    key, warm = [*scene, "_block"], min(warm, span)
    block = F.floor(F.col("window_id") / span).cast("long")
    rows = stored(detections.select(*scene, F.col("window_id").cast("long"), F.col("cluster_id").cast("long"), "cx", "cy", block.alias("_block")))
    late = F.col("window_id") - F.col("_block") * span >= span - warm
    both = rows.withColumn("_block", F.explode(F.when(late, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    blocks = stored(_linked_blocks(both.withColumn("_rank", F.lit(None).cast("long")), scene, link_px, max_gap, span))
    empty = F.array().cast(f"array<{OPEN}>")
    while True:
        left = blocks.select(*scene, (F.col("_block") + 1).alias("_block"), F.col("after").alias("given"))
        with_given = blocks.join(left, key, "left").withColumn("given", F.coalesce("given", empty))
        differs = F.sort_array("before") != F.sort_array(_places("given"))
        wrong, tied, any_open = with_given.agg(F.count_if(differs), F.count_if("tied"), F.max(F.size("before"))).first()
        if wrong:
            given = stored(with_given.where(differs).select(*key, "given"))
            blocks = stored(blocks.join(given, key, "left_anti").unionByName(_again(rows, given, scene, link_px, max_gap, span)))
            continue
        numbers = _resolved(blocks, scene, bool(any_open))
        if tied:
            numbers = stored(numbers)
            entries = with_given.where("tied").select(*key, F.posexplode("given").alias("_i", "o")).withColumns({"_own": F.col("_block"), "_block": F.col("_block") - 1, "track": F.col("o.track")})
            by_age = entries.join(numbers, [*key, "track"]).groupBy(*scene, F.col("_own").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("track_id", "o"))).alias("s"))
            right = with_given.where("tied").select(*key, "before").join(by_age.select(*key, F.transform("s", lambda e: e["o"]).alias("given")), key)
            given = stored(right.where(F.col("before") != _places("given")).select(*key, "given"))
            if not given.isEmpty():
                blocks = stored(blocks.join(given, key, "left_anti").unionByName(_again(rows, given, scene, link_px, max_gap, span)))
                continue
        break
    members = blocks.select(*key, F.explode("members").alias("m")).select(*key, "m.*")
    out = members.join(numbers, [*key, "track"]).withColumn("seq", F.col("seq") + F.col("_ahead"))
    return out.select(*scene, "track_id", "seq", "window_id", "cluster_id")


def running(rows: DataFrame, how: Callable[[str], Column], column: str, group: list[str], order: str, inclusive: bool = True) -> DataFrame:
    """(group..., order, _before): the sum or maximum (how: F.sum or F.max) of a column over all rows up to
    each one, or before it, by the number ``order``, which is unique in a group. Blocks of numbers are
    summed up first, so that a group's rows never meet in one task, only a row for each of its blocks."""
    kept = rows.select(*group, order, F.col(column).alias("_v"), F.floor(F.col(order) / BLOCK).cast("long").alias("_block"))
    blocks = kept.groupBy(*group, "_block").agg(how("_v").alias("_v"))
    ahead = how("_v").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = kept.withColumn("_own", how("_v").over(inside)).join(blocks.select(*group, "_block", ahead.alias("_ahead")), [*group, "_block"])
    both = F.array_compact(F.array("_ahead", "_own"))
    total = F.array_max(both) if how is F.max else F.when(F.size(both) > 0, F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x))
    return out.select(*group, order, total.alias("_before"))


def long_tracks(members: DataFrame, min_length: int, scene: list[str] | None = None) -> DataFrame:
    """members of tracks of at least min_length detections."""
    key = [*(scene or []), "track_id"]
    n = members.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_length).select(*key)
    return members.join(n, key, "left_semi")


def vote(labels: DataFrame, key: list[str]) -> DataFrame:
    """(key..., gt_class) from rows of (key..., label): the label that most events have, among those that
    aren't noise, the lowest of equals; -1 where all are noise."""
    counts = labels.groupBy(*key, "label").agg(F.count("*").alias("n"))
    real = F.col("label") >= 0
    best = F.max(F.when(real, F.struct("n", (-F.col("label")).alias("m"))))
    return counts.groupBy(*key).agg(best.alias("_b")).select(*key, F.coalesce(-F.col("_b.m"), F.lit(-1)).cast("int").alias("gt_class"))


def middle_boxes(tracked: DataFrame, key: list[str]) -> DataFrame:
    """The box and centre of each track's middle detection (number n div 2 from 0)."""
    w = Window.partitionBy(*key)
    rows = tracked.withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("seq") == F.expr("_n div 2")).select(*key, "x_min", "y_min", "x_max", "y_max", "cx", "cy")
