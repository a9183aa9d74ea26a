"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

A source is a queue of blocks of ``block_size`` documents. With an integer share e of a period of P
slots (P: the sum of all shares), its block k is released at slot floor(k * P / e) and due by slot
ceil((k + 1) * P / e); each slot goes to the released block that is due first. Earliest deadline first
meets every deadline here, so after any number of slots each source is less than one block away from
its exact share. The schedule repeats after P slots: one period is computed, and the slot of every
block follows from its number. Where a source has run out its slots stay empty, and the others go on
in their proportions; no document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccade.llm.common import private_names, shared_dir, stored, without

#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 10_000
ADDED = ["block", "slot", "place"]

#: The blocks of one period that have a slot of their own to be found, in the order in which they get it:
#: at each step time goes on to the next slot, or to the next release if no block is released yet, and
#: the released block that is due first is picked.
SCHEDULE = """
aggregate(
  sequence(1L, greatest(total, 1L)),
  named_struct('t', 0L, 'done', transform(shares, x -> 0L), 'picks', cast(array() as array<struct<i: int, slot: bigint>>)),
  (acc, step) -> transform(
    array(named_struct('left', filter(zip_with(transform(shares, (e, i) -> named_struct('e', e, 'i', i)), acc.done,
      (s, d) -> named_struct('due', ((d + 1) * period + s.e - 1) div s.e, 'i', s.i, 'from', (d * period) div s.e, 'open', d < s.e)), c -> c.open))),
    q -> transform(
      array(named_struct('now', greatest(acc.t, array_min(q.left.from)))),
      n -> transform(
        array(array_min(transform(filter(q.left, c -> c.from <= n.now), c -> named_struct('due', c.due, 'i', c.i))).i),
        p -> named_struct('t', n.now + 1, 'done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)),
                          'picks', array_append(acc.picks, named_struct('i', p, 'slot', n.now))))[0])[0])[0],
  acc -> acc.picks)
"""


def slots(sources: DataFrame, power: float, resolution: int) -> DataFrame:
    """From (_src, n, given): (_src, _share, _period, _slots), _slots being those of one period that each
    source has, in order. A share that isn't given is n to the power, scaled so that all shares come
    to about resolution, and 1 at least.

    Sources of share 1 may lie anywhere in the period, so only the others (about resolution at most, if
    shares aren't given) are scheduled in one row; those of share 1 take the slots left free, by name."""
    scale = F.lit(resolution) / sources.agg(F.sum(F.pow("n", F.lit(power)))).scalar()
    own = F.greatest(F.round(scale * F.pow("n", F.lit(power))).cast("long"), F.lit(1).cast("long"))
    table = sources.select("_src", F.coalesce("given", own).alias("_share"))
    period = table.agg(F.sum("_share")).scalar()
    one = table.where("_share > 1").agg(F.sort_array(F.collect_list(F.struct("_src", "_share"))).alias("_all")).where(F.size("_all") > 0)
    one = one.select(period.alias("period"), F.col("_all._src").alias("names"), F.col("_all._share").alias("shares"), F.aggregate("_all._share", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    rows = one.select("names", "shares", F.explode(F.expr(SCHEDULE)).alias("p"))
    rows = rows.select(F.col("names")[F.col("p.i")].alias("_src"), F.col("shares")[F.col("p.i")].alias("_share"), F.col("p.slot").alias("slot"))
    many = rows.groupBy("_src", "_share").agg(F.sort_array(F.collect_list("slot")).alias("_slots"))

    # the r-th free slot is r and as many more as taken ones lie before it
    taken = rows.agg(F.sort_array(F.collect_list("slot")).alias("_taken"))
    free = F.transform("_taken", lambda u, i: u - i)
    few = ranked(table.where("_share = 1"), "_src").withColumn("_before", taken.select(free).scalar())
    few = few.select("_src", F.lit(1).cast("long").alias("_share"), F.array(F.col("_rank") + F.size(F.filter("_before", lambda u: u <= F.col("_rank")))).alias("_slots"))
    return many.unionByName(few).select("_src", "_share", period.alias("_period"), "_slots")


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows with _rank, from 0, in order of the name's md5: hash ranges are counted and sorted apart."""
    cut = rows.withColumn("_md5", F.md5(name)).withColumn("_part", F.substring("_md5", 1, 3))
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_md5", name)) - 1 + F.col("_before")
    return cut.join(before, "_part").withColumn("_rank", rank).select(*rows.columns, "_rank")


@private_names
def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_size: int = 64, power: float = 0.5, resolution: int = 1000, source: str = "source", by: str = "doc_id") -> DataFrame:
    """docs with block (number of the block in its source), slot (its turn among all blocks) and place
    (0 and up inside the block): the mix is the order of (slot, place).

    weights: integer shares by source, 1 for sources that it leaves out; without it, shares follow
    the source's number of documents to the power given. Documents of a source queue up by
    md5(by), then by ``by``, then by the hash of the whole row; rows equal in all columns take any
    order. A null source is a source of its own, a null key comes first. Columns named block, slot or
    place are replaced. An empty table gives an empty table. The number of sources bounds the rows
    of the schedule's one computation; documents never meet in one place: ranks inside a source come
    from 4096 hash ranges counted and sorted apart.
    """
    spark = docs.sparkSession
    docs = without(docs, *ADDED)
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("none"))
    digest = F.md5(F.coalesce(F.col(by).cast("string"), F.lit("")))
    keyed = docs.select("*", named.alias("_src"), digest.alias("_md5")).withColumn("_part", F.substring("_md5", 1, 3))

    counts = keyed.groupBy("_src", "_part").agg(F.count("*").alias("n"))
    given = F.lit(None).cast("long")
    if weights is not None:
        pairs = F.create_map(*[F.lit(x) for k, v in ({"": 1} | weights).items() for x in (f"s{k}", int(v))])
        given = F.coalesce(F.try_element_at(pairs, F.col("_src")), F.lit(1)).cast("long")
    sources = counts.groupBy("_src").agg(F.sum("n").alias("n")).withColumn("given", given)
    table = stored(slots(sources, power, resolution), f"{shared_dir(spark)}/slots")

    before = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_src", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_src", "_part").orderBy("_md5", F.col(by).asc_nulls_first(), F.xxhash64(*docs.columns))
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["_src", "_part"])
    small = len(table.select("_share").take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    ranked = ranked.join(F.broadcast(table) if small else table, "_src")
    rank = F.col("_before") + F.col("_rank")
    ranked = ranked.withColumn("block", F.expr(f"(_before + _rank) div {int(block_size)}")).withColumn("place", F.pmod(rank, F.lit(block_size)).cast("int"))
    turn = F.expr("(block div _share) * _period + _slots[cast(block % _share as int)]")
    return ranked.select(*docs.columns, "block", turn.cast("long").alias("slot"), "place")
