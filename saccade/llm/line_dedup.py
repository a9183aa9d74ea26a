"""Line deduplication over levelled sorted runs of line hashes.

The runs say in how many documents each line (a 128-bit hash of its key) was seen. They are immutable
tables, bucketed and sorted by the hash, so that joining and merging them needs no further shuffle of
theirs. Each new batch of documents merge-anti-joins the lines that the runs have settled already
(seen often enough) and adds its own counts as a new run of level 0; when a level holds ``fanout``
runs they are merged into one run of the next level, and the old ones are dropped after that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saccade.llm.common import SPACES, ascii_lower, private_names, row_key, shared_dir, stored, without


def line_keys(text: str, min_chars: int = 1) -> Column:
    """Each line's key (stripped, A-Z in lower case); null for keys under min_chars code points."""
    lines = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n")
    return F.transform(lines, lambda x: F.when(F.length(F.btrim(x, F.lit(SPACES))) >= min_chars, F.btrim(x, F.lit(SPACES))))


def _hashes(keys: Column) -> Column:
    return F.transform(keys, lambda x: F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))))


class LineRuns:
    """Runs of (h1, h2, n): n documents had the line."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made, self.levels = f"saccade_runs_{uuid.uuid4().hex}", 0, [[]]

    def _save(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_{level}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs' lines with their counts added up: sorted runs of equal buckets merge as they are."""
        whole = self.spark.table(names[0])
        for n in names[1:]:
            other = self.spark.table(n).withColumnRenamed("n", "m")
            whole = whole.join(other, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return whole

    def add(self, docs: DataFrame, text: str = "text", min_chars: int = 1) -> None:
        """Counts a batch's lines, without those that a run has settled, into a new run."""
        hashes = F.filter(F.array_distinct(_hashes(line_keys(text, min_chars))), lambda x: x.isNotNull())
        own = docs.select(F.explode(hashes).alias("h")).groupBy("h.h1", "h.h2").agg(F.count("*").alias("n"))
        for n in self._names():
            settled = self.spark.table(n).where(F.col("n") >= self.min_docs)
            own = own.join(settled.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._save(own, 0)
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                self._save(self._merged(names), level + 1)
                self.levels[level] = []
                for n in names:
                    self.spark.sql(f"DROP TABLE {n}")
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines that min_docs documents or more have."""
        return self._merged(self._names()).where(F.col("n") >= self.min_docs).select("h1", "h2")

    def drop(self) -> None:
        for n in self._names():
            self.spark.sql(f"DROP TABLE {n}")
        self.levels = [[]]


@private_names
def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the lines outside ``frequent``, joined by newlines."""
    docs = without(docs, "n_lines", "n_dropped", "kept_text")
    keyed = docs.select("*", *row_key(*docs.columns))
    lines = keyed.select("_k1", "_k2", F.posexplode(_hashes(line_keys(text, min_chars))).alias("_pos", "_h")).where("_h is not null").select("_k1", "_k2", "_pos", "_h.h1", "_h.h2")
    gone = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_gone"))

    @F.pandas_udf("string")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def cut(t: str | None, gone) -> str | None:
            if t is None:
                return None
            drop = set(gone)
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

        for texts, places in batches:
            yield pd.Series([cut(t, g) for t, g in zip(texts, places, strict=True)], dtype=object)

    t = F.coalesce(F.col(text), F.lit(""))
    rows = keyed.join(gone, ["_k1", "_k2"], "left")
    some = F.col("_gone").isNotNull()
    return rows.select(
        *docs.columns,
        F.size(F.split(t, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(some, rest(F.when(some, t), "_gone")).otherwise(t).alias("kept_text"),
    )


@private_names
def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, text: str = "text") -> DataFrame:
    """drop_lines() of all lines whose key min_docs documents or more have, counted batch by batch.

    Every row is a document, repeated rows too. A null or empty text is one empty line and stays as
    it is. Columns named n_lines, n_dropped or kept_text are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    hashed = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c != text] or [F.lit(0)]), F.lit(batches))
    try:
        for b in range(batches):
            runs.add(docs.where(hashed == b), text, min_chars)
        frequent = stored(runs.frequent(), f"{shared_dir(spark)}/frequent")
    finally:
        runs.drop()
    return drop_lines(docs, frequent, text, min_chars)
