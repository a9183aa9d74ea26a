"""Small helpers that the corpus operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words, as a Java regex class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column) -> Column:
    """Runs of characters other than white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's content, so that joins need not carry it. Hashes skip
    nulls, so which columns are null is hashed too."""
    cells = [*columns, *[F.col(c).isNull() for c in columns]]
    return [F.xxhash64(*cells).alias("_k1"), F.xxhash64(F.lit(7), *cells).alias("_k2")]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver can read."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.getCheckpointDir() is None:  # one process: tests and single machines
            context.setCheckpointDir(tempfile.mkdtemp(prefix="saccade-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/saccade-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read again: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that stored() wrote and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of a filter of keys: at most 65,536 rows of 16 bytes, which is what is broadcast.
FILTER_BITS = 1 << 22


def filter_of(keys: DataFrame, path: str) -> DataFrame:
    """A Bloom filter, of set size, of the one column of 64-bit keys: for among()."""
    bit = F.pmod(keys.columns[0], F.lit(FILTER_BITS))
    bits = keys.select(F.shiftright(bit, 6).alias("_place"), F.expr(f"shiftleft(1L, cast(pmod({keys.columns[0]}, {FILTER_BITS}) & 63 as int))").alias("_bit"))
    return stored(bits.groupBy("_place").agg(F.bit_or("_bit").alias("_mask")), path)


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows whose key the filter has, and a few others: so few rows move to the join that decides."""
    bit = F.pmod(key, F.lit(FILTER_BITS))
    hit = F.expr(f"shiftleft(1L, cast(pmod({key}, {FILTER_BITS}) & 63 as int))").bitwiseAND(F.col("_mask")) != 0
    return rows.withColumn("_place", F.shiftright(bit, 6)).join(F.broadcast(keys), "_place").where(hit).select(*rows.columns)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def private_names(operator: Callable) -> Callable:
    """An operator on documents that may have columns of any name: those that begin with an underscore, as
    the operators' own do, have other names while it works."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named):
        taken = {c: f"own{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not taken:
            return operator(docs, *args, **named)
        new = lambda x: [new(y) for y in x] if isinstance(x, list) else taken.get(x, x) if isinstance(x, str) else x
        out = operator(docs.withColumnsRenamed(taken), *map(new, args), **{k: new(v) for k, v in named.items()})
        return out.withColumnsRenamed({v: k for k, v in taken.items()}) if isinstance(out, DataFrame) else out

    return run
