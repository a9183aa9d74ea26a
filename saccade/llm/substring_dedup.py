"""Repeated passages by content-defined chunking.

A gear rolling hash over the text's bytes (A-Z in lower case, white space as spaces, so that places
stay the same) cuts a chunk wherever the hash of the last 32 bytes falls under a threshold. Where a
cut falls depends on these bytes alone, so an insertion shifts no other cuts, and a passage that two
documents share is cut alike in both. Stretches without such a place are cut where the hash is least.
Cuts move on to the next character's first byte. Chunks are deduplicated by 64-bit digest: a chunk that several
documents have is repeated. Consecutive repeated chunks of a document make a stretch, which takes
several chunks as a rule, so digests that agree by chance make none. A stretch is divided into spans
wherever the first document that has the chunks changes, so that each span has one first holder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccade.llm.common import discard, private_names, row_key, shared_dir, stored

#: Chunk sizes in bytes: least, on average beyond the least, most.
LEAST, AVERAGE, MOST = 16, 24, 256


def _gear() -> np.ndarray:
    """256 fixed 32-bit numbers, one a byte value."""
    x = np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype("u4")


def _plain() -> np.ndarray:
    t = np.arange(256, dtype="u1")
    t[ord("A") : ord("Z") + 1] += 32
    t[9:14] = 32
    return t


GEAR, PLAIN = _gear(), _plain()


def cuts(data: np.ndarray, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of plain bytes. The rolling hash h = 2 * h + gear[byte] forgets a byte after 32
    steps; doubling the span summed over gives all its values at once."""
    if not len(data):
        return np.empty(0, "i8")
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, last = [], 0
    for c in [*(np.flatnonzero(h < np.uint32((1 << 32) // average)) + 1).tolist(), len(data)]:
        while c - last > most:
            last += least + int(np.argmin(h[last + least - 1 : last + most]))
            ends.append(last)
        if c - last >= least:
            ends.append(c)
            last = c
    if last < len(data):
        ends.append(len(data))
    at = np.array(ends)
    inside = np.append((data & 0xC0) == 0x80, False)
    for _ in range(3):  # a character has three more bytes at most
        at += inside[at]
    return np.unique(at)


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_k1, _k2, start, n_bytes, digest): every chunk of every text, by byte offsets."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["_k1", "_k2", "start", "n_bytes", "digest"]
        for batch in batches:
            keys, texts = [batch.column(i).to_numpy() for i in (0, 1)], batch.column(2).to_pylist()
            rows, begin, sizes, digests = [], [], [], []
            for i, t in enumerate(texts):
                data = PLAIN[np.frombuffer(t.encode(), "u1")] if t else np.empty(0, "u1")
                ends = cuts(data)
                if len(ends):
                    raw, starts = data.tobytes(), np.append(0, ends[:-1])
                    digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    rows.append(np.full(len(ends), i))
                    begin.append(starts.astype("i4"))
                    sizes.append((ends - starts).astype("i4"))
                if digests and (len(digests) > 200_000 or i + 1 == len(texts)):
                    at = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), *(pa.array(np.concatenate(x)) for x in (begin, sizes)), pa.array(np.array(digests, "u8").view("i8"))], names=names)
                    rows, begin, sizes, digests = [], [], [], []

    rows = docs.select("_k1", "_k2", F.col(text).alias("_text"))
    return rows.mapInArrow(take, "_k1 long, _k2 long, start int, n_bytes int, digest long")


@private_names
def repeats(docs: DataFrame, min_bytes: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each span of the repeated stretches of at least min_bytes: key, start and n_bytes (in
    the UTF-8 text), n_chunks, first_id (smallest key of the documents that share its chunks, the same for
    each of them) and is_first (no document with a smaller key has any of them). A span may be shorter
    than min_bytes if its stretch isn't. Documents without such stretches have no row.

    key is an integer column. Rows count as different documents if any of their columns differ; rows
    equal in all columns are one document. Null texts have no chunks; a null key is never first. Other
    columns are left out, whatever their names. Very long texts are cut whole. Spans of a document don't
    overlap; an empty table gives no rows.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    keyed = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), *row_key(*docs.columns))
    found = stored(chunks(keyed, "_text"), f"{base}/chunks")
    shared = found.groupBy("digest").agg(F.min("_k1").alias("lo"), F.max("_k1").alias("hi")).where("lo <> hi").select("digest")
    shared = stored(shared, f"{base}/shared")
    again = stored(found.join(shared, "digest", "left_semi"), f"{base}/again")
    discard(spark, f"{base}/chunks")

    doc = ["_k1", "_k2"]
    rows = keyed.select(*doc, "_id").dropDuplicates(doc)
    first = again.select(*doc, "digest").join(rows, doc).groupBy("digest").agg(F.min("_id").alias("first_id"))
    first = stored(first, f"{base}/first")  # so that the join below can split frequent digests
    placed = again.distinct().join(first, "digest").select(*doc, "start", "n_bytes", "first_id")
    inside = Window.partitionBy(*doc).orderBy("start")
    ahead = F.col("start") != F.lag(F.col("start") + F.col("n_bytes"), 1, -1).over(inside)
    other = ahead | ~F.col("first_id").eqNullSafe(F.lag("first_id").over(inside))
    runs = placed.withColumn("_new", ahead.cast("int")).withColumn("_other", other.cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(inside)).withColumn("_span", F.sum("_other").over(inside))
    spans = runs.groupBy(*doc, "_run", "_span").agg(F.min("start").alias("start"), F.sum("n_bytes").cast("int").alias("n_bytes"), F.count("*").alias("n_chunks"), F.min("first_id").alias("first_id"))
    spans = spans.withColumn("_stretch", F.sum("n_bytes").over(Window.partitionBy(*doc, "_run"))).where(F.col("_stretch") >= min_bytes)
    spans = spans.join(rows, doc)
    return spans.select(F.col("_id").alias(key), "start", "n_bytes", "n_chunks", "first_id", (F.col("_id") <= F.col("first_id")).alias("is_first"), *doc)


@private_names
def drop_repeats(docs: DataFrame, min_bytes: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cut down to what no document of a smaller key has already. Null and empty texts stay
    as they are; a text that is repeated whole becomes empty; repeated rows are cut alike."""
    spans = repeats(docs, min_bytes, key, text).where("not coalesce(is_first, false)")
    gone = spans.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("_gone"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, places: pd.Series) -> pd.Series:
        def cut(t: str | None, spans) -> str | None:
            if t is None:
                return None
            raw, out, at = t.encode(), [], 0
            for s in spans:
                out.append(raw[at : s["start"]])
                at = s["start"] + s["n_bytes"]
            return b"".join([*out, raw[at:]]).decode()  # cuts lie between characters

        return pd.Series([cut(t, g) for t, g in zip(texts, places, strict=True)], dtype=object)

    rows = docs.select("*", *row_key(*docs.columns)).join(gone, ["_k1", "_k2"], "left")
    some = F.col("_gone").isNotNull()
    cells = [F.when(some, rest(F.when(some, F.col(text)), "_gone")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*cells)
