"""Passages of a given length that start anywhere else too, by suffix sorting in shards.

Windows (strings of the length) are dealt to shards by content: a window's key is the least hash of its
32-byte grams, so that equal windows have equal keys, wherever they stand. Neighbouring windows mostly
share their key; a run of them is one piece of text. Keys that only one short piece has need no sorting, and
pieces that occur twice as a whole are repeated as a whole. Of the rest one of each kind is sent to its
key's shard. There the suffixes are sorted by external induced sorting (induced_sort), which carries
common prefixes along: windows whose suffix shares the length with a neighbour are repeated. A key with
too much text for a shard gets its windows dealt again by another hash, so no key gathers in one task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import discard, private_names, row_key, shared_dir, stored, without
from saccade.llm.hashing import M1, M2, numbers
from saccade.llm.induced_sort import scan_suffixes

#: Bytes of a gram; windows of a text that are looked at at a time; bytes of text in a shard; hashes that a key is split by.
GRAM, SEGMENT, SHARD_BYTES, HASHES = 32, 1 << 22, 1 << 21, 4
#: Stands between pieces in a shard's text: no byte of UTF-8 after one has been added to each.
BETWEEN = 0xF6
GEAR = numbers(256)
ID = ["_k1", "_k2"]
PIECE = "_k1 long, _k2 long, start int, size int, least long, digest long, twice boolean"


def pieces_of(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool], list[tuple[int, int]]]:
    """(first windows, bytes, keys) of the pieces of a text, whether each has its gram twice and so may repeat
    itself, and stretches that repeat for sure: runs of one byte beyond the length. Of those only the
    windows at both ends are in pieces."""
    if len(data) < length:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u8"), [], []
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    h = (h[GRAM - 1 :] ^ (np.uint64(seed) * M2)) * M1
    h ^= h >> np.uint64(32)
    w, n = length - GRAM + 1, len(data) - length + 1
    rows = np.append(h, np.full(-len(h) % w, np.iinfo("u8").max, "u8")).reshape(-1, w)
    ahead, behind = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    new = np.append(True, least[1:] != least[:-1])
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]) + 1, len(data))
    begins = np.append(0, ends[:-1])
    long_ = np.flatnonzero(ends - begins > length)
    inside, sure = np.zeros(n, bool) if len(long_) else None, []
    for a, b in zip(begins[long_].tolist(), ends[long_].tolist(), strict=True):
        inside[a + 1 : b - length] = True
        new[[a + 1, b - length]] = True
        sure.append((a, b - a))
    first = np.flatnonzero(new)
    size = np.append(first[1:], n) - first + length - 1
    if inside is not None:
        kept = ~inside[first]
        first, size = first[kept], size[kept]
    twice = [np.count_nonzero(h[a : a + s - GRAM + 1] == v) > 1 for a, s, v in zip(first.tolist(), size.tolist(), least[first], strict=True)]
    return first, size, least[first], twice, sure


def pieces(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """PIECE of each text (_k1, _k2, _text); rows without a key are stretches that repeat for sure."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            rows, cells, n = [], [[], [], [], [], []], 0
            for i, text in enumerate(batch.column(2)):
                data = memoryview(text.as_buffer()) if text.is_valid else b""
                for lo in range(0, max(len(data) - length + 1, 0), SEGMENT):
                    part = data[lo : lo + SEGMENT + length - 1]
                    first, size, least, twice, sure = pieces_of(np.frombuffer(part, "u1"), length, seed)
                    digests = [xxhash.xxh3_64_intdigest(part[a : a + s]) for a, s in zip(first.tolist(), size.tolist(), strict=True)]
                    stretch = np.array(sure, "i8").reshape(-1, 2)
                    none = [None] * len(sure)
                    made = len(first) + len(sure)
                    rows.append(np.full(made, i))
                    for cell, x in zip(cells, (pa.array(np.append(first, stretch[:, 0]) + lo, pa.int32()), pa.array(np.append(size, stretch[:, 1]), pa.int32()), pa.array([*least.view("i8").tolist(), *none], pa.int64()), pa.array([*np.array(digests, "u8").view("i8").tolist(), *none], pa.int64()), pa.array([*twice, *none], pa.bool_())), strict=True):
                        cell.append(x)
                    n += made
                if n and (n > 100_000 or i + 1 == len(batch)):
                    at = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), *(pa.concat_arrays(c) for c in cells)], names=names)
                    rows, cells, n = [], [[], [], [], [], []], 0

    return texts.select(*ID, "_text").mapInArrow(take, PIECE)


def sized_filter(keys: DataFrame, path: str) -> DataFrame:
    """(_place, _mask): a Bloom filter of the one column of 64-bit keys with 16 bits a key, up to a million rows; for flagged()."""
    n = keys.count()
    places = 1 << min(20, max(10, (16 * n // 64).bit_length()))
    bit = F.expr(f"shiftleft(1L, cast({keys.columns[0]} & 63 as int))")
    bits = keys.select(F.pmod(F.shiftright(keys.columns[0], 6), F.lit(places)).alias("_place"), bit.alias("_bit"))
    return stored(bits.groupBy("_place").agg(F.bit_or("_bit").alias("_mask"), F.lit(places).alias("_places")), path)


def flagged(rows: DataFrame, key: str, bloom: DataFrame, places: int) -> DataFrame:
    """rows with _hit: false if the filter doesn't have the key for sure."""
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    hit = F.coalesce(bit.bitwiseAND(F.col("_mask")) != 0, F.lit(False))
    place = rows.withColumn("_place", F.pmod(F.shiftright(key, 6), F.lit(places)))
    return place.join(F.broadcast(bloom.select("_place", "_mask")), "_place", "left").select(*rows.columns, hit.alias("_hit"))


def _hits(rows: DataFrame, key: str, keys: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in keys or, rarely, isn't; the others)"""
    bloom = sized_filter(keys, path)
    places = (bloom.agg(F.max("_places")).first()[0]) or 1
    all_ = flagged(rows, key, bloom, places)
    return all_.where("_hit").drop("_hit"), all_.where("not _hit").drop("_hit")


class Shard:
    """Pieces of one shard: their text on disk, and where each begins."""

    def __init__(self):
        self.file, self.places, self.rows, self.at = tempfile.TemporaryFile(), [], [], 0  # noqa: SIM115

    def add(self, batch: pa.RecordBatch) -> None:
        for piece in batch.column(5):
            own = np.frombuffer(piece.as_buffer(), "u1") + np.uint8(1)
            self.file.write(own.tobytes() + bytes([BETWEEN]))
            self.places.append((self.at, len(own)))
            self.at += len(own) + 1
        self.rows.append(batch.select([1, 2, 3, 4]))

    def repeats(self, length: int) -> pa.RecordBatch:
        """(_k1, _k2, start, size): the repeated stretches in the pieces that occur once."""
        self.file.write(b"\0")
        self.file.flush()
        again, last = np.zeros(self.at + 1, bool), np.zeros(1, "i8")

        def mark(pos: np.ndarray, common: np.ndarray) -> None:
            same = common >= length
            again[pos[same]] = True
            again[np.append(last, pos[:-1])[same]] = True
            last[0] = pos[-1]

        scan_suffixes(np.memmap(self.file, "u1", "r"), 256, length, mark)
        self.file.close()
        table = pa.Table.from_batches(self.rows)
        k1, k2, start, only = (table.column(i).to_numpy() for i in range(4))
        out = []
        for i in np.flatnonzero(only).tolist():
            at, size = self.places[i]
            own = np.flatnonzero(np.diff(again[at : at + size - length + 1].view("i1"), prepend=0, append=0))
            out += [(k1[i], k2[i], int(start[i]) + a, b - a + length - 1) for a, b in zip(own[::2].tolist(), own[1::2].tolist(), strict=True)]
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=[*ID, "start", "size"])


def _sorted(texts: DataFrame, length: int, shards: int) -> DataFrame:
    """(_k1, _k2, start, size): the repeated stretches in the pieces (least, _k1, _k2, start, only, _piece). A task takes
    its shards one after another."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for batch in batches:
            numbers_ = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(numbers_[1:] != numbers_[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if shard is not None and numbers_[a] != number:
                    yield shard.repeats(length)
                    shard = None
                shard, number = shard or Shard(), numbers_[a]
                shard.add(batch.slice(a, b - a))
        if shard is not None:
            yield shard.repeats(length)

    number = F.pmod(F.xxhash64("least"), F.lit(shards)).alias("_shard")
    dealt = texts.select(number, *ID, "start", "only", "_piece").repartition("_shard").sortWithinPartitions("_shard")
    return dealt.mapInArrow(take, "_k1 long, _k2 long, start int, size int")


def _cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (_k1, _k2, start, size, least, digest, only) with _piece, the bytes themselves."""
    cells = ["start", "size", "least", "digest", "only"]
    lists = wanted.groupBy(*ID).agg(F.collect_list(F.struct(*cells)).alias("_wanted"))  # of one text

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = batch.column(3)[i].values
                data = memoryview(batch.column(2)[i].as_buffer())
                parts = [data[a : a + s] for a, s in zip(own.field("start").to_pylist(), own.field("size").to_pylist(), strict=True)]
                same = [pa.repeat(batch.column(c)[i], len(own)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, *(own.field(c) for c in cells), pa.array(parts, pa.binary())], names=[*ID, *cells, "_piece"])

    schema = "_k1 long, _k2 long, start int, size int, least long, digest long, only boolean, _piece binary"
    return texts.select(*ID, "_text").dropDuplicates(ID).join(lists, ID).select(*ID, "_text", "_wanted").mapInArrow(take, schema)


def repeated(texts: DataFrame, length: int, base: str, shard_bytes: int = SHARD_BYTES, seed: int = 0) -> DataFrame:
    """(_k1, _k2, start, size): stretches that cover all windows of texts (_k1, _k2, _text) which start elsewhere too."""
    spark = texts.sparkSession
    all_ = stored(pieces(texts, length, seed), f"{base}/pieces")
    sure = all_.where("least IS NULL").select(*ID, "start", "size")
    counts = all_.where("least IS NOT NULL").groupBy("least").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    keys = stored(counts.where("n > 1 or twice").select("least"), f"{base}/keys")
    near, _ = _hits(all_.where("least IS NOT NULL"), "least", keys, f"{base}/filter")
    again = stored(near.join(keys, "least", "left_semi"), f"{base}/again")

    place = F.min(F.struct(*ID, "start", "size"))
    kinds = again.groupBy("least", "digest").agg(F.count("*").alias("copies"), place.alias("one"), F.max("twice").alias("twice"))
    kinds = stored(kinds.select("least", "digest", "one.*", "twice", (F.col("copies") == 1).alias("only")), f"{base}/kinds")
    whole = again.join(kinds.where("not only").select("least", "digest"), ["least", "digest"], "left_semi").select(*ID, "start", "size")
    mixed = kinds.groupBy("least").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("twice").alias("twice")).where("n > 1 or twice")
    mixed = stored(mixed.select("least", (F.col("bytes") > shard_bytes).alias("heavy"), "bytes"), f"{base}/mixed")
    light, heavy = mixed.agg(F.sum(F.when(F.col("heavy"), 0).otherwise(F.col("bytes"))), F.count_if("heavy")).first()
    if seed + 1 == HASHES:  # sorted on disk, however much it is
        light, heavy = mixed.agg(F.sum("bytes")).first()[0], 0
    out = sure.unionByName(whole)
    wanted = kinds.join(mixed.select("least", "heavy"), "least")
    if light or heavy:
        ids = stored(wanted.select("_k1").distinct(), f"{base}/wanted")
        holders, _ = _hits(texts, "_k1", ids, f"{base}/holders")
    if light:
        few = wanted.where("not heavy" if heavy else "true").drop("heavy")
        found = _sorted(_cut_out(holders, few), length, -(-light // shard_bytes))
        out = out.unionByName(stored(found, f"{base}/found"))
    if heavy:
        many = stored(wanted.where("heavy").drop("heavy"), f"{base}/heavy")
        few_texts, _ = _hits(holders, "_k1", many.select("_k1").distinct(), f"{base}/few")  # most texts have none of them
        own = _cut_out(few_texts, many).select(F.col("least").alias("_k1"), F.col("digest").alias("_k2"), F.col("_piece").alias("_text"))
        inner = repeated(stored(own, f"{base}/own"), length, f"{base}/{seed + 1}", shard_bytes, seed + 1)  # read twice there
        inner = inner.select(F.col("_k1").alias("least"), F.col("_k2").alias("digest"), F.col("start").alias("_at"), F.col("size").alias("_n"))
        back = many.where("only").join(inner, ["least", "digest"])
        out = out.unionByName(back.select(*ID, (F.col("start") + F.col("_at")).alias("start"), F.col("_n").alias("size")))
    out = stored(out, f"{base}/out")
    for table in ("pieces", "again", "kinds", "found", "own"):
        discard(spark, f"{base}/{table}")
    return out


def _rest(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    rows = []
    for data, spans in zip(texts, places, strict=True):
        own = sorted((s["start"], s["start"] + s["size"]) for s in spans)
        kept, at, n = [], 0, 0
        end = -1
        for a, b in own:
            if a > end:
                n += 1
                kept.append(data[max(end, 0) : a])
            end = max(end, b)
            at = end
        kept.append(data[at:])
        left = b"".join(kept)
        rows.append((len(data) - len(left), n, left))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


@private_names
def drop_repeated(docs: DataFrame, length: int = 400, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_bytes (of the UTF-8 text), n_removed, n_spans (maximal removed runs) and kept (binary: the other
    bytes; characters may be cut). A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same document too; all strings are judged on the input.

    length is more than twice a gram of 32 bytes. Null texts count as empty ones; texts shorter than length
    keep all bytes. Rows count as documents each, so repeated rows and equal texts lose all they have from
    length bytes on. Very long texts are looked at in segments. Columns named like the new ones are
    replaced; others stay, whatever their names. An empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    base = shared_dir(docs.sparkSession)
    keyed = docs.select("*", *row_key(*docs.columns), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_text"))
    spans = repeated(keyed.select(*ID, "_text"), length, base, shard_bytes)
    lists = spans.distinct().groupBy(*ID).agg(F.collect_list(F.struct("start", "size")).alias("_spans"))  # of one text
    lists = stored(lists, f"{base}/spans")
    some, others = _hits(keyed, "_k1", lists.select("_k1"), f"{base}/cut")
    cut = F.pandas_udf(_rest, "n_removed long, n_spans long, kept binary")
    none = F.array().cast("array<struct<start:int,size:int>>")
    some = some.join(lists, ID, "left").withColumn("_new", cut("_text", F.coalesce("_spans", none)))
    own = without(docs, "n_bytes", "n_removed", "n_spans", "kept").columns
    n_bytes = F.octet_length("_text").cast("long").alias("n_bytes")
    some = some.select(*own, n_bytes, "_new.n_removed", "_new.n_spans", "_new.kept")
    zero = F.lit(0).cast("long")
    return some.unionByName(others.select(*own, n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), F.col("_text").alias("kept")))
