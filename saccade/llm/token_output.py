"""Token ids as Parquet list columns, written in document order and read back selectively.

File format: a folder of Parquet files, one per range of the order key, each sorted. Columns: the
document's columns asked for, ``part`` (number of the range), ``local_start`` (ids of the documents
before it in its part), ``n_tokens``, ``token_ids`` (list of 32-bit ids). Ids are dictionary encoded,
or delta encoded on request; row groups and pages have set sizes, and Parquet's page index lets a
reader take single documents, or the metadata columns alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saccade.llm.hashing import Places, numbers, run_hashes

#: Places of a worker's cache of pre-tokens, the most pre-tokens it keeps ids of, and the longest ones that it keeps.
PLACES, KEPT, LONGEST = 1 << 21, 1_000_000, 48
#: Characters that are taken apart at once, and pre-tokens that go to the library as one text.
CHUNK, TOGETHER = 500_000, 500
#: How the tokenizer's own rules take a normalised text apart (fixed values; checked against the file).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPACE, LETTER, DIGIT, SYMBOL, UNKNOWN = range(5)
#: Up to this code point texts are in normal form, and lower() is all that the normaliser does besides white space.
NARROW = 0x24F
OWN = ["part", "local_start", "n_tokens", "token_ids", "start"]

_encoders: dict = {}


class Kinds:
    """What each code point is to PRE_TOKEN, by the library's own tables: it takes apart each code point after a
    letter and after a symbol, when texts first have it."""

    def __init__(self, split: dict):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.table = np.full(0x110000, UNKNOWN, "u1")

    def of(self, codes: np.ndarray) -> np.ndarray:
        kind = self.table[codes]
        if (kind == UNKNOWN).any():
            new = np.unique(codes[kind == UNKNOWN])
            for a in range(0, len(new), 50_000):
                self._ask(new[a : a + 50_000])
            kind = self.table[codes]
        return kind

    def _ask(self, new: np.ndarray) -> None:
        found = {span for _, span in self.split.pre_tokenize_str("".join(f"a{chr(c)} !{chr(c)} " for c in new.tolist()))}
        for i, c in enumerate(new.tolist()):
            at = 6 * i
            alone = (at + 1, at + 2) in found
            self.table[c] = LETTER if (at, at + 2) in found else SYMBOL if (at + 3, at + 5) in found else DIGIT if alone else SPACE


def pre_tokens(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of a normalised text, of characters of these kinds, begin and end (their last characters)."""
    first = kind != SPACE
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    ahead = np.append(codes, [0, 0, 0]).astype("u4")
    quotes = np.flatnonzero(first & (codes == ord("'")))
    one, two = ahead[quotes + 1], ahead[quotes + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
    for at, n in ((quotes[short], 2), (quotes[long], 3)):
        first[at + 1] = False
        after = at[at + n < len(codes)] + n
        first[after] = kind[after] != SPACE
    last = kind != SPACE
    last[:-1] &= (kind[1:] == SPACE) | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last)


class Encoder:
    """Encodes texts through the library. Texts are taken apart as arrays; each pre-token goes to the
    library once, and is found again by its hash as long as the cache has it."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in rules["added_tokens"]) or "(?!)").search
        parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.apart = parts[0].get("pattern") == {"Regex": PRE_TOKEN} and [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
        self.wide = regex.compile(rf"[^\x00-{chr(NARROW)}]").search
        if self.apart:
            self.kinds, self.numbers = Kinds(parts[0]), numbers(0x110000)
            self.known = Places(PLACES, "i4")
            self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.begin, self.size, self.ids = np.zeros(1, "i8"), np.ones(1, "i8"), np.zeros(1, "u4")

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str]) -> int:
        """Encodes pre-tokens; returns the entry of the first one."""
        ids, sizes = [], []
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            whole = self.library.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            new = np.flatnonzero(np.diff(np.array(whole.word_ids, "i8"), prepend=-1))
            if len(new) == len(some):
                ids.append(np.array(whole.ids, "u4"))
                sizes.append(np.diff(np.append(new, len(whole.ids))))
            else:  # not taken apart as in its text: each alone
                each = self._library(some)
                ids += each
                sizes.append(np.array([len(x) for x in each]))
        entry, sizes = len(self.size), np.concatenate(sizes)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(sizes) - sizes)
        self.size, self.ids = np.append(self.size, sizes), np.concatenate([self.ids, *ids])
        return entry

    def _entries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of a normalised text begin, and the entry of each."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
        first, last = pre_tokens(codes, self.kinds.of(codes))
        h = run_hashes(self.numbers[codes], first, last)
        known, entry = self.known.find(h)
        missing = np.flatnonzero(~known)
        if len(missing):
            new, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[at]
            entry[missing] = self._add([text[a : z + 1] for a, z in zip(first[at].tolist(), last[at].tolist(), strict=True)]) + back
            stay = last[at] - first[at] < LONGEST
            self.known.put(new[stay], entry[at[stay]])
        return first, entry

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, one after another, and how many each text has."""
        if not texts:
            return np.empty(0, "u4"), np.empty(0, "i8")
        whole = [not self.apart or self.special(t) is not None for t in texts]
        if all(whole):
            each = [np.append(x, np.uint32(end_id)) for x in self._library(texts)]
            return np.concatenate(each), np.array([len(x) for x in each], "i8")
        if any(whole):  # those with special tokens go to the library as they are
            pairs = [self.encode([t], end_id) for t in texts]
            return np.concatenate([x for x, _ in pairs]), np.concatenate([n for _, n in pairs])
        if len(self.size) > KEPT:
            self.forget()
        plain = [t.lower() for t in texts]
        plain = [self.library.normalizer.normalize_str(t) if self.wide(p) else p for t, p in zip(texts, plain, strict=True)]
        first, entry = self._entries("\n".join(plain))
        ends = np.searchsorted(first, np.cumsum([len(p) + 1 for p in plain]) - 1)
        self.ids[0] = end_id
        entry = np.insert(entry, ends, 0)
        size = self.size[entry]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[entry] - upto + size, size) + np.arange(upto[-1])]
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _chunks(texts: list[str], most: int = CHUNK) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, order: list[str] | None = None, keep: list[str] | None = None, text: str = "text", encoding: str = "dictionary", row_group_bytes: int = 64 << 20, page_bytes: int = 1 << 20, page_rows: int = 20_000) -> None:
    """Encodes every whole text, appends end_id, and writes the files in ascending order of ``order``
    (columns; doc_id if none is given), nulls first; ties go by the text's hash, then by the text.
    keep: columns to store beside the ids, without those that have a name of the format's own (OWN).

    A null or empty text's ids are the end id alone. Very long texts are one list. Repeated rows are
    written each for itself. An empty table makes a file without rows, so that its columns are known.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in OWN]
    by = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order or ["doc_id"]))]
    rows = docs.select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or ["doc_id"])],
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.struct(*[F.col(c) for c in keep]).alias("_kept"),
    ).withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(*by, F.col("_tie")).sortWithinPartitions(*by, "_tie", "_text").select("_kept", "_text", F.spark_partition_id().alias("part"))

    names = [f"_kept.{c}" for c in keep]
    rows = rows.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "part", "_text")
    made = T.StructType([*rows.drop("_text").schema.fields, T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = encoder(tokenizer), 0
        for batch in batches:
            kept, at = batch.columns[:-1], 0
            for some in _chunks(batch.column(batch.num_columns - 1).to_pylist()):
                found, sizes = own.encode(some, end_id)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found.view("i4")))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in kept), pa.array(done + ends - sizes), pa.array(sizes), ids], names=[*keep, "part", "local_start", "n_tokens", "token_ids"])
                at, done = at + len(some), done + int(ends[-1])

    encoded = rows.mapInArrow(encode, made)
    writer = encoded.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    else:
        writer = writer.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The stored rows with ``start``: the ids of all documents before it, over all parts. Asking for
    metadata columns alone leaves the list column unread. The table of the parts' sums has a row a
    file, which bounds what is broadcast."""
    rows = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    offsets = sums.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    wanted = columns or [c for c in rows.columns if c not in ("part", "local_start")]
    return rows.join(F.broadcast(offsets), "part").select(*wanted, (F.col("_offset") + F.col("local_start")).alias("start"))


@F.pandas_udf(T.LongType())
def ids_crc32(batch: pd.Series) -> pd.Series:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in batch], dtype="int64")
