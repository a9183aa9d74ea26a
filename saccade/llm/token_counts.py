"""Token counts per document (map-side, two tiers of lookup).

A text falls apart into pre-tokens that the tokenizer never merges across, so its token count is the
sum of its pre-tokens' counts. Tier one is a compact hash table of frequent pre-tokens' counts that is
broadcast to all tasks: the words that the tokenizer has a piece of its own for, which are those that
were frequent where it was made. Tier two encodes what the table misses and keeps it in a cache of the
worker. Nothing is shuffled, and the corpus is read once. Both tiers only decide speed, never results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import private_names, without
from saccade.llm.hashing import Places, numbers, run_hashes

#: Places of the broadcast table (4.5 MB with its counts) and of a worker's cache, and the longest pre-tokens cached.
TABLE, CACHE, LONGEST = 1 << 19, 1 << 20, 48
#: Characters of text that a task takes apart at once.
PIECE = 500_000
#: The library's mark for a space, which counts as one inside a text.
MARK = "▁"

_models: dict = {}
_caches: dict = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inside = re.compile(f"[^{MARK}]{MARK}")
        if any(inside.search(model.id_to_piece(i)) for i in range(model.vocab_size())):
            raise ValueError(f"{path} has pieces that span words; its texts can't be counted in parts")
        _models[path] = model
    return _models[path]


def units(texts: list[str], letters: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of texts that aren't empty: each is one or more spaces and what follows up to the next
    space; the first space is the one that the library puts before every text. Returns all texts as one,
    the pre-tokens' first and last characters in it, their hashes, and how many there are before each text."""
    marked = [" " + t.replace(MARK, " ") for t in texts]
    whole = "".join(marked)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "u4")
    begins = np.cumsum([0, *map(len, marked)])[:-1]
    space = codes == ord(" ")
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[begins] = True
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(codes)) - 1
    return whole, first, last, run_hashes(letters[codes], first, last), np.searchsorted(first, begins)


def _lengths(model, found: list[str]) -> list[int]:
    ids = model.encode([u[1:] for u in found], out_type=int, num_threads=1)
    return [len(x) if u != " " else 1 for u, x in zip(found, ids, strict=True)]  # alone, the library drops a lone mark


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def frequent_table(model_path: str) -> tuple[bytes, bytes]:
    """The table of tier one: hashes and token counts of the tokenizer's own words, by their places. Its
    size is fixed; words that meet in a place leave it to one of them."""
    model, table = _model(model_path), Places(TABLE, "u1")
    pieces = [p[1:] for p in map(model.id_to_piece, range(model.vocab_size())) if re.fullmatch(f"{MARK}[^{MARK}]+", p)]
    if pieces:
        *_, h, _ = units(pieces, numbers(0x110000))
        table.put(h, np.array(_lengths(model, [f" {p}" for p in pieces])).clip(max=255))
    return table.keys.tobytes(), table.values.tobytes()


class Counter:
    """Counts through the broadcast table and the worker's cache."""

    def __init__(self, model_path: str, table: tuple[bytes, bytes]):
        self.model, self.letters = _model(model_path), numbers(0x110000)
        self.cache, self.table = Places(CACHE, "i4"), Places(1, "u1")
        if table[0]:
            self.table.keys, self.table.values = np.frombuffer(table[0], "u8"), np.frombuffer(table[1], "u1")
            self.table.mask = np.uint64(len(table[1]) - 1)

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), "i8")
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        whole, first, last, h, begins = units([texts[i] for i in some], self.letters)
        known, n = self.table.find(h)
        n = n.astype("i8")
        rest = np.flatnonzero(~known)
        cached, m = self.cache.find(h[rest])
        n[rest] = m
        rest = rest[~cached]
        if len(rest):
            new, at, back = np.unique(h[rest], return_index=True, return_inverse=True)
            at = rest[at]
            found = np.array(_lengths(self.model, [whole[a : z + 1] for a, z in zip(first[at].tolist(), last[at].tolist(), strict=True)]))
            n[rest] = found[back]
            stay = last[at] - first[at] < LONGEST
            self.cache.put(new[stay], found[stay])
        out[some] = np.add.reduceat(n, begins)
        return out


@private_names
def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, table: tuple[bytes, bytes] | None = None, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    Null counts as the empty text, which has no tokens. Whole texts are counted, of any length, with
    no begin, end or special tokens; special strings inside a text are ordinary text, as the library
    has it. Repeated rows are counted each for itself; an empty table gives an empty table.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(model_path) if table is None else table)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, counts = shared.value
        key = (model_path, hash(keys))
        if key not in _caches:
            _caches.clear()
            _caches[key] = Counter(model_path, (keys, counts))
        for batch in batches:
            texts = batch.to_list()
            yield pd.Series(np.concatenate([np.zeros(0, "i8"), *(_caches[key].count(texts[a:b]) for a, b in _pieces(texts))]))

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("n_bytes", F.octet_length(whole).cast("long")).withColumn("n_tokens", n_tokens(whole)).withColumn("over_limit", F.col("n_tokens") > limit)
