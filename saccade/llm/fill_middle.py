"""Fill-in-middle: texts cut in three at units, with the middle moved to the end.

Units are counted once over the UTF-8 bytes, and every so many of them the count, the byte offset and the
code-point offset are kept: a sparse index of checkpoints, some thousandths of the text. A cut is drawn
when the count is known; a binary search finds the last checkpoint before it, and only the few units
between the two are scanned again. So no list of a text's units is ever held.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saccade.llm.common import private_names, without

#: A unit: a word with the white space before it, or white space at the text's end.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Units from one checkpoint to the next, bytes that are counted at a time, bytes of texts given on at a time.
EVERY, BLOCK, BATCH = 256, 1 << 20, 1 << 24
MARKS = ("<P>", "<S>", "<M>")
NEW = T.StructType([T.StructField(c, k) for c, k in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))])


class Checkpoints:
    """Counts of units, bytes and code points at the ends of every so many units of a text; n: all its units."""

    def __init__(self, data: bytes, every: int = EVERY, block: int = BLOCK):
        self.data, self.n = data, 0
        units, ends, chars = [np.zeros(1, "i8")], [np.zeros(1, "i8")], [np.zeros(1, "i8")]
        a, before = np.frombuffer(data, "u1"), 0
        for lo in range(0, len(a), block):
            part = a[lo : lo + block + 1]
            space = SPACE[part] if len(part) > block else np.append(SPACE[part], True)  # the text's end ends a word
            over = np.flatnonzero(~space[:-1] & space[1:]) + 1
            number = self.n + np.arange(1, len(over) + 1)
            kept = over[number % every == 0]
            seen = np.cumsum((part[:block] & 0xC0) != 0x80)
            units.append(number[number % every == 0])
            ends.append(lo + kept)
            chars.append(before + seen[kept - 1])
            self.n, before = self.n + len(over), before + int(seen[-1])
        self.n += bool(len(a)) and bool(SPACE[a[-1]])
        self.units, self.bytes, self.chars = (np.concatenate(x) for x in (units, ends, chars))

    def find(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) of the text's first units, as many as are asked for."""
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        begin = end = int(self.bytes[i])
        for m in itertools.islice(UNIT.finditer(self.data, begin), unit - int(self.units[i])):
            end = m.end()
        return end, int(self.chars[i]) + len(self.data[begin:end].decode())


def draws(seed: int, key: int | None) -> list[int]:
    """Four 32-bit numbers for a document: the first 8-digit groups of a sha256 in hexadecimal."""
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again: none is empty, in another, or begins as another one (or it itself) ends."""
    for (i, x), (j, y) in itertools.product(enumerate(marks), repeat=2):
        if not x or (i != j and x in y) or any(x[k:] == y[: len(x) - k] for k in range(1, len(x))):
            raise ValueError("marks must be distinct and must not overlap each other or themselves")
    return marks


def _moved(key: int | None, text: str | None, seed: int, rate: int, spm: int, marks: tuple[str, str, str], every: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text"""
    data = (text or "").encode()
    index = Checkpoints(data, every)
    h1, h2, h3, h4 = draws(seed, key)
    if not data or any(m in text for m in marks) or h3 % 100 >= rate:
        return index.n, "plain", None, None, text or ""
    one, two = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.find(one), index.find(two)
    prefix, middle, suffix = (x.decode() for x in (data[:a], data[a:b], data[b:]))
    p, s, m = marks
    if h4 % 100 < spm:
        form, output = "spm", f"{s}{suffix}{p}{prefix}{m}{middle}"
    else:
        form, output = "psm", f"{p}{prefix}{s}{suffix}{m}{middle}"
    return index.n, form, a_chars, b_chars - a_chars, output


@private_names
def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS, every: int = EVERY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and
    output. rate percent of the texts are cut, spm percent of those give the suffix first; both, and the two
    cuts, come from a hash of seed and key, so a document is cut alike in every run and partitioning.

    Null and empty texts are plain with an empty output, and so are texts that contain a mark, with the
    text itself; a null key is hashed as ``null``; rows with equal keys get equal draws, repeated rows
    equal results. Very long texts take their own size and an index. Columns of docs that are named like
    the new ones are replaced; others stay. An empty table gives no rows.
    """
    marks = _checked(marks)
    rows = without(docs, *NEW.names)
    names = rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            keys, texts = batch.column(len(names)), batch.column(len(names) + 1)
            begin, size, made = 0, 0, []
            for i in range(len(batch)):
                made.append(_moved(keys[i].as_py(), texts[i].as_py(), seed, rate, spm, marks, every))
                size += len(made[-1][4])
                if size > BATCH or i + 1 == len(batch):
                    cells = [pa.array([r[c] for r in made], kind) for c, kind in enumerate(kinds)]
                    own = batch.slice(begin, len(made)).columns[: len(names)]
                    yield pa.RecordBatch.from_arrays([*own, *cells], names=[*names, *NEW.names])
                    begin, size, made = i + 1, 0, []

    given = rows.select(*names, docs[key].cast("long").alias("_key"), docs[text].alias("_text"))
    return given.mapInArrow(cut, T.StructType([*rows.schema.fields, *NEW.fields]))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was cut, from output and form alone."""
    p, s, m = _checked(marks)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        i, j = F.position(F.lit(second), output), F.position(F.lit(m), output)
        return F.substring(output, F.lit(len(first) + 1), i - 1 - len(first)), F.substring(output, i + len(second), j - i - len(second)), F.substring(output, j + len(m), F.length(output))

    (a, b, c), (x, y, z) = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(y, z, x)).otherwise(output)
