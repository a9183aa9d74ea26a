"""Jaccard self-join of documents on word n-grams, by token-combination prefixes, and its components.

A document is its set of n-word shingles (64-bit hashes). Equal sets are one node from the start. The
tokens of the join are the shingles, in a global order of classes by the number of nodes that have
them: those of one node alone first, which can match nothing and are never indexed, then rare ones,
then frequent ones. If two sets reach the threshold, all but t of a set's shingles are in the other
one, t = size - ceil(threshold * size). A node with more than t shingles of its own is alone. All
others get a prefix in that order: rare shingles are indexed singly, frequent ones in pairs, and pairs
are only formed inside the parts that a hash deals frequent shingles to. A pair needs one shingle of
its part besides the first, so a prefix with n_j frequent shingles in part j and n others still meets
every partner in a signature if n + sum(n_j - 1) > t: prefixes are extended until it holds. The number
of parts goes by the power of two of the sizes; a set near the border of two such levels is indexed
for both.

Which nodes have a shingle is found by an inverted index: tasks deal (shingle, node) postings to parts
of the hash space as packed arrays, each part finds the shingles of several nodes, and their postings
go back to the parts of the nodes. Parts hold about as much each at any size of the input; shingles
that very many documents have don't meet in one part, since their class is known beforehand.

Signatures that nodes share give candidates. Where a shared signature stands in a set's order bounds
the sizes that partners may have. Each node is compared with one hub of each of its signatures, the
one with the fewest shingles of its own; the links found are joined to components. Where a signature's
nodes still lie in several components, pairs across them that the bounds admit are compared as well, so
that no link that could change a component is missed; pairs inside one component need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import SPACES, discard, private_names, row_key, shared_dir, stored
from saccade.llm.hashing import M1, mixed, numbers, run_hashes

#: Bytes of text whose postings make a part, bytes of text that are hashed at once, shingles sent at once.
PART_BYTES, CHUNK, SENT = 16 << 20, 1 << 19, 500_000
#: Shingles in so large a share of all documents go by a table of at most HEAVY entries (128 kB).
HEAVY_SHARE, HEAVY = 1 / 256, 16_384
#: Nodes that a task remembers so as to send copies once; beyond that it forgets them all.
REMEMBERED = 200_000
#: From so many nodes on a shingle is frequent. Classes are quarters of powers of two.
FREQUENT = 64
NODE = ["n1", "n2"]


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each byte, A-Z as a-z, and which bytes are white space."""
    low = np.arange(256, dtype="u1")
    low[ord("A") : ord("Z") + 1] += 32
    return numbers(256)[low], np.isin(np.arange(256), list(SPACES.encode()))


LETTERS, BLANK = _alphabet()


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in data, and the number of words before
    each text's end. ends: the texts' ends."""
    size = len(data)
    word = ~BLANK[data]
    edge = np.zeros(size + 1, bool)
    edge[ends] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    return run_hashes(LETTERS[data], a, z), np.searchsorted(a, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of shingle hashes, each sorted, one after another, and where each begins and ends."""
    w, upto = word_hashes(data, ends) if len(data) else (np.empty(0, "u8"), np.zeros(len(ends), "i8"))
    before = np.append(0, upto[:-1])
    words = upto - before
    h = np.full(max(0, len(w) - n + 1), np.uint64(n))
    for i in range(n):
        h = mixed((h + w[i : len(w) - n + 1 + i]) * M1)
    many = np.maximum(words - n + 1, np.minimum(words, 1))
    bounds = np.append(0, np.cumsum(many))
    at = np.repeat(before - bounds[:-1], many) + np.arange(bounds[-1])
    out = h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else np.zeros(bounds[-1], "u8")
    for d in np.flatnonzero((words > 0) & (words < n)):
        one = np.full(1, np.uint64(words[d]))
        for i in range(before[d], upto[d]):
            one = mixed((one + w[i : i + 1]) * M1)
        out[bounds[d]] = one[0]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a > 1:
            out[a:z].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][many > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[bounds]


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, sets, bounds) for some texts at a time; null counts as empty."""
    whole = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], "i8")[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", "u1")
    a = 0
    while a < len(whole):
        z = min(len(whole), max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1))
        yield a, *shingle_sets(data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a], n)
        a = z


def names_of(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that name each set: 64 and 32 of them."""
    import xxhash

    each = b"".join(xxhash.xxh3_128_digest(sets[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    both = np.frombuffer(each, "u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].astype("u4")


def most_missing(size: int, percent: int) -> int:
    """How many of size shingles a partner may lack."""
    return size - -(-size * percent // 100)


def parts_of(level: int, percent: int) -> int:
    return most_missing(1 << level, percent) + 1


def class_of(nodes: np.ndarray) -> np.ndarray:
    """Classes of shingles by the number of nodes that have them."""
    return np.minimum(254, np.floor(4 * np.log2(nodes))).astype("u1")


def signatures(h: np.ndarray, classes: np.ndarray, own: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's 64-bit signatures, and the least number of its shingles that no partner found by each can
    have. h: the shingles that other nodes have too, in the global order; own: how many others there are."""
    size = own + len(h)
    frequent = classes >= class_of(np.array([FREQUENT]))[0]
    rare = int(len(h) - np.count_nonzero(frequent))
    t, single, out, bound = most_missing(size, percent), 0, [], []
    least, most = -(-size * percent // 100), size * 100 // percent
    if own + rare > t:  # enough without frequent ones
        single = t + 1 - own
    else:
        single = rare
        for level in range(least.bit_length() - 1, most.bit_length()):
            parts = parts_of(level, percent)
            some = h[rare : rare + max(0, t + 1 + parts - own - rare)]
            part = (some >> np.uint64(20)) % np.uint64(parts)
            _, first = np.unique(part, return_index=True)
            gain = np.ones(len(some), "i8")
            gain[first] = 0
            enough = np.flatnonzero(own + rare + np.cumsum(gain) > t)
            taken = int(enough[0]) + 1 if len(enough) else len(some)
            some, part = some[:taken], part[:taken]
            by = np.lexsort((some, part))
            f, p = some[by], part[by]
            starts = _runs(p)
            for a, k in zip(starts, _lengths(starts, len(p)), strict=True):
                if k > 1:
                    i, j = np.triu_indices(k, 1)
                    out.append(mixed(mixed(f[a + i] * M1 + f[a + j]) + np.uint64(level)))
                    bound.append(np.full(len(i), own + rare))
    out.append(mixed(h[:single] + np.uint64(1 << 40)))
    bound.append(own + np.arange(single))
    found, at = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate(bound)[at]


def _cells(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """data[bounds[i]:bounds[i + 1]] as one binary value each."""
    data = np.ascontiguousarray(data)
    offsets = (bounds * data.itemsize).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _gathered(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The binary columns of all rows, each as one array."""
    found: dict[str, list[bytes]] = {c: [] for c in kinds}
    for batch in batches:
        for c in kinds:
            found[c] += batch.column(batch.schema.get_field_index(c)).to_pylist()
    return {c: np.frombuffer(b"".join(x for x in cells if x), kinds[c]) for c, cells in found.items()}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, "i8")
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(starts, end)) if len(starts) else np.empty(0, "i8")


def _dealt(part: np.ndarray, n1: np.ndarray, n2: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Cells for each part of postings that are sorted by part and node: runs of nodes, and the columns."""
    runs = _runs(part, n1, n2)
    pieces = -(-_lengths(runs, len(part)) // 255)  # lengths are bytes
    runs = np.repeat(runs, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    parts = part[runs]
    heads = _runs(parts)
    inner = np.append(heads, len(runs))
    outer = np.append(runs[heads], len(part))
    cells = {"n1": _cells(n1[runs], inner), "n2": _cells(n2[runs], inner), "runs": _cells(_lengths(runs, len(part)).astype("u1"), inner)}
    return parts[heads], cells | {c: _cells(x, outer) for c, x in columns.items()}


SENT_KINDS = {"n1": "u8", "n2": "u4", "runs": "u1", "lo": "u4", "hi": "u2"}
BACK_KINDS = {"n1": "u8", "n2": "u4", "runs": "u1", "tokens": "u8", "classes": "u1"}
SENT_ROW = "part int, n1 binary, n2 binary, runs binary, lo binary, hi binary, tokens binary, classes binary, sizes binary"
BACK_ROW = "part int, n1 binary, n2 binary, runs binary, tokens binary, classes binary, sizes binary"


def _rows(schema: str, part: np.ndarray, cells: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = [pa.array(part.astype("i4")) if c == "part" else cells.get(c, pa.nulls(len(part), pa.binary())) for c in names]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _node_part(n1: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(n1) % np.uint64(parts)).astype("i4")


def _token(part: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A shingle as all tasks name it: 48 bits of its hash and 16 of its part, mixed."""
    return mixed(((part.astype("u8") & np.uint64(0xFFFF)) << np.uint64(48) | low) * M1)


def _found(docs: DataFrame, n: int, path: str) -> DataFrame:
    """A row for each document (_id, _k1, _k2, _size, n1, n2), and rows (token, seen) of shingles that
    very many documents of some batch have."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_k1", "_k2", "_size", "n1", "n2", "token", "seen"]
        kinds = [*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        waiting: dict[tuple[int, int], np.ndarray] = {}

        def heavy() -> pa.RecordBatch:
            every = np.concatenate([*waiting.values()]) if len(waiting) >= 512 else np.empty(0, "u8")
            values, counts = np.unique(every, return_counts=True)
            some = counts >= max(8, 4 * HEAVY_SHARE * len(waiting))
            waiting.clear()
            k = int(some.sum())
            return pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds[:6]), pa.array(values[some].view("i8")), pa.array(counts[some])], names=names)

        held = 0
        for batch in batches:
            sizes, a, b = [], [], []
            for _, sets, bounds in sets_of(batch.column(3), n):
                n1, n2 = names_of(sets, bounds)
                sizes.append(np.diff(bounds))
                a.append(n1)
                b.append(n2)
                for x, y, i, j in zip(n1.tolist(), n2.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if (x, y) not in waiting:
                        waiting[x, y] = sets[i:j]
                        held += j - i
                if held > SENT:
                    yield heavy()
                    held = 0
            if sizes:
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sizes).astype("i4")), pa.array(np.concatenate(a).view("i8")), pa.array(np.concatenate(b).view("i4")), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        yield heavy()

    made = "_id long, _k1 long, _k2 long, _size int, n1 long, n2 int, token long, seen long"
    return stored(docs.select("_id", "_k1", "_k2", "_text").mapInArrow(take, made), path)


def heavy_shingles(found: DataFrame) -> np.ndarray:
    """At most HEAVY shingles of those that more than HEAVY_SHARE of all documents have, sorted. They
    decide the work alone: whichever they are, the results are the same."""
    least = max(64, int(HEAVY_SHARE * found.where("_size > 0").count()))
    rows = found.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least)
    most = rows.orderBy(F.desc("seen"), "token").limit(HEAVY).select("token").collect()
    return np.sort(np.array([r.token for r in most], "i8").view("u8"))


def _postings(docs: DataFrame, n: int, parts: int, heavy) -> DataFrame:
    """What tasks send to parts: postings of shingles to the shingles' parts; sizes of nodes and postings
    of heavy shingles to the nodes' parts."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known = heavy.value, set()
        hit = np.zeros(1 << 20, bool)
        hit[(common & np.uint64((1 << 20) - 1)).astype("i8")] = True
        held: list[np.ndarray] = []
        n1s: list[int] = []
        n2s: list[int] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            tokens, sizes = np.concatenate(held), np.array([len(x) for x in held])
            n1, n2 = np.array(n1s, "u8"), np.array(n2s, "u4")
            part = _node_part(n1, parts)
            by = np.argsort(part, kind="stable")
            heads = _runs(part[by])
            bounds = np.append(heads, len(by))
            yield _rows(SENT_ROW, part[by][heads], {"n1": _cells(n1[by], bounds), "n2": _cells(n2[by], bounds), "sizes": _cells(sizes[by].astype("u4"), bounds)})
            node = np.repeat(np.arange(len(n1)), sizes)
            low, of = tokens & np.uint64((1 << 48) - 1), (mixed(tokens) % np.uint64(parts)).astype("i4")
            known_heavy = hit[(tokens & np.uint64((1 << 20) - 1)).astype("i8")]
            if known_heavy.any():
                at = np.flatnonzero(known_heavy)
                place = np.minimum(np.searchsorted(common, tokens[at]), len(common) - 1)
                known_heavy[at] = common[place] == tokens[at]
                at = np.flatnonzero(known_heavy)
                at = at[np.argsort(part[node[at]], kind="stable")]
                if len(at):
                    yield _rows(SENT_ROW, *_dealt(part[node[at]], n1[node[at]], n2[node[at]], {"tokens": _token(of[at], low[at]), "classes": np.full(len(at), 255, "u1")}))
                rest = np.flatnonzero(~known_heavy)
                node, low, of = node[rest], low[rest], of[rest]
            by = np.argsort(of, kind="stable")
            node, low, of = node[by], low[by], of[by]
            if len(of):
                yield _rows(SENT_ROW, *_dealt(of, n1[node], n2[node], {"lo": low.astype("u4"), "hi": (low >> np.uint64(32)).astype("u2")}))

        for batch in batches:
            for _, sets, bounds in sets_of(batch.column(0), n):
                for x, y, i, j in zip(*(v.tolist() for v in names_of(sets, bounds)), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if j > i and (x, y) not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known.add((x, y))
                        held.append(sets[i:j])
                        n1s.append(x)
                        n2s.append(y)
                        size += j - i
                if size > SENT:
                    yield from send()
                    held, n1s, n2s, size = [], [], [], 0
        if held:
            yield from send()

    return docs.select("_text").mapInArrow(take, SENT_ROW)


def _repeated(sent: DataFrame, parts: int) -> DataFrame:
    """What the shingles' parts send to the nodes' parts: postings of shingles that several nodes have."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {c: [] for c in SENT_KINDS}
        part: list[np.ndarray] = []
        for batch in batches:
            direct = pc.is_null(batch.column("lo"))
            through = batch.filter(direct)
            if through.num_rows:
                yield through.select([c.split()[0] for c in BACK_ROW.split(", ")])
            own = batch.filter(pc.invert(direct))
            for c in SENT_KINDS:
                found[c] += own.column(c).to_pylist()
            part.append(np.repeat(own.column("part").to_numpy(), [len(x) // 4 for x in own.column("lo").to_pylist()]))
        n1, n2, runs, lo, hi = (np.frombuffer(b"".join(found.pop(c)), k) for c, k in SENT_KINDS.items())
        if not len(lo):
            return
        tokens = _token(np.concatenate(part), hi.astype("u8") << np.uint64(32) | lo)
        del lo, hi, part
        by = np.argsort(tokens)
        same = tokens[by][1:] == tokens[by][:-1]
        some = by[np.append(same, False) | np.append(False, same)]
        node = np.repeat(np.arange(len(n1), dtype="i4"), runs)[some]
        tokens, n1, n2 = tokens[some], n1[node], n2[node]
        by = np.lexsort((n2, n1, tokens))
        by = by[_runs(tokens[by], n1[by], n2[by])]  # copies from several tasks
        starts = _runs(tokens[by])
        count = _lengths(starts, len(by))
        classes = np.repeat(class_of(count), count)
        some = np.repeat(count, count) > 1
        by, classes = by[some], classes[some]
        tokens, n1, n2 = tokens[by], n1[by], n2[by]
        back = _node_part(n1, parts)
        by = np.lexsort((n2, n1, back))
        if len(by):
            yield _rows(BACK_ROW, *_dealt(back[by], n1[by], n2[by], {"tokens": tokens[by], "classes": classes[by]}))

    return sent.repartitionById(parts, "part").mapInArrow(take, BACK_ROW)


def _candidates(back: DataFrame, parts: int, percent: int) -> DataFrame:
    """(n1, n2, size, own, tokens, classes) of the nodes that can have a partner: own is the number of
    shingles that no other node has, tokens are the others in the global order."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple[int, int], int] = {}

        def postings() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, c in zip(*(batch.column(k).to_pylist() for k in ("n1", "n2", "sizes")), strict=True):
                    if c is not None:
                        sizes.update(zip(zip(np.frombuffer(a, "u8").tolist(), np.frombuffer(b, "u4").tolist(), strict=True), np.frombuffer(c, "u4").tolist(), strict=True))
                yield batch.filter(pc.is_null(batch.column("sizes")))

        x = _gathered(postings(), BACK_KINDS)
        node = np.repeat(np.arange(len(x["n1"])), x["runs"])
        n1, n2, tokens, classes = x["n1"][node], x["n2"][node], x["tokens"], x["classes"]
        by = np.lexsort((tokens, classes, n2, n1))
        by = by[_runs(n1[by], n2[by], tokens[by])]
        n1, n2, tokens, classes = n1[by], n2[by], tokens[by], classes[by]
        starts = _runs(n1, n2)
        rows = []
        for a, z in zip(starts.tolist(), (starts + _lengths(starts, len(n1))).tolist(), strict=True):
            size = sizes[int(n1[a]), int(n2[a])]
            own = size - (z - a)
            if own <= most_missing(size, percent):
                rows.append((n1[a].view("i8"), n2[a].view("i4"), size, own, tokens[a:z].tobytes(), classes[a:z].tobytes()))
        for a in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[a : a + 1000], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["n1", "n2", "size", "own", "tokens", "classes"])

    return back.repartitionById(parts, "part").mapInArrow(take, "n1 long, n2 int, size int, own int, tokens binary, classes binary")


def _signature_rows(nodes: DataFrame, percent: int) -> DataFrame:
    """(sig, n1, n2, size, own, cap): cap is the largest size that a partner found by sig may have."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = batch.column("size").to_numpy(), batch.column("own").to_numpy()
            made = [signatures(np.frombuffer(t, "u8"), np.frombuffer(c, "u1"), int(k), percent) for t, c, k in zip(batch.column("tokens").to_pylist(), batch.column("classes").to_pylist(), own, strict=True)]
            for a in range(0, len(made), 500):
                part = made[a : a + 500]
                at = np.repeat(np.arange(a, a + len(part)), [len(s) for s, _ in part])
                sig, bound = (np.concatenate([x[i] for x in part]) for i in (0, 1))
                cap = (sizes[at].astype("i8") - bound) * (100 + percent) // percent - sizes[at]
                yield pa.RecordBatch.from_arrays([pa.array(sig.view("i8")), *(pa.array(batch.column(c).to_numpy()[at]) for c in NODE), pa.array(sizes[at]), pa.array(own[at]), pa.array(cap.astype("i4"))], names=["sig", *NODE, "size", "own", "cap"])

    return nodes.mapInArrow(take, "sig long, n1 long, n2 int, size int, own int, cap int")


def _linked(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold, by their whole sets: shingles that only one
    node has can't be common."""

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> int:
            both = np.concatenate([np.frombuffer(x, "u8"), np.frombuffer(y, "u8")])
            both.sort()
            return int(np.count_nonzero(both[1:] == both[:-1]))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    sets = nodes.select(F.struct(*NODE).alias("node"), "size", "tokens")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("tokens").alias("_sa")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("tokens").alias("_sb")), "b")
    both = both.select("a", "b", "na", "nb", common("_sa", "_sb").cast("long").alias("c"))
    return both.where(F.col("c") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node of the component.

    Alternates two steps until nothing changes: every node's larger neighbours go to its smallest one,
    then every node's smaller neighbours do. Each step's edges are written to the shared folder, and
    those of the step before are removed.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}-0")
    state, k = None, 0
    while True:
        two = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        k += 1
        e = stored(small, f"{path}-{k}")
        discard(e.sparkSession, f"{path}-{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if now == state:
            break
        state = now
    out = e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return out.unionByName(out.select(F.col("label").alias("node"), "label").distinct())


def _bucket(size: Column, percent: int) -> Column:
    """Sizes by eighths of the ratio that partners' sizes may have."""
    return F.floor(F.log(size) * F.lit(8 / np.log(100 / percent))).cast("int")


def _across(members: DataFrame, labels: DataFrame, percent: int, path: str) -> DataFrame:
    """The pairs (a, b) of nodes in one signature and several components that the bounds of their sizes
    admit. The smaller node meets larger ones in the buckets of sizes that both bounds reach, and one of
    the two is always outside the signature's largest component."""
    named = members.join(labels, "node", "left").select("sig", "node", "size", "cap", F.coalesce("label", "node").alias("label"))
    each = named.groupBy("sig", "label").agg(F.count("*").alias("n"))
    several = each.groupBy("sig").agg(F.count("*").alias("k"), F.max(F.struct("n", "label")).alias("m")).where("k > 1").select("sig", F.col("m.label").alias("main"))
    several = stored(several, f"{path}-several")
    open_ = named.join(several, "sig").select("sig", "node", "size", "cap", "label", (F.col("label") != F.col("main")).alias("minor"))
    open_ = stored(open_, path)
    least = F.ceil(F.col("size") * percent / 100)
    small = open_.where("cap >= size").select("sig", F.col("node").alias("a"), F.col("size").alias("sa"), F.col("cap").alias("ca"), F.col("label").alias("la"), F.col("minor").alias("ma"), _bucket(F.col("size"), percent).alias("bucket"))
    reach = F.explode(F.sequence(_bucket(least, percent), _bucket(F.least("cap", "size"), percent)))
    large = open_.where(F.col("cap") >= least).select("sig", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("cap").alias("cb"), F.col("label").alias("lb"), F.col("minor").alias("mb"), reach.alias("bucket"))
    fits = (F.col("la") != F.col("lb")) & (F.col("sa") <= F.col("sb")) & (F.col("sa") <= F.col("cb")) & (F.col("sb") <= F.col("ca")) & (F.col("sa") * 100 >= F.col("sb") * percent)
    one = small.where("ma").join(large, ["sig", "bucket"]).where(fits)
    two = small.where("not ma").join(large.where("mb"), ["sig", "bucket"]).where(fits)
    return one.select("a", "b").unionByName(two.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """(_id, _k1, _k2, _size, label) of every row: its key, the hashes of the whole row, the size of its
    set, and the node that its component is named after (null without words)."""
    if percent < 70:
        raise ValueError("prefixes of pairs hold for thresholds of 70 percent and more")
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), *row_key(*docs.columns))
    found = _found(docs, n, f"{base}/found")
    heavy = spark.sparkContext.broadcast(heavy_shingles(found))
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // PART_BYTES))
    found = found.where("token is null").select("_id", "_k1", "_k2", "_size", F.when(F.col("_size") > 0, F.struct(*NODE)).alias("node"))

    back = _repeated(_postings(docs, n, parts, heavy), parts)
    nodes = stored(_candidates(back, parts, percent), f"{base}/nodes")
    rows = stored(_signature_rows(nodes, percent), f"{base}/signatures")
    hubs = rows.groupBy("sig").agg(F.min(F.struct((F.col("own") / F.col("size")).alias("share"), *NODE, F.col("size").alias("size"), F.col("cap").alias("cap"))).alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    hubs = stored(hubs, f"{base}/hubs")  # so that the join can split frequent signatures
    members = stored(rows.join(hubs, "sig").select("sig", F.struct(*NODE).alias("node"), "size", "cap", F.struct("hub.n1", "hub.n2").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.cap").alias("hub_cap")), f"{base}/members")
    discard(spark, f"{base}/signatures")

    fits = (F.col("size") <= F.col("hub_cap")) & (F.col("hub_size") <= F.col("cap")) & (F.col("size") * 100 >= F.col("hub_size") * percent) & (F.col("hub_size") * 100 >= F.col("size") * percent)
    pairs = members.where(fits & (F.col("node") != F.col("hub"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = stored(_linked(nodes, pairs, percent), f"{base}/hub-links")
    labels = stored(components(links, f"{base}/first"), f"{base}/labels")
    more = stored(_linked(nodes, _across(members.select("sig", "node", "size", "cap"), labels, percent, f"{base}/open"), percent), f"{base}/more-links")
    if more.take(1):
        labels = stored(components(links.unionByName(more), f"{base}/second"), f"{base}/all-labels")
    for name in ("members", "open", "nodes"):
        discard(spark, f"{base}/{name}")
    return found.join(labels, "node", "left").select("_id", "_k1", "_k2", "_size", F.coalesce("label", "node").alias("label"))


@private_names
def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; key is an integer column.

    Documents link when 100 * shared >= percent * united of their sets of n-word shingles (words of
    the text with A-Z in lower case; a shorter text is one shingle). component_id is the smallest key
    that links lead to. Documents without words link with nothing: their component is themselves.
    Repeated rows and copies are one node and keep a row each. Null keys count as larger than all
    others (a component of null keys alone has a null id). Other columns are left out. An empty table
    gives an empty table. percent must be 70 or more.
    """
    rows = labelled(docs.select(key, text), n, percent, key, text)
    base = shared_dir(docs.sparkSession)
    rows = stored(rows, f"{base}/rows")
    least = stored(rows.where("label is not null").groupBy("label").agg(F.min("_id").alias("component_id")), f"{base}/least")  # so that the join can split large components
    rows = rows.join(least, "label", "left")
    return rows.select(F.col("_id").alias(key), F.col("_size").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


@private_names
def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest key (of equal keys, the one of the
    smallest hash). Rows without words stay, but repeated ones only once."""
    rows = labelled(docs, n, percent, key, text).withColumn("_o", F.struct(F.col("_id").isNull(), "_id", "_k1", "_k2"))
    first = rows.where("label is not null").groupBy("label").agg(F.min("_o").alias("_o")).select("_o._k1", "_o._k2")
    stay = first.unionByName(rows.where("label is null").select("_k1", "_k2").distinct())
    keyed = docs.select("*", *row_key(*docs.columns)).dropDuplicates(["_k1", "_k2"])
    return keyed.join(stay, ["_k1", "_k2"], "left_semi").select(*docs.columns)
