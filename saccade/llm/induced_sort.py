"""Suffixes of a long text in order, with their common prefixes, by external induced sorting.

A suffix is of type S if it is less than the one after it, else L; S* suffixes are those of type S after one
of type L. The substrings from one S* to the next are sorted and named, and the text of the names, at most
half as long, is sorted in the same way (or by doubling once it is short). That gives the order of the S*
suffixes, which induces all others: a scan in ascending order hands each L suffix to the queue of its
first character, a scan in descending order does so for S suffixes. Queues hold tuples (character,
position, common prefix with the tuple before, the next preceding characters), so that the text is seldom
looked at again, and give them out by character; what goes beyond ``memory`` tuples waits on disk. Common
prefixes are carried along: an induced pair shares one character more than the least between its sources.

All that is on disk is in files without names, which end with the process.
"""

from __future__ import annotations

import itertools
import tempfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np

#: A suffix in a queue; pre: its preceding characters, the nearest lowest; left: how many those are.
TUPLE = np.dtype([("char", "u4"), ("lcp", "u2"), ("left", "u2"), ("pos", "i8"), ("pre", "u8")])
#: Tuples in a block, shelves of a queue, names that are sorted by doubling.
BLOCK, SHELVES, SHORT = 1 << 16, 256, 1 << 22
PAD = {1: 0xFF, 4: 0xFFFFFFFF}


def on_disk(n: int, kind: str) -> np.ndarray:
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=max(n, 1))[:n]  # noqa: SIM115


class Queue:
    """Tuples by character, each character's in the order in which they came. Ranges of characters share a
    shelf, which is sorted when its turn comes; full shelves are written to disk."""

    def __init__(self, sigma: int, memory: int):
        self.shift = max(0, (sigma - 1).bit_length() - (SHELVES - 1).bit_length())
        self.memory, self.held = memory, 0
        self.shelves: dict[int, list] = defaultdict(list)
        self.now, self.sorted, self.late = -1, np.empty(0, TUPLE), defaultdict(list)
        self.file = None

    def put(self, tuples: np.ndarray) -> None:
        """tuples are sorted by character."""
        shelf = tuples["char"] >> self.shift
        cut = [0, *(np.flatnonzero(shelf[1:] != shelf[:-1]) + 1).tolist(), len(tuples)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if shelf[a] == self.now:  # open: it has been sorted already
                chars = tuples["char"][a:b]
                inner = [a, *(a + 1 + np.flatnonzero(chars[1:] != chars[:-1])).tolist(), b]
                for x, y in zip(inner[:-1], inner[1:], strict=True):
                    self.late[int(tuples["char"][x])].append(tuples[x:y])
            else:
                self.shelves[int(shelf[a])].append(tuples[a:b])
                self.held += b - a
        if self.held > self.memory:
            self._write()

    def _write(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
        for chunks in self.shelves.values():
            own = [c for c in chunks if isinstance(c, np.ndarray)]
            if own:
                self.file.seek(0, 2)
                place = self.file.tell()
                for c in own:
                    self.file.write(np.ascontiguousarray(c).tobytes())
                chunks[:] = [*(c for c in chunks if not isinstance(c, np.ndarray)), (place, sum(map(len, own)))]
        self.held = 0

    def _chunks(self, chunks: list, back: bool = False) -> Iterator[np.ndarray]:
        """The tuples of chunks, in blocks that are worth a step."""
        some, size = [], 0
        for part in self._parts(chunks, back):
            some.append(part)
            size += len(part)
            if size >= BLOCK:
                yield np.concatenate(some)
                some, size = [], 0
        if some:
            yield np.concatenate(some)

    def _parts(self, chunks: list, back: bool) -> Iterator[np.ndarray]:
        for c in reversed(chunks) if back else chunks:
            if isinstance(c, np.ndarray):
                yield c[::-1] if back else c
                continue
            parts = range(0, c[1], BLOCK)
            for at in reversed(parts) if back else parts:
                self.file.seek(c[0] + at * TUPLE.itemsize)
                own = np.frombuffer(self.file.read(min(BLOCK, c[1] - at) * TUPLE.itemsize), TUPLE)
                yield own[::-1] if back else own

    def take(self, char: int, back: bool = False) -> Iterator[np.ndarray]:
        """Blocks of the character's tuples, which leave the queue; back: the last ones first."""
        if not self.shift:
            chunks = self.shelves.pop(char, [])
            self.held -= sum(len(c) for c in chunks if isinstance(c, np.ndarray))
            yield from self._chunks(chunks, back)
            return
        if char >> self.shift != self.now:
            self.now = char >> self.shift
            chunks = self.shelves.pop(self.now, [])
            self.held -= sum(len(c) for c in chunks if isinstance(c, np.ndarray))
            rows = np.concatenate([np.empty(0, TUPLE), *self._chunks(chunks)])
            self.sorted, self.late = rows[np.argsort(rows["char"], kind="stable")], defaultdict(list)
        a, b = np.searchsorted(self.sorted["char"], [char, char + 1])
        own = [x for x in (self.sorted[a:b], *self.late.pop(char, [])) if len(x)]
        yield from self._chunks(own, back)


class Induction:
    """One scan: what it hands to the queues, with common prefixes."""

    def __init__(self, text: np.ndarray, sigma: int, limit: int, memory: int):
        self.text, self.limit = text, limit
        self.bits = 8 * text.itemsize
        self.queue = Queue(sigma, memory)
        self.since, self.source = np.zeros(sigma, "u2"), np.full(sigma, -1, "i8")
        self.touched: list[np.ndarray] = []

    def begin(self) -> None:
        """A new source character: nothing in front has a common prefix with what follows."""
        self.touched = []

    def filled(self, b: np.ndarray) -> np.ndarray:
        """b, with preceding characters where none is left."""
        i = np.flatnonzero((b["left"] == 0) & (b["pos"] > 0))
        if len(i):
            b = b.copy()
            b["pre"][i], b["left"][i] = preceding(self.text, b["pos"][i])
        return b

    def taken(self, char: int, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
        """Blocks of a character's tuples, which are pushed; then those that they bring for the same character."""
        own: deque[np.ndarray] = deque()

        def brought() -> Iterator[np.ndarray]:
            while own:
                yield own.popleft()

        for block in itertools.chain(self.queue.take(char), brought()):
            block = self.filled(block)
            if len(more := self.push(block, char, wanted)):
                own.append(more)
            yield block

    def push(self, b: np.ndarray, char: int, wanted: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Hands the predecessors of b that are wanted to their queues; returns those of the same character."""
        q = (b["pre"] & np.uint64((1 << self.bits) - 1)).astype("i8")
        sel = np.flatnonzero((b["pos"] > 0) & wanted(q))
        g = b["lcp"]
        if not len(sel):
            least = g.min()
            for t in self.touched:
                self.since[t] = np.minimum(self.since[t], least)
            return np.empty(0, TUPLE)
        order = sel[np.argsort(q[sel].astype("u1") if self.bits == 8 else q[sel], kind="stable")]
        qs = q[order]
        fresh = np.append(True, qs[1:] != qs[:-1])
        ends = np.append(np.flatnonzero(fresh)[1:], len(qs)) - 1
        heads, firsts = order[fresh], qs[fresh]
        ahead = np.minimum.accumulate(g)
        common = np.empty(len(order), "i8")
        common[~fresh] = _least(g, order[:-1][~fresh[1:]] + 1, order[1:][~fresh[1:]])
        here, never = self.source[firsts] == char, self.source[firsts] < 0
        common[fresh] = np.where(never, -1, np.where(here, np.minimum(self.since[firsts], ahead[heads]), 0).astype("i8"))
        for t in self.touched:
            self.since[t] = np.minimum(self.since[t], ahead[-1])
        behind = np.append(np.minimum.accumulate(g[::-1])[::-1], self.limit)
        self.since[firsts] = behind[order[ends] + 1]
        self.source[firsts] = char
        if len(new := firsts[~here]):
            self.touched.append(new)
        out = np.empty(len(order), TUPLE)
        out["char"], out["lcp"], out["pos"] = qs, np.minimum(common + 1, self.limit), b["pos"][order] - 1
        out["pre"], out["left"] = b["pre"][order] >> np.uint64(self.bits % 64), b["left"][order] - 1
        same = qs == char
        self.queue.put(out[~same] if same.any() else out)
        return out[same]


def _least(g: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of g over first[i] to last[i], by minima over powers of two."""
    out = np.empty(len(first), "i8")
    power = np.frexp((last - first + 1).astype("f8"))[1] - 1
    table = g
    for k in range(int(power.max(initial=-1)) + 1):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(table[first[at]], table[last[at] + 1 - (1 << k)])
        table = np.minimum(table[: -(1 << k) or None], table[1 << k :])
    return out


def preceding(text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters before each position, as many as a number holds, and how many there are."""
    bits = 8 * text.itemsize
    pre, width = np.zeros(len(pos), "u8"), 64 // bits
    for k in range(width):
        pre |= text[np.maximum(pos - 1 - k, 0)].astype("u8") << np.uint64(bits * k)
    return pre, np.minimum(pos, width)


def stars(text: np.ndarray) -> np.ndarray:
    """Positions of the S* suffixes, the last character included."""
    found, right, hi = [], True, len(text) - 1
    while hi > 0:
        lo = max(0, hi - 16 * BLOCK)
        a = text[lo : hi + 1]
        at = np.where(a[:-1] != a[1:], np.arange(hi - lo), hi - lo)
        kind = np.append(a[:-1] < a[1:], right)[np.append(np.minimum.accumulate(at[::-1])[::-1], hi - lo)]
        found.append(np.flatnonzero(~kind[:-1] & kind[1:]) + lo + 1)
        right, hi = bool(kind[0]), lo
    return np.concatenate(found[::-1])


def _sorted_keys(keys: np.ndarray, memory: int) -> np.ndarray:
    """The order of 64-bit keys: runs of ``memory`` keys are sorted apart, on disk, and merged range by range."""
    n = len(keys)
    if n <= memory:
        return np.argsort(keys, kind="stable")
    runs = []
    for lo in range(0, n, memory):
        own = np.argsort(keys[lo : lo + memory], kind="stable")
        run = on_disk(len(own), "u8"), on_disk(len(own), "i8")
        run[0][:], run[1][:] = keys[lo : lo + memory][own], own + lo
        runs.append(run)
    bounds = np.unique(np.concatenate([r[0][:: max(1, memory // len(runs) // 2)] for r in runs]))
    out, done, places = on_disk(n, "i8"), 0, [np.append(np.searchsorted(r[0], bounds), len(r[0])) for r in runs]
    before = [0] * len(runs)
    for i in range(len(bounds) + 1):
        parts = [(r[0][a : p[i]], r[1][a : p[i]]) for r, p, a in zip(runs, places, before, strict=True)]
        k, v = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        out[done : done + len(k)] = v[np.argsort(k, kind="stable")]
        done, before = done + len(k), [p[i] for p in places]
    return out


def names(text: np.ndarray, star: np.ndarray, memory: int) -> tuple[np.ndarray, int]:
    """Numbers of the substrings from each S* to the next, in the order of the substrings, and how many differ.
    A substring that another one continues is greater: where it ends, the other falls."""
    bits = 8 * text.itemsize
    width, last = 64 // bits, np.append(star[1:], len(text) - 1)
    group, active, done = np.zeros(len(star), "i8"), np.arange(len(star)), 0
    while len(active):
        at, end, keys = star[active] + done, last[active], np.zeros(len(active), "u8")
        for k in range(width):
            inside = at + k <= end
            keys = keys << np.uint64(bits % 64) | np.where(inside, text[np.minimum(at + k, len(text) - 1)], PAD[text.itemsize]).astype("u8")
        order = np.lexsort((keys, group[active])) if done else _sorted_keys(keys, memory)
        own, keys, more = group[active][order], keys[order], (at + width <= end)[order]
        cut = np.append(True, own[1:] != own[:-1])
        part = cut | np.append(True, keys[1:] != keys[:-1])
        places, first = np.flatnonzero(part), np.flatnonzero(cut)
        begin = np.repeat(first, np.diff(np.append(first, len(own))))  # of the group that each was in
        sizes = np.diff(np.append(places, len(own)))
        group[active[order]] = own + np.repeat(places, sizes) - begin
        open_ = (sizes > 1) & np.logical_or.reduceat(more, places)
        active = active[order[np.repeat(open_, sizes)]]
        done += width
    there = np.zeros(len(star), bool)
    there[group] = True
    number = np.cumsum(there)
    return (number - 1).astype("u4")[group], int(number[-1])


def doubled(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes with the suffix before) of a short text of numbers by doubling. Suffixes that
    agree in ``limit`` characters stand in any order."""
    n = len(text)
    sizes = np.bincount(text)
    rank = (np.cumsum(sizes) - sizes).astype("u4")[text]  # where the group of a suffix begins
    levels, k = [rank], 1
    active = np.flatnonzero(sizes[text] > 1)
    while len(active) and k < limit:
        key = (rank[active].astype("u8") << np.uint64(32)) | np.where(active + k < n, rank[np.minimum(active + k, n - 1)] + 1, 0).astype("u8")
        order = np.argsort(key, kind="stable")
        key, own = key[order], active[order]
        group = key >> np.uint64(32)
        cut = np.append(True, group[1:] != group[:-1])
        part = np.append(True, key[1:] != key[:-1])
        places, first = np.flatnonzero(part), np.flatnonzero(cut)
        sizes = np.diff(np.append(places, len(own)))
        rank = rank.copy()
        rank[own] += (np.repeat(places, sizes) - np.repeat(first, np.diff(np.append(first, len(own))))).astype("u4")
        levels.append(rank)
        active, k = own[np.repeat(sizes > 1, sizes)], 2 * k
    order = np.argsort(rank, kind="stable")
    a, b, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), "i8")
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x < n) & (y < n)
        common += (1 << t) * (fits & (levels[t][np.minimum(x, n - 1)] == levels[t][np.minimum(y, n - 1)]))
    return order, np.minimum(np.append(0, common), limit).astype("u2")


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, limit: int) -> np.ndarray:
    """How many characters the suffixes at a and b share, given that they share ``common``; limit at most."""
    common, todo, n = np.minimum(common, limit), np.arange(len(a)), len(text) - 1
    todo = todo[common < limit]
    while len(todo):
        same = np.ones(len(todo), bool)
        for _ in range(8):
            c = common[todo]
            same &= text[np.minimum(a[todo] + c, n)] == text[np.minimum(b[todo] + c, n)]
            common[todo] += same
        todo = todo[same & (common[todo] < limit)]
    return np.minimum(common, limit)


def scan_suffixes(text: np.ndarray, sigma: int, limit: int, emit: Callable[[np.ndarray, np.ndarray], None], memory: int = 1 << 22, short: int = SHORT) -> None:
    """Calls emit(positions, common) with blocks of all suffixes of text in descending order; common: how many
    characters each shares with the one given before it, at most limit. text: characters below sigma as
    8- or 32-bit numbers without sign; its last one is 0, and no other is."""
    if len(text) == 1:
        emit(np.zeros(1, "i8"), np.zeros(1, "u2"))
        return
    star = stars(text)
    number, different = names(text, star, memory)
    m = len(star)
    if different == m:
        order, common = np.argsort(number, kind="stable"), np.zeros(m, "u2")
    elif m <= short:
        order, common = doubled(number, limit)
    else:
        order, common, at = on_disk(m, "i8"), on_disk(m, "u2"), m

        def keep(pos: np.ndarray, shared: np.ndarray) -> None:
            nonlocal at
            at -= len(pos)
            order[at : at + len(pos)] = pos[::-1]
            inside = shared[::-1] if at + len(pos) < m else shared[:0:-1]
            common[at + 1 : at + 1 + len(inside)] = inside

        scan_suffixes(number, different, limit, keep, memory, short)
    common = common.astype("i8")
    length = star[np.minimum(order[:-1] + common[1:], m - 1)] - star[order[:-1]]
    common[1:] = _agree(text, star[order[:-1]], star[order[1:]], length, limit)
    starred = np.empty(m, TUPLE)
    starred["pos"], starred["lcp"], starred["char"] = star[order], common, text[star[order]]
    starred["pre"], starred["left"] = preceding(text, starred["pos"])
    del order, common, number, star, length

    def run(pos: int) -> int:
        n = 1
        while n < limit and text[pos + n] == text[pos]:
            n += 1
        return n

    falling, kept = Induction(text, sigma, limit, memory), Queue(sigma, memory)
    edge = np.searchsorted(starred["char"], np.arange(sigma + 1))
    for c in range(sigma):
        falling.begin()
        last = None
        for block in falling.taken(c, lambda q: q >= c):
            kept.put(block)
            last = int(block["pos"][-1])
        for lo in range(edge[c], edge[c + 1], BLOCK):
            block = starred[lo : min(lo + BLOCK, edge[c + 1])]
            if lo == edge[c]:
                block["lcp"][0] = 0 if last is None else min(run(last), run(int(block["pos"][0])))
            falling.push(block, c, lambda q: q > c)
    del starred

    rising = Induction(text, sigma, limit, memory)
    for c in range(sigma - 1, 0, -1):
        rising.begin()
        last = None
        for block in rising.taken(c, lambda q: q <= c):
            emit(block["pos"], block["lcp"])
            last = int(block["pos"][-1])
        above = None
        for block in kept.take(c, back=True):
            block, own = rising.filled(block).copy(), block["lcp"]
            if above is None:
                above = 0 if last is None else min(run(last), run(int(block["pos"][0])))
            block["lcp"] = np.append(above, own[:-1])
            above = own[-1]
            emit(block["pos"], block["lcp"])
            rising.push(block, c, lambda q: q < c)
    emit(np.array([len(text) - 1]), np.zeros(1, "u2"))
