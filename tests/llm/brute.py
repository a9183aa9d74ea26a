"""Plain versions of the operators over lists of rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def dropped_lines(texts, min_docs, min_chars=1):
    """(n_lines, n_dropped, kept) of each text"""
    def key(line):
        return line.strip(SPACE).translate(LOW)

    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for ls in lines:
        gone = [len(key(x)) >= min_chars and seen[key(x)] >= min_docs for x in ls]
        out.append((len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)))
    return out


def shingles(text, n):
    w = [x.translate(LOW) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, percent):
    """Component of each (key, text): the smallest key reachable; keys may repeat or be None."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def item_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if w]


def contamination(texts, items, window=13):
    """(n_words, n_hit, ids) of each text"""
    wins = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if w else []:
            wins[tuple(w[s : s + k])].add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for t in texts:
        w, hit, ids = item_words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s : s + k])) in wins:
                    hit.update(range(s, s + k))
                    ids |= wins[g]
        out.append((len(w), len(hit), sorted(ids)))
    return out


def schedule(shares):
    """The source of each slot of a period, slot by slot."""
    period, done, out = sum(shares), [0] * len(shares), []
    for t in range(period):
        due = [(-(-(d + 1) * period // e), i) for i, (e, d) in enumerate(zip(shares, done, strict=True)) if d * period // e <= t]
        out.append(min(due)[1])
        done[out[-1]] += 1
    return out


def chunk_ends(raw):
    """Ends of the chunks of bytes, one byte after another."""
    from saccade.llm import substring_dedup as S

    low = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in raw)
    hashes, h = [], 0
    for c in low:
        h = (2 * h + int(S.GEAR[c])) % (1 << 32)
        hashes.append(h)
    ends, last = [], 0
    while last < len(low):
        cut = next((c for c in range(last + S.LEAST, len(low) + 1) if hashes[c - 1] < (1 << 32) // S.AVERAGE), len(low))
        if cut - last > S.MOST:
            cut = min(range(last + S.LEAST, last + S.MOST + 1), key=lambda c: (hashes[c - 1], c))
        ends.append(cut)
        last = cut
    moved = []
    for e in ends:
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e += 1
        moved.append(e)
    return low, sorted(set(moved))


def repeated_spans(rows, min_bytes):
    """(key, start, n_bytes, n_chunks, first, is_first) from different rows (key, text, ...)"""
    cut, holders = [], defaultdict(set)
    for i, (_, text, *_) in enumerate(rows):
        low, ends = chunk_ends((text or "").encode())
        cut.append([(a, z, low[a:z]) for a, z in zip([0, *ends], ends, strict=False)])
        for _, _, c in cut[-1]:
            holders[c].add(i)
    out = []
    for (key, *_), own in zip(rows, cut, strict=True):
        run, runs = [], []
        for a, z, c in own:
            if len(holders[c]) > 1:
                run.append((a, z, min(rows[j][0] for j in holders[c])))
            elif run:
                runs.append(run)
                run = []
        for run in [*runs, *([run] if run else [])]:
            if run[-1][1] - run[0][0] >= min_bytes:
                spans = []
                for a, z, first in run:
                    if spans and spans[-1][3] == first:
                        spans[-1][1:3] = [z, spans[-1][2] + 1]
                    else:
                        spans.append([a, z, 1, first])
                out += [(key, a, z - a, n, first, key <= first) for a, z, n, first in spans]
    return out


def near_items(texts, items, window=13, rarest=3, slack=8, share=0.5):
    """For each text, {item: best share of its searched places in one band of diagonals}, from share on."""
    words_of = [item_words(t) for t in texts]
    df = Counter(w for ws in words_of for w in ws)
    searched = {}
    for i, t in items:
        w = item_words(t)
        k, places = min(window, len(w)), set()
        for s in range(len(w) - k + 1) if w else []:
            places |= {(p, w[p]) for p in sorted((p for p in range(s, s + k) if df[w[p]]), key=lambda p: (df[w[p]], w[p], p))[:rarest]}
        if places:
            searched[str(i), tuple(w)] = places
    out = []
    for ws in words_of:
        at, best = defaultdict(list), {}
        for p, w in enumerate(ws):
            at[w].append(p)
        for (i, _), places in searched.items():
            bands = defaultdict(set)
            for q, w in places:
                for p in at[w]:
                    d = p - q
                    for band in {d // slack, (2 * d + slack) // (2 * slack) + 0.5}:
                        bands[band].add(q)
            found = max((len(x) for x in bands.values()), default=0) / len({q for q, _ in places})
            if found >= share:
                best[i] = max(found, best.get(i, 0))
        out.append(best)
    return out
