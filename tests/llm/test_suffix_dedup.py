import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.llm import induced_sort, queries, suffix_dedup
from tests.llm import cases


def plain_suffixes(text, limit):
    t = text.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])

    def shared(i, j):
        k = 0
        while k < limit and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
            k += 1
        return k

    return order, [0, *map(shared, order, order[1:])]


@pytest.mark.parametrize("kind", ["u1", "u4"])
@pytest.mark.parametrize("small", [False, True])
def test_suffixes_match_plain_sorting(monkeypatch, kind, small):
    """Also with a memory of five tuples: queues on disk, sorted runs, and recursion down to two names."""
    rng = np.random.default_rng(8)
    for i in range(150):
        monkeypatch.setattr(induced_sort, "BLOCK", int(rng.choice([2, 7, 1 << 16])))
        n, sigma = int(rng.integers(1, 120)), int(rng.choice([2, 3, 5, 200]))
        text = rng.integers(1, sigma, n) if i % 3 else np.tile(rng.integers(1, sigma, int(rng.integers(1, 9))), n)[:n]
        text = np.append(text, 0).astype(kind)
        places, common = [], []

        def emit(p, g, places=places, common=common):
            places.extend(p.tolist())
            common.extend(g.tolist())

        sizes = {"memory": 5, "short": 2} if small else {}
        induced_sort.scan_suffixes(text, sigma, 400, emit, **sizes)
        assert (places[::-1], [0, *common[::-1][:-1]]) == plain_suffixes(text, 400)


def rests(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept) of each text"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
        kept = bytes(np.frombuffer(d, "u1")[~gone[:-1]])
        out.append((len(d), int(gone.sum()), int(runs), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(6)
    rows = cases.documents()
    shared = cases.prose(rng, 90)
    rows += [(400 + i, cases.prose(rng, 30 + i) + shared[i : len(shared) - 3 * i] + cases.prose(rng, 20), "en", "s", 0) for i in range(25)]
    rows += [(500, "ab" * 700, "en", "s", 0), (501, "y" * 400, "en", "s", 0), (502, "y" * 401 + "z", "en", "s", 0), (503, "é" * 250 + "ñ" * 250 + "é" * 250, "en", "s", 0), (504, "abcdefg " * 90, "en", "s", 0)]
    rows += [(505, "w" * 1500 + shared + "w" * 900, "en", "s", 0), (506, shared + " and again " + shared, "en", "s", 0), (507, "\x00" * 450 + "q", "en", "s", 0)]
    return rows


@pytest.mark.parametrize(("length", "shard_bytes", "segment"), [(400, 1 << 23, 1 << 22), (400, 3000, 500), (64, 20_000, 1 << 22)])
def test_rest_matches_brute_force(spark, monkeypatch, length, shard_bytes, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rows = passages()
    docs = cases.frame(spark, rows).withColumns({"N_BYTES": F.lit(1), "_text": F.lit(None).cast("string"), "least": F.lit(0)})
    got = suffix_dedup.drop_repeated(docs, length, shard_bytes=shard_bytes)
    assert [c for c in got.columns if c not in docs.columns] == ["n_bytes", "n_removed", "n_spans", "kept"]
    cells = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = rests([r[1] for r in rows], length)
    assert sorted(map(tuple, cells), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)
    assert any(w[2] > 1 for w in want)


def test_pieces_hold_each_window_once():
    rng = np.random.default_rng(2)
    for _ in range(40):
        data = rng.integers(97, 97 + int(rng.choice([2, 20])), int(rng.integers(0, 900))).astype("u1")
        if rng.random() < 0.3:
            data[100:700] = 97
        first, size, _, _, sure = suffix_dedup.pieces_of(data, 70, 1)
        seen = Counter(p for a, s in zip(first.tolist(), size.tolist(), strict=True) for p in range(a, a + s - 69))
        for a, s in sure:
            seen.update(range(a + 1, a + s - 70))
        assert seen == Counter(range(max(0, len(data) - 69)))


def test_empty_tables_and_short_lengths(spark):
    assert suffix_dedup.drop_repeated(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.drop_repeated(cases.empty(spark), 40)


def test_query_runs_on_a_folder(spark, tmp_path):
    rows = passages()
    folder = cases.save(spark, tmp_path / "t", rows)
    want = sorted(((r[0], *w) for r, w in zip(rows, rests([r[1] for r in rows]), strict=True)), key=repr)
    assert sorted(map(tuple, queries.op11_suffix_dedup(spark, folder).collect()), key=repr) == want


def test_heavy_keys_cut_their_pieces_once(spark, monkeypatch):
    read, plain = [], suffix_dedup.pieces

    def watched(texts, length, seed):
        if seed:
            read.append(texts._jdf.queryExecution().optimizedPlan().toString())
        return plain(texts, length, seed)

    monkeypatch.setattr(suffix_dedup, "pieces", watched)
    rows = passages()
    docs = cases.frame(spark, rows)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.drop_repeated(docs, 400, shard_bytes=3000).select("doc_id", "n_removed").collect()}
    assert read and not any("MapInArrow" in plan for plan in read)
    assert got == {r[0]: w[1] for r, w in zip(rows, rests([r[1] for r in rows]), strict=True)}


def test_planted_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(11)
    shared = [cases.prose(rng, 90 + 5 * i) for i in range(8)]
    assert all(len(p.split()) > 50 and len(p.encode()) > 400 for p in shared)
    short = " ".join(f"{rng.randrange(1000):03}" for _ in range(60))  # more than 50 words, but fewer than 400 bytes
    rows = [(i, f"{cases.prose(rng, 40)} #{i} {shared[i % 8]} #{i} {cases.prose(rng, 40)}") for i in range(40)]
    rows += [(100 + i, f"{cases.prose(rng, 120)} #{i} {short} #{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.drop_repeated(docs).select("doc_id", "n_removed").collect()}
    assert got == {r[0]: w[1] for r, w in zip(rows, rests([r[1] for r in rows]), strict=True)}
    assert all(got[i] >= len(shared[i % 8].encode()) and got[100 + i] == 0 for i in range(40))
