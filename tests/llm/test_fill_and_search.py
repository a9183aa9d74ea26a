import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saccade.llm import fill_middle, lexical_search, queries
from tests.llm import cases

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def moved(key, text, rate=50, spm=80):
    t = text or ""
    units = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return key, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, n, form, len(p), len(m), out


def fill_cases():
    rows = cases.documents()
    return [*rows, (301, "a <S> inside", "en", "s", 12), (302, "<P><M>", "en", "s", 6), (303, "  lead\n\ntail \t", "en", "s", 13), (304, "😀 ", "en", "s", 2), (305, "<<a <> P> ", "en", "s", 10)]


@pytest.mark.parametrize(("rate", "every"), [(50, 256), (100, 1), (100, 7)])
def test_fill_in_middle_matches_plain_version(spark, rate, every):
    docs = cases.frame(spark, fill_cases()).withColumns({"N": F.lit("clash"), "_key": F.lit(1)})
    got = fill_middle.fill_in_middle(docs, rate=rate, every=every)
    assert [c for c in got.columns if c not in docs.columns] == ["n", "form", "prefix_chars", "middle_chars", "output"] and "N" not in got.columns
    rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted((moved(r[0], r[1], rate) for r in fill_cases()), key=repr)
    back = got.select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(cases.empty(spark)).count() == 0


def test_checkpoints_agree_with_all_units():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab é😀 \n\t") for _ in range(rng.randrange(60)))
        ends, at = [0], 0
        for u in UNIT.findall(text):
            at += len(u)
            ends.append(at)
        index = fill_middle.Checkpoints(text.encode(), rng.choice([1, 3, 8]), rng.choice([1, 5, 16, 1000]))
        assert index.n == len(ends) - 1
        for i, e in enumerate(ends):
            assert index.find(i) == (len(text[:e].encode()), e)
        assert len(index.units) <= 1 + index.n


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "y"), ("abc", "b", "y")])
def test_marks_that_overlap_are_refused(spark, marks):
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(cases.frame(spark, []), marks=marks)


def ranked(docs, items, k=10):
    def terms(text):
        return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if t]

    counted = [(key, Counter(terms(t))) for key, t in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c, size in counted:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return out


def search_cases():
    rows = cases.documents()
    rng = random.Random(9)
    rows += [(400 - i, "tie breaker words " + "pad " * (i % 3), "en", "s", 0) for i in range(40)]
    rows += [(500 + i, cases.prose(rng, 30), "en", "s", 0) for i in range(200)]
    items = [(i, cases.prose(rng, 25)) for i in range(12)]
    items += [(20, "tie words"), (20, "tie words"), (21, ""), (22, None), (None, "breaker ALPHA1"), (23, "neverseen"), (24, "¿ñ É 中文"), (25, rows[0][1]), (26, "ha"), (27, " .,!")]
    return rows, items


@pytest.mark.parametrize(("k", "query_bytes", "parts"), [(10, 1 << 22, 3), (3, 200, 7)])
def test_search_matches_brute_force(spark, k, query_bytes, parts):
    rows, items = search_cases()
    docs = cases.frame(spark, rows).withColumns({"_text": F.lit("x"), "_key": F.lit(3), "score": F.lit(1)}).repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(5))
    got = lexical_search.search(docs, asked, k=k, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(ranked([(r[0], r[1]) for r in rows], items, k), key=repr)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert lexical_search.search(cases.empty(spark), items).count() == 0
    assert lexical_search.search(cases.frame(spark), items.where("item_id > 1")).count() == 0


def test_best_first_opens_few_nodes_and_keeps_ties():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        n, v = int(rng.integers(1, 4096)), int(rng.integers(1, 12))
        cells = np.unique(rng.integers(0, n * v, int(rng.integers(1, 6000))))
        docs, terms = (cells // v).astype("i8"), (cells % v).astype("i4")
        values = rng.integers(0, rng.choice([3, 1000]), len(cells)).astype("i8")
        keys = rng.permutation(n).tolist()
        tree = lexical_search.MaxTree(terms, docs, values)
        query = np.unique(rng.integers(0, v + 2, 4))
        sums = Counter()
        for d, t, x in zip(docs.tolist(), terms.tolist(), values.tolist(), strict=True):
            if t in query:
                sums[keys[d]] += x
        want = sorted((-s, key) for key, s in sums.items() if s > 0)
        assert tree.best(query, 10, keys, 1) == want[:10]
        if len(want) > 12:
            assert tree.best(query, 10, keys, -want[4][0]) == [x for x in want if x[0] <= want[4][0]][:10]


def test_pieces_of_long_texts_split_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 5)
    text = "Ab cde fghijklmnop é中文x, q " * 20
    assert [t for part in lexical_search.terms_of(text) for t in part] == lexical_search.TERM.findall(text.encode().lower())


def test_queries_run_on_a_folder(spark, tmp_path):
    rows, items = search_cases()
    folder = cases.save(spark, tmp_path / "t", rows, items)
    assert queries.op13_lexical_search(spark, folder).count() == len(ranked([(r[0], r[1]) for r in rows], items))
    got = queries.op12_fill_middle(spark, folder).collect()
    assert len(got) == len(rows)
    texts = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert Counter(r["restored_sha256"] for r in got) == texts
