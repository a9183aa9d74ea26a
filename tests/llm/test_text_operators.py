import hashlib
import math

import pytest
from pyspark.sql import functions as F

from saccade.llm import decontaminate, line_dedup, mixing, ngram_join, quality, substring_dedup
from saccade.llm.common import row_key
from tests.llm import brute, cases


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_line_dedup_matches_brute_force(spark):
    rows = cases.documents()
    got = line_dedup.dedup_lines(cases.frame(spark).withColumn("kept_text", F.lit("clash")), min_docs=10)
    want = brute.dropped_lines([r[1] for r in rows], 10)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)
    assert any(w[1] == 2 for w in want)
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0


def test_line_runs_settle_and_compact(spark):
    docs = spark.createDataFrame([(i, "same\nonce %d" % i) for i in range(40)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2, buckets=4)
    for b in range(5):
        runs.add(docs.where(F.col("doc_id") % 5 == b))
    assert len(runs.levels) >= 3 and all(len(x) < 2 for x in runs.levels)
    assert runs.frequent().count() == 1
    total = sum(r.n for n in runs._names() for r in spark.table(n).collect())
    assert total < 80  # increments of a settled line are not stored
    runs.drop()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_match_brute_force(spark, n, percent):
    rows = [(r[0], r[1]) for r in cases.documents()]
    got = ngram_join.jaccard_components(cases.frame(spark), n, percent)
    want = brute.components(rows, n, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)


def test_jaccard_prefixes_hold_for_any_classes():
    """Whatever classes shingles have, sets that reach the threshold share a signature whose bounds admit both."""
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(1500):
        size = int(rng.integers(2, 70))
        universe = rng.integers(0, 1 << 63, size + 20, dtype="u8")
        a = np.unique(universe[:size])
        b = np.unique(np.append(np.delete(a, rng.integers(0, len(a), rng.integers(0, 8))), universe[size : size + rng.integers(0, 6)]))
        shared = np.union1d(np.intersect1d(a, b), universe[rng.random(len(universe)) < 0.3])
        kinds = dict(zip(universe.tolist(), (rng.integers(4, rng.integers(6, 60), len(universe))).tolist(), strict=True))
        for percent in (70, 80, 85, 95):
            both = len(np.intersect1d(a, b))
            if len(b) > 1 and len(a) != both and 100 * both >= percent * (len(a) + len(b) - both):
                found = []
                for s in (a, b):
                    known = s[np.isin(s, shared)]
                    classes = np.array([kinds[x] for x in known.tolist()], "u1")
                    by = np.lexsort((known, classes))
                    sig, bound = ngram_join.signatures(known[by], classes[by], len(s) - len(known), percent)
                    found.append(dict(zip(sig.tolist(), ((len(s) - bound) * (100 + percent) // percent - len(s)).tolist(), strict=True)))
                assert any(found[1].get(x, -1) >= len(a) and cap >= len(b) for x, cap in found[0].items())


@pytest.mark.parametrize("n", [1, 4, 5])
def test_sets_of_many_texts_at_once_are_those_of_each(n):
    import pyarrow as pa

    texts = [r[1] for r in cases.documents()] + ["", "  ", "a", "A a", " x  y z ", "x y z", "\u00a0 b\u2003c d", "tail\x0bof\x0cwords here"]
    for column in (pa.array(texts), pa.array(["skip", *texts])[1:], pa.array(texts, pa.large_string())):
        found = []
        for first, sets, bounds in ngram_join.sets_of(column, n):
            assert first == len(found)
            found += [sets[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        assert len(found) == len(texts)
        names: dict = {}
        for t, s in zip(texts, found, strict=True):
            want = brute.shingles(t, n)
            assert len(s) == len(set(s)) == len(want)
            assert names.setdefault(want, s) == s
        assert len({x for s in found for x in s}) == len({x for t in texts for x in brute.shingles(t, n)})


def test_a_large_family_of_near_copies_is_one_component(spark):
    """Most of its documents are not linked with most others."""
    rng = cases.random.Random(9)
    base = cases.prose(rng, 150).split(" ")
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(len(w)), 4):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    want = brute.components(rows, 4, 85)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)


def test_many_small_parts_and_heavy_shingles_lose_no_pairs(spark, monkeypatch):
    """Postings in many parts and sendings, a passage that most documents have, and copies in every task."""
    monkeypatch.setattr(ngram_join, "PART_BYTES", 2000)
    monkeypatch.setattr(ngram_join, "SENT", 500)
    rng, rows = cases.random.Random(10), []
    passage = cases.prose(rng, 30)
    for i in range(0, 700, 2):
        w = cases.prose(rng, 60).split(" ")
        rows += [(i, " ".join([*w, passage])), (i + 1, " ".join([*w, f"own{i}", passage]))]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    want = {i: i - i % 2 if i < 1000 else 0 for i, _ in rows}
    for least in (64, 4):
        monkeypatch.setattr(ngram_join, "heavy_shingles", lambda found, least=least: heavy_of(rows, least))
        got = ngram_join.jaccard_components(docs, 4, 85)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def heavy_of(rows, least):
    import numpy as np
    import pyarrow as pa

    sets = np.concatenate([s for _, s, _ in ngram_join.sets_of(pa.array([t for _, t in rows]), 4)])
    values, counts = np.unique(sets, return_counts=True)
    return values[counts >= least]


def test_heavy_shingles_are_those_of_very_many_documents(spark, monkeypatch):
    rng = cases.random.Random(12)
    rows = [(i, f"{cases.prose(rng, 20)} the same eight words stand in every text") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = []
    find = ngram_join.heavy_shingles
    monkeypatch.setattr(ngram_join, "heavy_shingles", lambda found: kept.append(find(found)) or kept[0])
    assert ngram_join.jaccard_components(docs, 4, 85).count() == 1200
    assert len(kept[0]) == 5


def test_rows_that_differ_in_where_nulls_stand_have_keys_of_their_own(spark):
    rows = [(1, "same words", "en", None, None), (1, "same words", None, "en", None), (1, "same words", None, None, None)]
    keys = cases.frame(spark, rows).select(*row_key("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert len({r._k1 for r in keys}) == len({r._k2 for r in keys}) == 3
    apart = cases.frame(spark, [(i, None, *x) for i, x in ((1, ("en", None, None)), (1, (None, "en", None)))])
    assert ngram_join.keep_one(apart).count() == 2  # without words: nothing links


def test_keep_one_leaves_one_of_each_group(spark):
    rows = cases.documents()
    comp = brute.components([(r[0], r[1]) for r in rows], 5, 80)
    got = ngram_join.keep_one(cases.frame(spark))
    texts = {r[0]: r[1] for r in rows}
    kept = [r.doc_id for r in got.collect()]
    want = {c[1] for c in comp if c[0]} | {r[0] for r, c in zip(rows, comp, strict=True) if not c[0]}
    assert sorted(kept, key=repr) == sorted(want, key=repr) and got.columns == cases.SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert all(r.text == texts[r.doc_id] for r in got.collect())
    assert ngram_join.keep_one(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="70"):
        ngram_join.jaccard_components(cases.frame(spark), percent=50)


def test_substring_repeats_catch_passages_and_leave_the_rest(spark):
    found = substring_dedup.repeats(cases.frame(spark))
    ids = {r.doc_id for r in found.collect()}
    assert {100, 105, 110, 120, 121, 122} <= ids
    assert not ids & {200, 201, 202, 203, 205, 207, 208}
    first = {(r.doc_id, r.first_id, r.is_first) for r in found.where("doc_id between 120 and 122").collect()}
    assert (120, 120, True) in first and (121, 120, False) in first
    texts = {r[0]: r[1] for r in cases.documents()}
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeats(cases.frame(spark)).collect()}
    assert cut[120] == texts[120] and len(cut[121]) < len(texts[121]) - 200 and cut[200] is None and cut[208] == texts[208]
    assert substring_dedup.repeats(cases.empty(spark)).count() == 0


def test_copies_that_share_a_passage_with_an_earlier_document_keep_the_rest_once(spark):
    rng = cases.random.Random(11)
    before, passage, after = (cases.prose(rng, n) for n in (90, 80, 90))
    copy = f"{before} {passage} {after}"
    rows = [(1, f"{cases.prose(rng, 40)} {passage} {cases.prose(rng, 40)}"), (5, copy), (9, copy + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeats(docs).collect()
    assert {(r.doc_id, r.first_id, r.is_first) for r in found} == {(1, 1, True), (5, 5, True), (5, 1, False), (9, 5, False), (9, 1, False)}
    raw = {i: t.encode() for i, t in rows}
    assert all(raw[r.doc_id][r.start : r.start + r.n_bytes].lower() in raw[r.first_id].lower() for r in found)
    left = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    assert left[1] == rows[0][1] and before[:400] in left[5] and after[-400:] in left[5] and passage[100:300] not in left[5]
    assert len(left[9]) < 100


def test_substring_repeats_match_brute_force(spark):
    rng = cases.random.Random(21)
    passage = cases.prose(rng, 60)
    rows = [r for r in cases.documents() if r[0] is not None]
    rows += [(400 + i, f"{cases.prose(rng, 30)} {passage.upper()} {cases.prose(rng, 30)}", "é", "s1", i) for i in range(4)]
    rows += [(410 + i, f"Ünïcode {'中文字符測試' * 90} ÉTÉ {i}", "en", "s1", i) for i in range(2)]
    docs = cases.frame(spark, rows).selectExpr("*", "1 AS digest", "2 AS _k1x", "3 AS start")
    got = substring_dedup.repeats(docs)
    want = brute.repeated_spans(list(dict.fromkeys(rows)), 128)
    assert rows_of(got, "doc_id", "start", "n_bytes", "n_chunks", "first_id", "is_first") == sorted(want, key=repr)
    assert {w[0] for w in want} >= {410, 411, 400, 403}
    left = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    for i, t in ((r[0], r[1]) for r in rows):
        gone = sorted((a, a + n) for d, a, n, _, _, first in want if d == i and not first)
        raw, at, out = (t or "").encode(), 0, []
        for a, z in gone:
            out.append(raw[at:a])
            at = z
        assert (left[i] or "") == b"".join([*out, raw[at:]]).decode()


def test_passages_of_51_words_are_found(spark):
    """Passages in two contexts each; a few may have too few whole chunks."""
    rng, rows = cases.random.Random(22), []
    for i in range(0, 600, 2):
        passage = cases.prose(rng, 51)
        rows += [(j, f"{cases.prose(rng, 40)} {passage} {cases.prose(rng, 40)}") for j in (i, i + 1)]
    found = {r.doc_id for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 0.97 * len(rows)


def test_cuts_resist_shifts():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 5000).astype("u1")
    a = substring_dedup.cuts(data)
    b = [int(e) - 7 for e in substring_dedup.cuts(np.append(rng.integers(97, 123, 7).astype("u1"), data))]
    assert len({*a.tolist()} & set(b)) > 0.95 * len(a)


def test_decontamination_matches_brute_force(spark):
    rows = cases.documents()
    text = {r[0]: r[1] for r in rows}
    part = " ".join(text[120].split()[45:75])
    items = [(1, part), (2, "one"), (3, None), (4, "..."), (5, " ".join(text[7].split()[2:16]).upper()), (5, "ha ha"), (6, "not there anywhere at all, really"), (7, "ha " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(cases.frame(spark).withColumn("n_hit", F.lit(9)), bench)
    want = brute.contamination([r[1] for r in rows], items)
    expect = sorted(((r[0], a, b, len(c), c, b > 0 and 20 * b >= a) for r, (a, b, c) in zip(rows, want, strict=True)), key=repr)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == expect
    assert decontaminate.decontaminate(cases.empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(cases.frame(spark), bench.limit(0)).where("contaminated").count() == 0
    near = decontaminate.proximity_matches(cases.frame(spark), spark.createDataFrame([(1, part.replace(" ", " extra ", 1))], "item_id long, text string"))
    assert {r.doc_id for r in near.collect()} >= {120, 121, 122}


def test_proximity_matches_are_those_of_brute_force(spark):
    rng = cases.random.Random(31)
    rows = cases.documents(n=25)
    passage = next(t for i, t, *_ in rows if i == 120).split()[45:75]
    changed = [w if i % 7 else f"{w} inserted{i}" for i, w in enumerate(passage)]
    items = [(1, " ".join(changed)), (2, None), (3, ""), (4, "one"), (5, cases.prose(rng, 30)), (6, " ".join(passage[:9])), (6, " ".join(passage[:9]))]
    docs = cases.frame(spark, rows)
    got = decontaminate.proximity_matches(docs.withColumn("near", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.near_items([r[1] for r in rows], items)
    expect = sorted(((r[0], i, round(x, 9)) for r, found in zip(rows, want, strict=True) for i, x in found.items()), key=repr)
    assert sorted(((r.doc_id, r["item"], round(r.near, 9)) for r in got.collect()), key=repr) == expect
    assert {(i, k) for i, k, _ in expect} >= {(120, "1"), (121, "1"), (122, "6")}
    assert decontaminate.proximity_matches(cases.empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_quality_keeps_copies_and_rejects_boilerplate(spark):
    rng = cases.random.Random(4)
    shell = "\n".join("menu entry %d of this very site with some words" % i for i in range(8))
    rows = [(i, "%s\n%s\n%s" % (cases.prose(rng, 3), shell, cases.prose(rng, 3)), "en", "host", 1) for i in range(15)]
    rows = [(a, "\n".join(y for x in b.split("\n") for y in (x, "own %d %d" % (a, rng.randint(0, 9999)))), c, d, e) for a, b, c, d, e in rows]
    rows += cases.documents()
    got = {r.doc_id: r for r in quality.score(cases.frame(spark, rows).withColumn("kept", F.lit(1))).where("doc_id >= 15 or source = 'host'").collect()}
    assert not any(got[i].kept for i in range(15)) and all(got[i].n_removed_words >= 8 * 10 for i in range(15))
    assert all(got[i].kept for i in (*range(100, 106), *range(110, 116))) and got[208].kept
    assert got[200].n_words == 0 and got[200].base_failed and got[206].base_failed and got[206].n_repeat_words == 500
    assert quality.score(cases.empty(spark)).count() == 0


def test_quality_removes_blocks_and_leaves_families_of_near_copies(spark):
    """A menu without a line of a page's own between its lines goes; pages keep their own lines."""
    rng = cases.random.Random(14)
    menu = "\n".join(f"Menu Entry{i} {' '.join(rng.choice(cases.WORDS) for _ in range(8))}" for i in range(8))
    rows = [(i, f"top {i}\n{menu.upper() if i % 2 else menu}\n{cases.prose(rng, 80)}", "en", "host", 1) for i in range(40)]
    rows += [(50 + i, f"{menu}\nown words {i} {cases.prose(rng, 25)}", "en", "host", 1) for i in range(5)]  # depleted
    base = cases.prose(rng, 150).split(" ")
    for i in range(40):  # near copies in another host, each with three changed words
        w = list(base)
        for k in rng.sample(range(len(w)), 3):
            w[k] = f"own{i}x{k}"
        rows.append((100 + i, " ".join(w), "en", "other", 1))
    rows += [(200 + i, rows[50][1], "en", "other", 1) for i in range(15)]  # copies
    got = {r.doc_id: r for r in quality.score(cases.frame(spark, rows)).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 8 * 10 and got[i].clean_text == "\n".join(x for x in r[1].split("\n") if "entry" not in x.lower()) for i, r in enumerate(rows[:40]))
    assert not any(got[50 + i].kept for i in range(5)) and all(not got[50 + i].base_failed for i in range(5))
    assert all(got[i].kept and got[i].n_removed_words == 0 and got[i].clean_text == t for i, t, *_ in rows if i >= 100)


def test_quality_limit_is_exact_without_families_and_no_block_hides(spark):
    """A line in 11 unrelated documents goes, in 10 it stays; a block of 48 long words on unrelated pages goes; copies
    of one text, changed in single words, are one document for each of their lines."""
    rng = cases.random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    page = lambda n: " ".join(word(rng.randint(2, 7)) for _ in range(n))
    rows = [(i, f"{page(70)}\nthe eleventh line\n{page(20)}", "en", "a", 1) for i in range(11)]
    rows += [(20 + i, f"{page(70)}\nthe tenth line\n{page(20)}", "en", "a", 1) for i in range(10)]
    block = " ".join(word(14) for _ in range(48))
    rows += [(100 + i, f"{page(40)}\n{block}\n{page(40)}", "en", "b", 1) for i in range(60)]
    base = [page(12) for _ in range(12)]
    for i in range(60):
        own = list(base)
        k = rng.randrange(12)
        own[k] = own[k].rsplit(" ", 1)[0] + f" own{i}"
        rows.append((200 + i, "\n".join(own), "en", "c", 1))
    got = {r.doc_id: r.n_removed_words for r in quality.score(cases.frame(spark, rows)).collect()}
    assert {got[i] for i in range(11)} == {3} and {got[20 + i] for i in range(10)} == {0}
    assert {got[100 + i] for i in range(60)} == {48} and {got[200 + i] for i in range(60)} == {0}


def test_quality_has_one_verdict_with_its_sql(spark, tmp_path):
    import duckdb

    from saccade.llm import queries

    rng = cases.random.Random(15)
    menu = "\n".join(f"\t Menu entry {i} of this site " for i in range(4))
    rows = cases.documents() + [(300 + i, f"{cases.prose(rng, 30)}\n{menu}\n{cases.prose(rng, 40)}", "en", f"s{i % 2}", 1) for i in range(30)]
    folder = cases.save(spark, tmp_path, rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = queries.op9_quality(spark, folder)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP9_SQL})").fetchall()
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_filtering_by_the_verdict_copies_no_expressions(spark):
    """What the verdict rests on is stored, so that a filter can't pull its expressions into the plan again."""
    scored = quality.score(cases.frame(spark))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (scored, scored.where("kept"))]
    assert plans[1].count("split(") <= plans[0].count("split(") <= 6


def test_quality_of_awkward_rows(spark):
    docs = cases.frame(spark).selectExpr("*", "1 AS clean_text", "2 AS _md5x", "3 AS N_WORDS")
    got = quality.score(docs)
    assert got.count() == len(cases.documents()) and got.columns.count("clean_text") == 1
    assert {r.doc_id for r in got.where("clean_text is null").collect()} == {200}


def test_quality_base_counts(spark):
    rows = [(1, "a b c a b c x\n#1 $2\n#1 $2\n \nA<b>", "en", "s", 1)]
    r = quality.with_base_counts(cases.frame(spark, rows)).first()
    words = brute.words(rows[0][1])
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), 6, 1)
    assert r.n_repeat_words == 6


def test_mix_follows_the_shares(spark):
    shares = {"s0": 5, "s1": 3, "s2": 1}
    rows = [(i, "t", "en", f"s{i % 3}", 1) for i in range(540)]
    got = mixing.mix(cases.frame(spark, rows).withColumn("slot", F.lit(1)), shares, block_size=4).orderBy("slot", "place").collect()
    assert len(got) == 540 and len({(r.slot, r.place) for r in got}) == 540
    plan = brute.schedule([5, 3, 1])
    order = [r.source for r in got if r.place == 0]
    assert order[:9] == [f"s{i}" for i in plan]
    done = {s: 0 for s in shares}
    for t, s in enumerate(order[:60], 1):  # no source has run out yet
        done[s] += 1
        assert all(abs(done[x] - t * shares[x] / 9) < 1 for x in shares)
    again = mixing.mix(cases.frame(spark, rows[::-1]).repartition(7), shares, block_size=4)
    assert rows_of(again, "doc_id", "slot", "place") == sorted(((r.doc_id, r.slot, r.place) for r in got), key=repr)


def test_slots_of_many_small_sources_fill_what_the_others_leave(spark):
    shares = {"a": 7, "b": 3, **{f"x{i}": 1 for i in range(12)}}
    table = spark.createDataFrame([(k, 10, v) for k, v in shares.items()], "_src string, n long, given long")
    got = {r._src: (r._period, r._slots) for r in mixing.slots(table, 0.5, 1000).collect()}
    period = sum(shares.values())
    assert all(p == period and len(s) == shares[k] for k, (p, s) in got.items())
    assert sorted(x for _, s in got.values() for x in s) == list(range(period))
    for k, (_, s) in got.items():
        for i, x in enumerate(s):
            assert i * period // shares[k] <= x < -(-(i + 1) * period // shares[k])
    only = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "_src string, n long, given long")
    assert sorted(r._slots for r in mixing.slots(only, 0.5, 1000).collect()) == [[0], [1]]


OWN_NAMES = ["_k1", "_src", "_share", "_period", "_slots", "_md5", "_host", "_text", "_f", "share", "period", "slots", "n", "term", "digest", "sig", "label", "item"]


@pytest.mark.parametrize("name", ["mix", "score", "dedup_lines", "decontaminate", "keep_one", "drop_repeats"])
def test_columns_with_names_of_the_operators_own(spark, name):
    rows = cases.documents()[:12] + cases.documents()[-6:]
    plain = cases.frame(spark, rows)
    docs = plain.selectExpr("*", *[f"doc_id + {i} AS {c}" for i, c in enumerate(OWN_NAMES)])
    bench = spark.createDataFrame([(1, "alpha1 beta2")], "item_id long, text string")
    run = {"mix": mixing.mix, "score": quality.score, "dedup_lines": line_dedup.dedup_lines, "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "keep_one": ngram_join.keep_one, "drop_repeats": substring_dedup.drop_repeats}[name]
    got, want = run(docs), run(plain)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert all(r[i + 1] == r[0] + i for r in got.where("doc_id is not null").select("doc_id", *OWN_NAMES).collect() for i in range(len(OWN_NAMES)))


def test_mix_keeps_awkward_rows(spark):
    rows = cases.documents()
    got = mixing.mix(cases.frame(spark))
    assert rows_of(got, "doc_id", "text", "source") == sorted(((r[0], r[1], r[3]) for r in rows), key=repr)
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert hashlib.md5(b"").hexdigest() and math.isfinite(got.agg(F.max("slot")).first()[0])
