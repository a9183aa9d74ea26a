import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.llm import sharding, token_counts, token_output, toxicity
from saccade.llm.queries import tokenizer_path
from tests.llm import cases


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [r for r in cases.documents() if r[0] is not None] + [(300, "a <|endoftext|> b 'S <|", "en", "s", 1), (301, "ΑΣ İx́ \x1c\x85 it's", "en", "s", 1)]
    rows = sorted(set(rows), key=lambda r: r[0])
    for encoding in ("dictionary", "delta"):
        path = str(tmp_path / encoding)
        token_output.write_tokens(cases.frame(spark, rows).repartition(5), path, tokenizer_path("word_bpe_49k.json"), encoding=encoding)
        got = token_output.read_tokens(spark, path).withColumn("crc", token_output.ids_crc32("token_ids")).orderBy("doc_id").collect()
        start = 0
        for r, g in zip(rows, got, strict=True):
            ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
            assert (g.doc_id, g.start, g.n_tokens, g.token_ids) == (r[0], start, len(ids), ids)
            assert g.crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    assert "token_ids" not in token_output.read_tokens(spark, path, ["doc_id"]).columns


def library_ids(library, text):
    return [*library.encode(text, add_special_tokens=False).ids, 2]


def encoded(texts):
    ids, sizes = token_output.encoder(tokenizer_path("word_bpe_49k.json")).encode(texts, 2)
    ends = np.cumsum(sizes)
    assert len(ids) == (ends[-1] if len(ends) else 0)
    return [ids[z - n : z].tolist() for z, n in zip(ends, sizes, strict=True)]


def test_ids_are_the_librarys_for_every_code_point():
    """Beside letters, digits, symbols and endings of verbs, to the last code point."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 8000):
        part = points[a : a + 8000]
        texts = [f"a{c}b {c} {c}1{c} !{c}? {c}'ll {c}{c}" for c in part] if a < 0x34000 or a >= 0xE0000 else ["".join(f"a{c}b {c}1 !{c}? {c}'ll " for c in part[i : i + 40]) for i in range(0, len(part), 40)]
        want = library.encode_batch_fast(texts, add_special_tokens=False)
        assert encoded(texts) == [[*w.ids, 2] for w in want]


def test_ids_are_the_librarys_for_random_texts(monkeypatch):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), cases.random.Random(3)
    alphabet = "ab'stvelmdr 12\n\t.,!\"éİƁΑΣσ中😀\u0301\u00a0 \x1c\x85-"
    for least in (1_000_000, 5):  # with so few entries the cache starts anew for each call
        monkeypatch.setattr(token_output, "KEPT", least)
        for _ in range(10):
            texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
            texts += ["a <|endoftext|> b", "", "x" * 5000, "'s't 'Street ''s"]
            assert encoded(texts) == [library_ids(library, t) for t in texts]
    assert encoded([]) == []


def test_token_files_have_the_encoding_groups_and_pages_asked_for(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, cases.prose(cases.random.Random(i), 300)) for i in range(400)], "doc_id long, text string").coalesce(1)
    for encoding in ("dictionary", "delta"):
        path = str(tmp_path / encoding)
        token_output.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), encoding=encoding, row_group_bytes=1 << 18, page_bytes=1 << 14)
        (file,) = (tmp_path / encoding).glob("*.parquet")
        meta = pq.ParquetFile(file).metadata
        column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("token_ids"))
        assert meta.num_row_groups > 1 and column.has_offset_index and column.has_column_index
        assert any(("DELTA" if encoding == "delta" else "DICTIONARY") in e for e in column.encodings)


def test_token_files_of_columns_named_like_the_formats_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, part string, n_tokens int")
    token_output.write_tokens(docs, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"), keep=["doc_id", "part", "n_tokens"])
    (row,) = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    assert (row.doc_id, row.start, row.n_tokens) == (1, 0, 3)


def test_token_files_of_no_and_of_equal_rows(spark, tmp_path):
    token_output.write_tokens(cases.empty(spark), str(tmp_path / "none"), tokenizer_path("word_bpe_49k.json"))
    assert token_output.read_tokens(spark, str(tmp_path / "none")).count() == 0
    token_output.write_tokens(cases.frame(spark), str(tmp_path / "all"), tokenizer_path("word_bpe_49k.json"), keep=["doc_id", "source"])
    got = token_output.read_tokens(spark, str(tmp_path / "all"))
    assert got.count() == len(cases.documents())
    ends = got.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert ends[0] == ends[1]


def test_token_counts_match_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = cases.documents() + [(300, "▁a  b <s> </s> ▁", "en", "s", 1), (301, "   ", "en", "s", 1)]
    for table in (None, (b"", b"")):
        got = token_counts.count_tokens(cases.frame(spark, rows).withColumn("n_tokens", F.lit("x")), tokenizer_path("piece_bpe_32k.model"), limit=100, table=table)
        want = sorted(((r[0], len((r[1] or "").encode()), n, n > 100) for r in rows for n in [len(model.encode(r[1] or ""))]), key=repr)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr) == want
    assert token_counts.count_tokens(cases.empty(spark), tokenizer_path("piece_bpe_32k.model")).count() == 0
    plan = token_counts.count_tokens(cases.frame(spark).repartition(3), tokenizer_path("piece_bpe_32k.model"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the input alone


def test_counts_are_the_librarys_for_random_texts():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, rng = sentencepiece.SentencePieceProcessor(model_file=path), cases.random.Random(5)
    counter = token_counts.Counter(path, token_counts.frequent_table(path))
    pieces = [*"ab \t\n.,é中😀▁\u0301\u00a0", "  ", "the ", " of", "<s>", "</s>", "Anblewh", "\x00"]
    for _ in range(20):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(500)]
        assert counter.count(texts).tolist() == [len(model.encode(t)) for t in texts]


def test_shards_keep_every_row_and_old_versions(spark, tmp_path):
    docs = cases.frame(spark)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, fanout=2)
    for a in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == a).coalesce(1))
    before = store.version()
    small = len(store.manifest()["shards"])
    after = store.compact()
    assert after > before and len(store.manifest()["shards"]) < small
    want = sorted(map(tuple, docs.collect()), key=repr)
    assert sorted((tuple(r) for r in store.read().drop("_shard").collect()), key=repr) == want
    assert sorted((tuple(r) for r in store.read(before).drop("_shard").collect()), key=repr) == want
    tiers = [store.tier(s["bytes"]) for s in store.manifest()["shards"]]
    assert all(t == 0 or tiers.count(t) < 2 for t in tiers)
    store.vacuum()
    assert store.read().count() == len(want)
    with pytest.raises(ValueError, match="no version"):
        store.read(before)


def test_shards_of_awkward_tables(spark, tmp_path):
    store = sharding.shard(cases.frame(spark).selectExpr("*", "'mine' AS _shard"), f"file://{tmp_path}/own", arrivals=2)
    rows = store.read().collect()
    assert len(rows) == len(cases.documents()) and all("/" in r._shard for r in rows)
    assert {len(r.text or "") for r in rows} == {len(r[1] or "") for r in cases.documents()}
    assert sharding.shard(cases.empty(spark), f"file://{tmp_path}/none", arrivals=2).read().columns[:5] == cases.frame(spark).columns


def test_a_slower_writer_is_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(cases.empty(spark))
    with pytest.raises(sharding.ConflictError):
        store.commit(0, [])
    assert store.version() == 1 and store.read().count() == 0


def toxic_documents(n=400, seed=2):
    rng = cases.random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = cases.prose(rng, 60).split(" ")
        for _ in range(6 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["moronic", "scumbag", "grobian" + rng.choice(["en", "er", "isch"])]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_from_its_fold_alone(spark):
    rows, labels = toxic_documents()
    docs = cases.frame(spark, rows + [r for r in cases.documents() if r[0] is None or r[0] >= 200])
    folds = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    flipped = [(i, q, 1 - t if folds[i] else t) for i, q, t in labels]  # labels of the held-out fold must not matter
    model = toxicity.train(docs, spark.createDataFrame(labels + [(None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int"))
    assert model == toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == f for i, f in folds.items())
    held = [i for i, f in folds.items() if f]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[200].score == got[201].score < 0.5 and got[None].predicted == 0
    assert toxicity.score(cases.empty(spark), model).count() == 0


def test_toxicity_without_labels_scores_everything_alike(spark):
    model = toxicity.train(cases.frame(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(cases.frame(spark), model)
    assert got.count() == len(cases.documents()) and got.select("score").distinct().count() == 1


def test_the_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 5.5, "grob*": 2.5})

    def matched(text):
        return g.features(text)[0]

    def bare(text):
        return g.features(text)[2]

    assert matched("you are an idiot.") > matched("you are no idiot.") > 0 == bare("you are an idiot.")
    assert matched("idiot, listen to them") > 0 == matched("that was some idiot. you know") < bare("that was some idiot. you know")
    assert matched("they are grobian") < matched("they are an idiot") > matched("they are an idiot, she said") > 0
    assert matched("i will kill you") > 0 and matched("we are killing them") > 0 and g.features("i will never kill you") == g.features("kill") == g.features("nothing here") == (0, 0, 0, 0)


def patterns(symbols):
    """(matched, bare) of each clause, from the rules as they are told."""
    t, out, clause = toxicity, [], []
    for s in [*symbols, t.END]:
        if s != t.END:
            clause.append(s)
            continue
        own = [i for i, x in enumerate(clause) if x in t.INSULTS]
        near = lambda i, what, reach: any(x == what for x in clause[max(0, i - reach) : i])  # noqa: E731, B023
        matched = bare = 0.0
        for i, j in zip(own, [*own, len(clause)][1:], strict=True):
            w = t.LEVELS[t.INSULTS.index(clause[i])] * (t.NEGATED if near(i, t.NEGATION, t.NEG_REACH) else 1)
            if near(i, t.TARGET, t.TARGET_REACH) or t.TARGET in clause[i + 1 : min(j, i + 1 + t.INSULT_REACH)]:
                matched += w
            else:
                bare += w
        waiting = None
        for i, x in enumerate(clause):
            if x == t.THREAT and not near(i, t.NEGATION, t.NEG_REACH):
                waiting = i
            elif x == t.TARGET and waiting is not None and i - waiting <= t.THREAT_REACH:
                matched, waiting = matched + t.THREAT_WEIGHT, None
        if matched or bare:
            share = t.REPORTED if t.REPORT in clause else 1.0
            out.append((matched * share, bare * share))
        clause = []
    return out


def test_the_composed_automaton_is_its_patterns():
    rng = cases.random.Random(7)
    after, weights = toxicity.automaton()
    assert len(after) == len(weights) and max(after) < len(after) and len(after) > 1000
    for _ in range(4000):
        symbols = rng.choices(toxicity.ALPHABET, [6, 1, 2, 1, 0.3, 1.5, 1, 1, 1], k=rng.randint(0, 40))
        got, want = list(toxicity.clause_weights(symbols)), patterns(symbols)
        assert len(got) == len(want) and all(abs(a - c) + abs(b - d) < 1e-9 for (a, b), (c, d) in zip(got, want, strict=True)), symbols


def test_scores_are_the_models_of_the_patterns(spark):
    """The query's parts once more, without the automaton or Spark."""
    rows, labels = toxic_documents(n=120)
    docs = cases.frame(spark, rows).withColumn("score", F.lit("x"))
    weights, b = toxicity.train(docs.drop("score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    grammar = toxicity.Grammar(weights)
    for r in toxicity.score(docs, (weights, b)).collect():
        tokens = toxicity._tokens(r.text.lower())
        found = [(0.0, 0.0), *patterns([grammar.symbol(t) for t in tokens])]
        m, n = (sum(x[i] for x in found) for i in (0, 1))
        x = [math.log1p(v) for v in (m, max(v for v, _ in found), n, 100 * (m + n) / len(tokens))]
        assert abs(r.score - 1 / (1 + math.exp(-sum(p * q for p, q in zip([*x, 1.0], b, strict=True))))) < 1e-9
        assert r.predicted == int(r.score >= 0.5)
