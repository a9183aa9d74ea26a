import numpy as np
import pytest

from tests.llm import brute, cases

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from saccade.llm import mixing
    from saccade.llm.queries import tokenizer_path

    rows = [r for r in dict.fromkeys(cases.documents(n=60))]
    text = {r[0]: r[1] for r in rows}
    items = [(1, " ".join(text[120].split()[45:75]))]
    folder = cases.save(spark, tmp_path, rows, items)
    got = pipeline.run(spark, folder).orderBy("start").collect()

    plain = lambda x: x.lower().translate(str.maketrans("\t\x0b\x0c\r", "    ")).strip(" ")
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders.setdefault((r[3], plain(line)), set()).add(r[1])
    common = {k for k, v in holders.items() if len(v) > 10 and k[1]}
    assert ("s2", "shared boilerplate line here") in common

    kept, removed = [], 0
    for r in rows:
        w = brute.words(r[1])
        lines = (r[1] or "").split("\n")
        text[r[0]] = "\n".join(x for x in lines if (r[3], plain(x)) not in common) if r[1] else r[1]
        left = len(brute.words(text[r[0]]))
        removed += left < len(w)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in range(i, i + 3)} if len(w) < 2000 else set()
        if len(w) >= 50 and 100 * len(hit) <= 50 * len(w) and left >= 50 and left >= 0.3 * len(w):
            kept.append((r[0], text[r[0]], r[2], r[3], len(text[r[0]])))
    assert removed >= 12
    comp = brute.components([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r, c in zip(kept, comp, strict=True) if r[0] == c[1]]
    clean = [r for r, (n, hit, _) in zip(kept, brute.contamination([r[1] for r in kept], items), strict=True) if not (hit and 20 * hit >= n)]
    assert 120 in {r[0] for r in kept} and 120 not in {r[0] for r in clean}
    assert sorted(g.doc_id for g in got) == sorted(r[0] for r in clean)

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start = 0
    for g in got:
        ids = [*library.encode(text[g.doc_id], add_special_tokens=False).ids, 2]
        assert g.start == start and np.array_equal(g.token_ids, ids)
        start += len(ids)
    order = [r.doc_id for r in mixing.mix(cases.frame(spark, clean)).orderBy("slot", "place").collect()]
    assert [g.doc_id for g in got] == order


def test_stages_keep_the_columns_and_take_no_rows(spark, tmp_path):
    folder = cases.save(spark, tmp_path, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert pipeline.run(spark, folder).count() == 0
