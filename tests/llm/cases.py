"""Small documents with the awkward cases in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randint(0, 30)))
        if i % 12 == 11:
            out[-1] += ".\n" if rng.random() < 0.4 else "."
    return " ".join(out).replace("\n ", "\n")


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(rng, rng.choice([5, 60, 90, 200])), "en", f"s{i % 3}"))
    base = prose(rng, 120)
    rows += [(100 + i, base, "en", "s0") for i in range(6)]  # copies
    for i in range(6):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((110 + i, " ".join(w), "en", "s0"))
    passage = prose(rng, 70)
    rows += [(120 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "en", "s1") for i in range(3)]
    rows += [(130 + i, f"Shared boilerplate line here\n{prose(rng, 70)}\n  SHARED boilerplate LINE here \t", "en", "s2") for i in range(12)]
    rows += [
        (200, None, None, None), (201, "", "en", "s1"), (202, " \t\n ", "en", None), (203, "one", "en", "s1"), (204, "one", "en", "s1"),
        (205, "Ünïcode ÉTÉ straße 中文 😀 a\x00b", "xx", "s1"), (206, "ha " * 500, "en", "s1"), (207, "x" * 20_000, "en", "s1"), (208, prose(rng, 6000), "en", "s1"),
        (None, "no key at all but some words", "en", "s1"), (209, "\n\n\n", "en", "s1"),
    ]
    rows.append(rows[3])  # a repeated row
    rows.append(rows[3])
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(spark, folder, rows=None, benchmark=None, labels=None) -> str:
    """A folder of tables as the queries expect it."""
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark or [(1, "alpha1 beta2"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)
