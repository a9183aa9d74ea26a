"""Quality rules from line frequencies across documents (DataFrame functions only).

Lines that very many documents of one host carry are boilerplate. Normalised lines are hashed, distinct
documents are counted for each host and line, lines above the limit are removed, and a document that
keeps too little is rejected.

Copies must not look like boilerplate. Documents with equal texts count once. Near copies count once too:
each document with a line above the limit is compared with one of them (the hub) by the least hashes of
their words, a sample of what they have in common that no shared block can fill. Those like the hub are one
document; the line stays if that one and the others are within the limit. An eighth of the hub's family
is taken off the others, for copies that the sketch misses. Without a family the count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import SPACES, among, filter_of, private_names, shared_dir, stored, without

SYMBOLS = r"[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*BASE, "n_removed_words", "base_failed", "kept", "clean_text"]
#: Hashes in a sketch. Sketches that share four fifths of the longer one are of near copies.
SKETCH = 32


def _size(a: Column) -> Column:
    return F.size(a).cast("long")


def _spaced(text: Column) -> Column:
    """White space other than newlines as spaces."""
    for c in SPACES:
        if c not in " \n":
            text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(text: Column) -> Column:
    """Words of a text without white space other than spaces."""
    return F.array_remove(F.split(text, " "), "")


def _keys(text: Column) -> Column:
    """The normalised form of each line: white space as spaces, stripped, in lower case."""
    return F.transform(F.split(_spaced(F.lower(text)), "\n"), lambda x: F.trim(x))


def _counted(docs: DataFrame, columns: list[Column], text: str) -> DataFrame:
    """The columns, _w (words), and the base counts but n_repeat_words; _t: hashes of the 3-word windows."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    cells = docs.select(*columns, t.alias("_text"), _words(F.replace(_spaced(t), F.lit("\n"), F.lit(" "))).alias("_w"), lines.alias("_l"))
    n = F.greatest(F.size("_w") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice("_w", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    return cells.select(
        "*",
        _size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows.alias("_t"),
    )


def _repeats(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and n_repeat_words, from _t. Linear in the text but for one sort of its windows."""
    some = F.size("_t") > F.size(F.array_distinct("_t"))
    ordered = F.sort_array(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cells = cells.select(*columns, F.when(some, ordered).alias("_s"))
    same = F.zip_with(F.col("_s.h"), F.slice(F.col("_s.h"), F.lit(2), F.size("_s")), lambda a, b: a.eqNullSafe(b))
    cells = cells.select("*", same.alias("_n"))
    twice = F.zip_with("_n", F.concat(F.array(F.lit(False)), F.slice("_n", F.lit(1), F.size("_n") - 1)), lambda a, b: a | b)
    places = F.sort_array(F.filter(F.zip_with(twice, F.col("_s.i"), lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return cells.select(*columns, F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


@private_names
def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line) and n_repeat_words (words inside 3-word windows that occur twice or
    more in the text), all long. Null text: zeros. Columns of these names are replaced."""
    docs = without(docs, *BASE)
    return _repeats(_counted(docs, [F.col(c) for c in docs.columns], text), [*docs.columns, *BASE[:4]])


def content_key(host: str, text: str) -> list[Column]:
    named = F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("none")).alias("_host")
    return [named, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_md5")]


def contents(docs: DataFrame, host: str, text: str) -> DataFrame:
    """A row for each different text of a host: its base counts, its lines with a word (hash, number of
    words) and its sketch: the least md5 sums of its words."""
    cells = _counted(docs, content_key(host, text), text)
    keys = F.filter(_keys(F.col("_text")), lambda x: x != "")
    lines = F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(_words(x)).alias("w")))
    least = F.slice(F.sort_array(F.transform(F.array_distinct("_w"), F.md5)), 1, SKETCH)
    sketch = F.transform(least, lambda x: F.xxhash64(x))
    kept = ["_host", "_md5", *BASE[:4]]
    rows = _repeats(cells.select(*kept, "_t", lines.alias("_lines"), sketch.alias("_sketch")), [*kept, "_lines", "_sketch"])
    return rows.dropDuplicates(["_host", "_md5"]).withColumn("_c", F.xxhash64("_md5"))


def frequent_lines(rows: DataFrame, max_docs: int, path: str) -> DataFrame:
    """(_host, _h) of the lines above the limit, from contents(): more than max_docs different documents
    of the host have them, where those that look like copies of one of them count once."""
    hashes = F.explode(F.array_distinct("_lines.h")).alias("_h")
    many = rows.select("_host", hashes).groupBy("_host", "_h").agg(F.count("*").alias("_docs")).where(F.col("_docs") > max_docs)
    many = stored(many, f"{path}/many")
    held = among(rows.select("_host", "_c", hashes), "_h", filter_of(many.select("_h").distinct(), f"{path}/many-bits"))
    held = held.join(many, ["_host", "_h"])
    held = held.join(rows.select("_host", "_c", "_md5", "_sketch"), ["_host", "_c"])
    held = stored(held, f"{path}/held")
    hubs = stored(held.groupBy("_host", "_h").agg(F.min(F.struct("_md5", "_sketch")).alias("_hub")), f"{path}/hubs")  # stored, so that the join can split frequent lines
    pairs = held.join(hubs, ["_host", "_h"])
    common, longer = F.size(F.array_intersect("_sketch", "_hub._sketch")), F.greatest(F.size("_sketch"), F.size("_hub._sketch"))
    others = pairs.where(common * 5 < longer * 4).groupBy("_host", "_h", "_docs").agg(F.count("*").alias("_others"))
    family = F.col("_docs") - F.col("_others")
    return others.where((F.col("_others") + 1 - max_docs) * 8 > family - 1).select("_host", "_h")


@private_names
def score(docs: DataFrame, max_docs: int = 10, min_words: int = 50, min_left: float = 0.3, max_repeat: float = 0.5, host: str = "source", text: str = "text") -> DataFrame:
    """docs with the base counts, n_removed_words (words of lines above the limit), base_failed (n_words
    < min_words, or more than max_repeat of the words in repeated windows), kept (not base_failed, and
    not depleted: at least min_words words and the share min_left of them stay) and clean_text (the text
    without the lines above the limit).

    Null or empty texts have no words and fail; their clean_text is as they are. A null host is a host
    of its own. Repeated rows get equal verdicts. Very long texts are counted whole. Columns with these
    names are replaced; an empty table gives an empty table. Hosts all of whose pages are nearly equal
    count as families of copies.
    """
    base = shared_dir(docs.sparkSession)
    docs = without(docs, *ADDED)
    rows = stored(contents(docs, host, text), f"{base}/contents")
    frequent = stored(frequent_lines(rows, max_docs, base), f"{base}/frequent")
    each = rows.select("_host", "_c", F.explode("_lines").alias("_line")).select("_host", "_c", F.col("_line.h").alias("_h"), F.col("_line.w").alias("_n"))
    each = among(each, "_h", filter_of(frequent.select("_h").distinct(), f"{base}/bits"))
    gone = each.join(frequent, ["_host", "_h"]).groupBy("_host", "_c").agg(F.sum("_n").alias("_removed"), F.collect_set("_h").alias("_gone"))
    verdict = rows.select("_host", "_c", "_md5", *BASE).join(gone, ["_host", "_c"], "left")
    verdict = verdict.select("_host", "_md5", "_gone", *BASE, F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.lit(int(max_repeat * 100)) * F.col("n_words"))
    verdict = verdict.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_words) & (left >= F.lit(min_left) * F.col("n_words")))
    joined = docs.select("*", *content_key(host, text)).join(stored(verdict, f"{base}/verdicts"), ["_host", "_md5"])
    stay = F.filter(F.arrays_zip(F.split(F.col(text), "\n").alias("line"), _keys(F.col(text)).alias("key")), lambda x: ~F.array_contains("_gone", F.xxhash64(x["key"])))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(stay["line"], "\n"))
    return joined.select(*docs.columns, *ADDED[:-1], clean.alias("clean_text"))
