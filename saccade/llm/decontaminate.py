"""Benchmark decontamination over a positional inverted index (DataFrame functions only).

Index: postings (term, document, position) of the corpus, stored as a table, for the terms that the
benchmark's windows are searched by. Each window of ``window`` item words is searched from its rarest
terms (by counts over the whole corpus): a posting's position less the term's place in the item is
the diagonal on which the window would lie, and only diagonals where the rarest terms' adjusted lists
meet go on. There the words of document and item are compared one by one, which gives exact phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccade.llm.common import among, ascii_lower, filter_of, private_names, row_key, shared_dir, stored, without

#: What stands between words (ASCII other than letters and digits).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the benchmark are broadcast up to so many bytes, and joined by shuffling beyond that.
BROADCAST_BYTES = 16 << 20
ADDED = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def word_list(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "")


def checked_broadcast(df: DataFrame, path: str) -> DataFrame:
    """df, stored, and marked for broadcast if its strings and numbers are small enough together."""
    kept = stored(df, path)
    cells = [F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(16) for c, t in kept.dtypes]
    total = kept.agg(F.sum(sum(cells, F.lit(0)))).first()[0] or 0
    return F.broadcast(kept) if total <= BROADCAST_BYTES else kept


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) of the items with words, once for equal rows."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), ascii_lower(F.col(text)).alias("_t"))
    return rows.select("item", word_list("_t").alias("words")).where(F.size("words") > 0).distinct().withColumn("_i", F.xxhash64("item", "words"))


def _terms(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    rows = docs.select(*keys, F.posexplode(word_list(text)).alias("pos", "_w"))
    return rows.select(*keys, "pos", ascii_lower(F.col("_w")).alias("term"))


def search_terms(docs: DataFrame, items: DataFrame, path: str, window: int, rarest: int, text: str, whole: bool = True) -> DataFrame:
    """(_i, ipos, term, need): the places of items that windows are searched by, and how many of them a
    diagonal must show for this item: those of its windows' rarest terms, counted in the whole corpus.
    whole: windows with a term that the corpus doesn't have aren't searched; else their other terms are."""
    places = items.select("_i", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "term"))
    vocabulary = checked_broadcast(places.select("term").distinct(), f"{path}/vocabulary")
    counts = _terms(docs, text).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    counts = stored(counts, f"{path}/counts")
    placed = places.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    k = F.least(F.col("n"), F.lit(window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - k + 1), F.least(F.col("ipos"), F.col("n") - k))).alias("start")
    ranked = (placed if whole else placed.where("df > 0")).select("_i", "n", "ipos", "term", "df", k.alias("k"), starts)
    order = Window.partitionBy("_i", "start").orderBy("df", "term", "ipos")
    least = F.min("df").over(Window.partitionBy("_i", "start"))
    ranked = ranked.withColumn("r", F.row_number().over(order)).withColumn("least", least)
    return ranked.where((F.col("r") <= rarest) & (F.col("least") > 0)).select("_i", "ipos", "term", F.least("k", F.lit(rarest)).alias("need")).distinct()


def diagonals(docs: DataFrame, searched: DataFrame, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The stored index (term, _k1, _k2, pos), and (_k1, _k2, _i, diag, got) where enough terms meet."""
    terms = checked_broadcast(searched.select("term").distinct(), f"{path}/terms")
    index = stored(_terms(docs, text, "_k1", "_k2").join(terms, "term").select("term", "_k1", "_k2", "pos"), f"{path}/index")
    met = index.join(checked_broadcast(searched, f"{path}/searched"), "term")
    lists = met.groupBy("_k1", "_k2", "_i", (F.col("pos") - F.col("ipos")).alias("diag"), "need").agg(F.countDistinct("ipos").alias("got"))
    return index, lists.where("got >= need").select("_k1", "_k2", "_i", "diag")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, rarest: int = 3, item: str = "item_id", text: str = "text") -> DataFrame:
    """(_k1, _k2, item, first, last): documents (by the hashes of their rows) and the places, counted in
    words from 0, of the item windows that they hold. docs has the keys as columns."""
    path = shared_dir(docs.sparkSession)
    items = stored(items_of(benchmark, item, text), f"{path}/items")
    searched = search_terms(docs, items, path, window, rarest, text)
    _, found = diagonals(docs, searched, path, text)
    found = found.join(checked_broadcast(items, f"{path}/search-items"), "_i")
    # before the document's first word the item's words can't match; cut them off here
    cut = F.greatest(F.lit(0), -F.col("diag"))
    m = F.size("words")
    found = found.select("_k1", "_k2", F.greatest("diag", F.lit(0)).alias("at"), "item", F.slice("words", cut + 1, F.greatest(m - cut, F.lit(0))).alias("words"), F.least(m, F.lit(window)).alias("k"))
    found = stored(found.distinct(), f"{path}/diagonals")
    texts = texts_of(docs, found, text, path)
    rows = found.join(texts, ["_k1", "_k2"])
    same = F.zip_with("words", F.slice("_w", F.col("at") + 1, F.size("words")), lambda a, b: a.eqNullSafe(b))
    rows = rows.where(F.size("_w") > 0).select("_k1", "_k2", "item", "at", "k", same.alias("same")).where(F.size("same") >= F.col("k"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("k")), lambda s: F.forall(F.slice(F.col("same"), s + 1, F.col("k")), lambda x: x))
    rows = rows.select("_k1", "_k2", "item", "at", "k", F.explode(starts).alias("s"))
    return rows.select("_k1", "_k2", "item", (F.col("at") + F.col("s")).alias("first"), (F.col("at") + F.col("s") + F.col("k") - 1).alias("last")).distinct()


def texts_of(docs: DataFrame, found: DataFrame, text: str, path: str) -> DataFrame:
    """(_k1, _k2, _w), the words of the documents found, stored. A Bloom filter of the keys found, of set
    size, lets few other texts through, so that the join need not move the corpus."""
    keys = found.select("_k1").distinct()
    near = among(docs.select("_k1", "_k2", F.col(text).alias("_t")), "_k1", filter_of(keys, f"{path}/bits"))
    near = near.join(keys, "_k1", "left_semi").select("_k1", "_k2", ascii_lower(F.col("_t")).alias("_t")).dropDuplicates(["_k1", "_k2"])
    return stored(near.select("_k1", "_k2", word_list("_t").alias("_w")), f"{path}/texts")


@private_names
def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, rarest: int = 3, slack: int = 8, share: float = 0.5, item: str = "item_id", text: str = "text") -> DataFrame:
    """docs' rows with item and near: items of which at least ``share`` of the searched places lie on
    diagonals less than ``slack`` words apart, so that words may be inserted, dropped or replaced. near is
    that share, for the best such band of diagonals.

    Null and empty texts and items have no words and match nothing; an item counts once a row, with its
    best band; repeated rows are matched each; columns named item or near are replaced; empty tables
    give no rows."""
    docs = without(docs, "item", "near")
    keyed = docs.select("*", *row_key(*docs.columns))
    path = shared_dir(docs.sparkSession)
    items = stored(items_of(benchmark, item, text), f"{path}/items")
    searched = stored(search_terms(keyed, items, path, window, rarest, text, whole=False), f"{path}/places")
    index, _ = diagonals(keyed, searched, path, text)
    met = index.join(checked_broadcast(searched, f"{path}/searched-near"), "term").withColumn("diag", F.col("pos") - F.col("ipos"))
    bands = F.explode(F.array_distinct(F.array(F.floor(F.col("diag") / slack), F.floor((F.col("diag") + slack / 2) / slack) + F.lit(0.5)))).alias("band")
    near = met.select("_k1", "_k2", "_i", "ipos", bands).groupBy("_k1", "_k2", "_i", "band").agg(F.countDistinct("ipos").alias("n"))
    places = searched.groupBy("_i").agg(F.countDistinct("ipos").alias("all"))
    near = near.join(places, "_i").where(F.col("n") >= F.lit(share) * F.col("all")).groupBy("_k1", "_k2", "_i").agg(F.max(F.col("n") / F.col("all")).alias("near"))
    named = near.join(items.select("_i", "item"), "_i").select("_k1", "_k2", "item", "near")
    named = named.groupBy("_k1", "_k2", "item").agg(F.max("near").alias("near"))
    return keyed.join(named, ["_k1", "_k2"]).select(*docs.columns, "item", "near")


@private_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, rarest: int = 3, share: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), n_items, items (sorted ids, as
    strings, of items with a window found) and contaminated (n_hit > 0 and share * n_hit >= n_words).

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case. A
    window is ``window`` words of an item, or the whole item if it is shorter. Null texts have no
    words; null item ids are left out of items. Equal rows get equal results; columns of the names
    above are replaced; empty tables give no hits.
    """
    docs = without(docs, *ADDED)
    keyed = docs.select("*", *row_key(*docs.columns))
    found = matches(keyed, benchmark, window, rarest, item, text)
    sums = found.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("_spans"), F.sort_array(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate("_spans", start, lambda a, s: F.struct(F.greatest(a["end"], s["last"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"] - 1))).alias("n")), lambda a: a["n"])
    sums = sums.select("_k1", "_k2", hit.alias("n_hit"), "items")
    rows = keyed.withColumn("n_words", F.size(word_list(text)).cast("long")).join(sums, ["_k1", "_k2"], "left")
    none = F.array().cast("array<string>")
    rows = rows.select(*docs.columns, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    rows = rows.withColumn("n_items", F.size("items").cast("long"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
