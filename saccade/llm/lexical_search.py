"""Ranked lexical search over ranges of documents.

The corpus is read once: tasks count the queries' terms in their documents and write an index, a row for
each range of up to 4,096 documents. Term weights follow from its sums. Then each range gets, for each
term, a tree of maxima: blocks of 16 documents, of 16 blocks, and so on up to the range. A query's bound
for a node is the sum of its terms' maxima there. Best first, the node of the highest bound is opened;
documents come out in order of score, after all nodes of an equal bound have been opened, so that ties
are decided by key. A task carries each query's least score that still counts from range to range, so
most ranges end at their root. The tasks' best documents are ranked together at last.

Queries are a stated set: they are taken in blocks of a bounded size, each against all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from saccade.llm.common import discard, private_names, row_key, shared_dir, stored

#: Terms over UTF-8 bytes: digits, letters and everything beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Children of a node, as bits; levels of nodes over the documents of a range.
BITS, LEVELS = 4, 3
RANGE = 1 << BITS * LEVELS
#: Bytes of a text that are taken apart at a time; postings after which a range ends early; bytes of queries a block.
PIECE, POSTINGS, QUERY_BYTES = 1 << 20, 1 << 20, 1 << 22
INDEX = "n_docs long, n_terms long, keys array<long>, lengths array<long>, sizes array<int>, terms array<int>, tfs array<int>, df_term array<int>, df array<int>"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z lower-cased, in lists of about a piece each."""
    data = text.encode().lower()  # lowers ASCII only
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and (m := TERM.match(data, end)):
            end = m.end()
        yield TERM.findall(data, at, min(end, len(data)))
        at = end


def _counted(text: str | None, number: dict[bytes, int]) -> tuple[int, list[tuple[int, int]]]:
    """(terms with repeats, (number, occurrences) of the terms that have numbers) of a text"""
    n, tf = 0, Counter()
    for part in terms_of(text or ""):
        n += len(part)
        tf.update(part)
    return n, sorted((number[t], c) for t, c in tf.items() if t in number)


def index_of(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """A row for each range of documents (_key, _text): how many have a term, all their terms, and for those with a
    numbered term key, length, and the terms and their occurrences; df of each term in the range."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            terms = np.concatenate([np.array(x, "i4").reshape(-1, 2) for x in found]) if found else np.empty((0, 2), "i4")
            which, df = np.unique(terms[:, 0], return_counts=True)
            cells = [[n_docs], [n_terms], [keys], [lengths], [[len(x) for x in found]], [terms[:, 0]], [terms[:, 1]], [which], [df.astype("i4")]]
            kinds = [pa.int64(), pa.int64(), *(pa.list_(k) for k in (pa.int64(), pa.int64(), *[pa.int32()] * 5))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

        n_docs = n_terms = postings = 0
        keys, lengths, found = [], [], []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                n, own = _counted(text.as_py(), number)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if own:
                    keys.append(key.as_py())
                    lengths.append(n)
                    found.append(own)
                    postings += len(own)
                    if len(found) == RANGE or postings > POSTINGS:
                        yield row()
                        n_docs = n_terms = postings = 0
                        keys, lengths, found = [], [], []
        if n_docs:
            yield row()

    return docs.select("_key", "_text").mapInArrow(take, INDEX)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """w * ((10**9 * tf) div (1000 * tf + 8 * m)), m growing with the document's length, in whole numbers"""
    wide = object if 90 * int(length.max(initial=0)) * n_docs >= 1 << 63 else "i8"
    m = 100 - 90 + 90 * length.astype(wide) * n_docs // n_terms
    return (w * (10**9 * tf // (1000 * tf + 8 * m))).astype("i8")


class MaxTree:
    """For each term of a range a tree of maxima over its documents. Level 0 holds the postings, by term and
    document; an entry of level l + 1 stands for its term's entries of level l in one node of 16."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, values: np.ndarray):
        order = np.lexsort((docs, terms))
        term, node, value = terms[order], docs[order], values[order]
        self.node, self.value, self.start = [node], [value], [None]
        for _ in range(LEVELS):
            node = node >> BITS
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (node[1:] != node[:-1]))) if len(term) else np.empty(0, "i8")
            value = np.maximum.reduceat(value, first) if len(first) else value
            self.start.append(np.append(first, len(term)))
            term, node = term[first], node[first]
            self.node.append(node)
            self.value.append(value)
        self.term = term  # one entry a term at the root

    def roots(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.term, terms)
        there = at < len(self.term)
        there[there] = self.term[at[there]] == terms[there]
        return at[there]

    def opened(self, level: int, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(node or document, bound or score, entries) of the children of a node, given by its entries."""
        start = self.start[level]
        lo, n = start[entries], start[entries + 1] - start[entries]
        below = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        nodes = self.node[level - 1][below]
        order = np.argsort(nodes, kind="stable")
        below, nodes = below[order], nodes[order]
        cut = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        sums = np.add.reduceat(self.value[level - 1][below], cut)
        return zip(nodes[cut].tolist(), sums.tolist(), np.split(below, cut[1:]), strict=True)

    def best(self, terms: np.ndarray, k: int, keys: list[int], least: int) -> list[tuple[int, int]]:
        """The k documents of the highest scores, as (-score, key), equal scores by key; none below least."""
        roots = self.roots(terms)
        heap = [(-int(self.value[LEVELS][roots].sum()), 0, 0, LEVELS, roots)] if len(roots) else []
        found, made = [], 0
        while heap and len(found) < k and -heap[0][0] >= least:
            bound, kind, key, level, entries = heapq.heappop(heap)
            if kind:
                found.append((bound, key))
                continue
            for node, value, own in self.opened(level, entries):
                if value >= least:
                    made += 1
                    heapq.heappush(heap, (-value, 1, keys[node], made, None) if level == 1 else (-value, 0, made, level - 1, own))
        return found


#: Stands for a null key, after all others.
LAST = 1 << 63


def _found(index: DataFrame, queries: list[np.ndarray], w: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, key, score): each task's best k documents for each query."""

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for row in range(len(batch)):
                keys, lengths, sizes, terms, tfs = (batch.column(i)[row].values for i in range(5))
                keys = [LAST if x is None else x for x in keys.to_pylist()]
                lengths, sizes, terms, tfs = (x.to_numpy() for x in (lengths, sizes, terms, tfs))
                docs = np.repeat(np.arange(len(keys)), sizes)
                tree = MaxTree(terms, docs, impacts(tfs.astype("i8"), lengths[docs], w[terms], n_docs, n_terms))
                for own, query in zip(best, queries, strict=True):
                    more = tree.best(query, k, keys, -own[-1][0] if len(own) == k else 1)
                    if more:
                        own[:] = sorted([*own, *more])[:k]
        rows = [(q, None if key == LAST else key, -s) for q, own in enumerate(best) for s, key in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["_query", "_doc", "score"])

    return index.select("keys", "lengths", "sizes", "terms", "tfs").mapInArrow(take, "_query long, _doc long, score long")


def _block(docs: DataFrame, rows: list[Row], k: int, base: str) -> DataFrame:
    """(_i1, _i2, _doc, score): candidates for a block of queries, with each query's best k among them."""
    spark = docs.sparkSession
    texts = [sorted({t for part in terms_of(r["_text"] or "") for t in part}) for r in rows]
    number = {t: i for i, t in enumerate(sorted({t for ts in texts for t in ts}))}
    index = stored(index_of(docs, number), f"{base}/index")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    pairs = index.select(F.explode(F.arrays_zip("df_term", "df")).alias("x")).groupBy("x.df_term").agg(F.sum("x.df").alias("df"))
    w = np.zeros(len(number), "i8")
    for term, df in pairs.collect():  # as many rows as the block has terms
        w[term] = weight(n_docs, df)
    queries = [np.array([number[t] for t in ts], "i8") for ts in texts]
    found = stored(_found(index, queries, w, n_docs, n_terms, k), f"{base}/found")
    discard(spark, f"{base}/index")
    ids = spark.createDataFrame([(i, r["_k1"], r["_k2"]) for i, r in enumerate(rows)], "_query long, _i1 long, _i2 long")
    return found.join(F.broadcast(ids), "_query").select("_i1", "_i2", "_doc", "score")


@private_names
def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_key, rank, key, score): the k documents of the highest scores above 0 for each row of items, from rank 1;
    equal scores by ascending key.

    key is an integer column; null keys come after all others. Every row of docs counts as a document,
    so repeated rows take a place each. Documents without terms (null, empty) are found by nothing and
    don't count; items without terms,
    or with terms that no document has, have no rows; repeated items have theirs each. Very long texts
    are taken apart in pieces. Other columns are left out, whatever their names; empty tables give no rows.
    Items are taken in blocks of about query_bytes of different texts, each with its own pass over docs.
    """
    base = shared_dir(docs.sparkSession)
    given = items.select(F.col(item_key).alias("_item"), F.col(item_text).alias("_text"))
    given = given.where(F.coalesce(F.length("_text"), F.lit(0)) > 0)
    asked = given.select("_item", *[c.alias(n) for c, n in zip(row_key("_text"), ("_i1", "_i2"), strict=True)])
    texts = given.select("_text", *row_key("_text")).dropDuplicates(["_k1", "_k2"])
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = -(-size // query_bytes)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    found = None
    for b in range(blocks):
        part = texts.where(F.pmod("_k1", F.lit(blocks)) == b).orderBy("_k1", "_k2").collect()  # query_bytes of them
        if part:
            made = _block(rows, part, k, f"{base}/{b}")
            found = made if found is None else found.unionByName(made)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "_i1 long, _i2 long, _doc long, score long")
    place = F.row_number().over(Window.partitionBy("_i1", "_i2").orderBy(F.desc("score"), F.asc_nulls_last("_doc")))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    return asked.join(top, ["_i1", "_i2"]).select(F.col("_item").alias(item_key), "rank", F.col("_doc").alias(key), "score")
