"""Ranked lexical search: a dual tree over items and documents.

An item's score of a document sums, over its distinct terms that the document has, w * ((10^9 tf) div (1000 tf + 8 m)): w the term's weight,
m the document's length against the mean (10 parts in 100 fixed). All of it is integer arithmetic but the logarithm in w.

1. Impacts. Items are searched in blocks (``block_items``), so that what is broadcast has a bound. One pass over the texts writes each document's length and the
   counts of the block's terms in it; from these come the number of documents, their words, and the document frequencies.
2. Trees. A document's coordinates are its impacts, one per term of the block; an item's are its weights. Inner nodes hold the maximum of each coordinate over what lies below.
   Items are ordered by their heaviest terms and form nodes of 8 and of 64; the documents of a batch are ordered by their strongest
   coordinate and form nodes of 16 and of 256.
3. Search. Each task walks both trees at once. The product of two nodes' maxima is no less than any score below them; where it does not reach the weakest kth score among the node's
   items, or is zero, the whole pair goes. A pair that could tie stays, as a smaller doc_id wins a tie. What is left is scored exactly. A window ranks the
   tasks' best, at most ``k`` per item and task.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with only A-Z lower-cased, compared by 64-bit hashes. Null, empty and termless texts are no
documents, and such items have no results. Repeated documents count each and may rank side by side; a null doc_id comes last among equals. Rows that agree in
item_id and text are one item; rows that share an item_id only are ranked each for itself. An empty table on either side gives an empty result. Columns beyond
doc_id, text and item_id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from livetables.llm.base import ALNUM, LOWER, Bytes, Steps, Words, column, list_array, slices

K = 10
BLOCK_ITEMS = 1024
ITEM_NODES, DOC_NODES = (64, 8), (256, 16)        # leaves of the nodes of each level, from the top
VARIED = 90                                       # parts in 100 of a length that follow the document; the others are fixed
IMPACTS = "doc_id long, n long, terms array<int>, tfs array<long>"


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and row of every term, and the number of rows."""
    b = Bytes(texts)
    data, words = LOWER[b.data], Words(b, ALNUM)
    return words.hashes(data), words.row, b.n


def _impacts(vocabulary: np.ndarray):
    """Per document with a term: its length, and the numbers and counts of its terms that are in the (sorted) vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, row, n = hashed(column(part, "text"))
            length = np.bincount(row, minlength=n).astype(np.int64)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            pair, tf = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
            count = np.bincount(pair // len(vocabulary), minlength=n)
            some = pa.array(length > 0)
            yield pa.record_batch({"doc_id": column(part, "doc_id").filter(some), "n": pa.array(length).filter(some),
                                   "terms": list_array(pa.array((pair % len(vocabulary)).astype(np.int32)), count).filter(some), "tfs": list_array(pa.array(tf.astype(np.int64)), count).filter(some)})
    return run


@dataclass
class Items:
    """A block of items in tree order: ``terms[first[i]:first[i + 1]]`` are the numbers of the terms of item i, ``weight`` has one number per term."""
    numbers: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weight: np.ndarray

    def maxima(self, lo: int, hi: int) -> np.ndarray:
        """Of each term the largest weight among items lo to hi - 1: its weight, if any of them has it."""
        out = np.zeros(len(self.weight), np.int64)
        mine = self.terms[self.first[lo]:self.first[hi]]
        out[mine] = self.weight[mine]
        return out


def ordered_items(h: np.ndarray, row: np.ndarray, n: int, vocabulary: np.ndarray, weight: np.ndarray) -> Items:
    """Items with a term, those with the same heaviest terms side by side."""
    lists = [np.unique(np.searchsorted(vocabulary, h[row == i])) for i in range(n)]
    by_weight = lambda i: [(-int(weight[t]), int(t)) for t in lists[i][np.argsort(-weight[lists[i]], kind="stable")]]
    numbers = sorted((i for i in range(n) if len(lists[i])), key=by_weight)
    return Items(np.array(numbers, np.int64), np.concatenate([[0], np.cumsum([len(lists[i]) for i in numbers])]).astype(np.int64),
                 np.concatenate([lists[i] for i in numbers]) if numbers else np.zeros(0, np.int64), weight)


class Level:
    """Nodes of the document tree and their coordinates: entries (node, term, value), ordered by node."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, size: int):
        self.node, self.term, self.value, self.size = node, term, value, size

    def above(self, leaves: int) -> Level:
        """Nodes over ``leaves`` of these, with the maximum of each coordinate."""
        node = self.node // leaves
        order = np.lexsort((self.term, node))
        node, term, value = node[order], self.term[order], self.value[order]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])])) if len(node) else np.zeros(0, np.int64)
        return Level(node[first], term[first], np.maximum.reduceat(value, first) if len(first) else value, -(-self.size // leaves))

    def under(self, keep: np.ndarray) -> Level:
        """Only the entries of some nodes."""
        some = keep[self.node]
        return Level(self.node[some], self.term[some], self.value[some], self.size)

    def products(self, weights: np.ndarray) -> np.ndarray:
        """Of each node the sum over its coordinates of value and weight."""
        out = np.zeros(self.size, np.int64)
        if len(self.node):
            first = np.flatnonzero(np.concatenate([[True], self.node[1:] != self.node[:-1]]))
            out[self.node[first]] = np.add.reduceat(self.value * weights[self.term], first)
        return out


class Best:
    """The k best documents of each item so far: highest score, then smallest doc_id, null last."""

    def __init__(self, n: int, k: int):
        self.score, self.doc, self.k = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, k
        self.null = [np.zeros(0, bool)] * n
        self.least = np.ones(n, np.int64)         # a score below this does not enter

    def add(self, i: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score[i], score), (self.doc[i], doc), (self.null[i], null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score[i], self.doc[i], self.null[i] = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least[i] = score[order[-1]]


def search_batch(items: Items, best: Best, docs: Level, ids: np.ndarray, null: np.ndarray) -> int:
    """Enter the documents of a batch, in tree order, into ``best``. Returns how many (item, document) pairs were scored."""
    middle = docs.above(DOC_NODES[1])
    top = middle.above(DOC_NODES[0] // DOC_NODES[1])
    n, scored = len(items.numbers), 0
    for lo in range(0, n, ITEM_NODES[0]):
        hi = min(lo + ITEM_NODES[0], n)
        open_top = top.products(items.maxima(lo, hi)) >= best.least[lo:hi].min()
        if not open_top.any():
            continue
        near = middle.under(np.repeat(open_top, DOC_NODES[0] // DOC_NODES[1])[:middle.size])
        open_middle = near.products(items.maxima(lo, hi)) >= best.least[lo:hi].min()
        near = near.under(open_middle)
        leaves = docs.under(np.repeat(open_middle, DOC_NODES[1])[:docs.size])
        for a in range(lo, hi, ITEM_NODES[1]):
            b = min(a + ITEM_NODES[1], hi)
            maxima = items.maxima(a, b)
            open_near = near.products(maxima) >= best.least[a:b].min()
            if not open_near.any():
                continue
            some = leaves.under(np.repeat(open_near, DOC_NODES[1])[:docs.size])
            open_docs = some.products(maxima) >= best.least[a:b].min()
            some = some.under(open_docs)
            scored += (b - a) * int(open_docs.sum())
            for i in range(a, b):
                score = some.products(items.maxima(i, i + 1))
                good = np.flatnonzero(score >= best.least[i])
                if len(good):
                    best.add(i, score[good], ids[good], null[good])
    return scored


def _search(shared, n_docs: int, n_words: int, k: int):
    """(item, doc_id, score) of the best documents of a task, from its impacts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(len(items.numbers), k)
        for batch in batches:
            terms, length = column(batch, "terms"), column(batch, "n").to_numpy()
            count = terms.value_lengths().to_numpy()
            m = 100 - VARIED + (VARIED * length * n_docs) // n_words
            node, term, tf = np.repeat(np.arange(batch.num_rows), count), terms.flatten().to_numpy().astype(np.int64), column(batch, "tfs").flatten().to_numpy()
            value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[node])
            # documents with the same strongest coordinate side by side
            strength = value * items.weight[term]
            by = np.lexsort((-strength, node))
            node, term, value = node[by], term[by], value[by]
            first = np.concatenate([[0], np.cumsum(count)])[:-1]
            strongest = np.where(count > 0, np.append(term, 0)[np.minimum(first, len(term))], -1)
            order = np.argsort(strongest, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            by = np.argsort(place[node], kind="stable")
            ids = column(batch, "doc_id")
            search_batch(items, best, Level(place[node][by], term[by], value[by], batch.num_rows),
                         ids.fill_null(0).to_numpy()[order], ids.is_null().to_numpy(zero_copy_only=False)[order])
        sizes = [len(s) for s in best.score]
        if sum(sizes):
            yield pa.record_batch({"item": pa.array(np.repeat(items.numbers, sizes)), "doc_id": pa.array(np.concatenate(best.doc), mask=np.concatenate(best.null)),
                                   "score": pa.array(np.concatenate(best.score))})
    return run


def _search_block(steps: Steps, docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of a bounded block of items; None if none of them has a term."""
    spark = docs.sparkSession
    table = block.toArrow()
    h, row, n = hashed(table["text"].combine_chunks())
    vocabulary = np.unique(h)
    if not len(vocabulary):
        return None
    impacts = steps.keep(docs.mapInArrow(_impacts(vocabulary), IMPACTS), "impacts")
    totals = impacts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    if not totals.n:
        steps.drop(impacts)
        return None
    seen = impacts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[seen["t"].to_numpy()] = seen["df"].to_numpy()
    weight = np.array([floor(1000 * log((2 * totals.n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = ordered_items(h, row, n, vocabulary, weight)
    shared = spark.sparkContext.broadcast(items)
    found = impacts.mapInArrow(_search(shared, totals.n, totals.words, k), "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = steps.keep(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "ranked")
    steps.drop(impacts)
    shared.destroy()
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(n)), "item_id": table["item_id"]}))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Of each item (item_id, text) the ``k`` documents (doc_id, text) with the highest score above 0: item_id, rank, doc_id, score."""
    steps = Steps(docs.sparkSession, "search")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // block_items))
    numbered = steps.keep(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = [_search_block(steps, docs, numbered.filter(F.col("block") == i).drop("block"), k) for i in range(blocks)]
    steps.drop(numbered)
    out = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for part in found:
        out = out if part is None else out.unionByName(part)
    return out
