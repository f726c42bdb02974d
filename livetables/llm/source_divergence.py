"""Source divergence audit: token-start pointer sort.

1. Count. A shard of rows (``SHARD_BYTES`` of text, at least one row) keeps its texts as one Arrow buffer. Pointers to the starts of its words are sorted by
   multikey quicksort, eight bytes of the words being a key: slices are split three ways around a pivot, the middle part goes on with the
   next eight bytes, and small slices are finished in one sort. Each equal run is a term; the documents its pointers lie in give its document
   frequency, their sources its counts. Shards' counts are summed by (lang, source, term), partly before the shuffle.
2. Keep the terms of a language that at least ``min_docs`` of its documents have, and turn counts into smoothed integer shares: 1 + (10^9 (n + 2)) div (N + 2 V),
   N the count of all kept terms of a group (a source within a language, or the language) and V the number of kept terms.
3. Diverge. f(p, q) = (p - q)^2 div (p + q). Sources of a language are compared over all kept terms. A term that neither source has
   gives the same f everywhere, one that only one has depends on its share there: so a pair's sum is made of the terms that both have (pairs of the few sources of each term),
   of each source's histogram of shares, and of a constant. Terms are ranked by f of the source's and the language's share, where the former is larger.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with only A-Z lower-cased. Null text, lang and source are ''. Empty texts and texts without a term count as
documents of their group, which occurs in the result as an item of the others of its language. A lone source has no pairs. Equal values rank by the item's
bytes. Each row is a document, also a repeated one. An empty table gives an empty result. Columns beyond lang, source and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from livetables.llm.base import LOWER, Bytes, Steps, Words, byte_set, column

LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
SHARD_BYTES = 8 << 20
SMALL = 1 << 15               # pointers of a slice that is sorted without further splits
PAIRS = 1 << 21               # pairs of sources worked on at once
OUT = "lang string, source string, term string, n long, df long"


class Pointers:
    """Pointers to word starts in a byte buffer, and the words' eight-byte keys."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.wide = np.ndarray(len(data) + 1, ">u8", padded.tobytes(), strides=(1,))       # eight bytes from every place on
        self.start, self.length = start, end - start

    def keys(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        """Bytes 8 * depth to 8 * depth + 7 of each word as a number; zeros after its end, which no word holds."""
        left = np.clip(self.length[pointers] - 8 * depth, 0, 8)
        at = np.minimum(self.start[pointers] + 8 * depth, len(self.wide) - 1)
        drop = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
        return np.where(left > 0, self.wide[at].astype(np.uint64) >> drop << drop, np.uint64(0))

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers in the order of their words, pointers of equal words in their old order, and which ones begin a run of equal words."""
        order, first = np.arange(len(self.start)), np.zeros(len(self.start), bool)
        todo = [(0, len(order), 0)] if len(order) else []
        while todo:
            lo, hi, depth = todo.pop()
            part = order[lo:hi]
            if hi - lo <= SMALL:
                order[lo:hi], first[lo:hi] = self._finish(part, depth)
                continue
            keys = self.keys(part, depth)
            pivot = np.sort(keys[:: max(1, len(keys) // 31)])[15]
            less, more = keys < pivot, keys > pivot
            same = ~(less | more)
            middle = part[same]
            a, b = lo + int(less.sum()), hi - int(more.sum())
            order[lo:a], order[a:b], order[b:hi] = part[less], middle, part[more]
            todo += [(x, y, depth) for x, y in ((lo, a), (b, hi)) if y > x]
            if (self.length[middle] > 8 * (depth + 1)).any():
                todo.append((a, b, depth + 1))
            else:
                first[a] = True
        return order, first

    def _finish(self, part: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """A small slice, sorted key after key as far as runs of equal keys go on."""
        run = np.zeros(len(part), np.int64)
        while True:
            keys = self.keys(part, depth)
            by = np.lexsort((keys, run))
            part, run, keys = part[by], run[by], keys[by]
            first = np.ones(len(part), bool)
            first[1:] = (run[1:] != run[:-1]) | (keys[1:] != keys[:-1])
            depth += 1
            if first.all() or not (self.length[part] > 8 * depth).any():
                return part, first
            run = np.cumsum(first)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += int(Bytes(column(batch, "text")).offsets[-1])
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield table.to_batches()[0]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a shard, from (lang, source, text)."""
    for shard in shards(batches, SHARD_BYTES):
        b = Bytes(column(shard, "text"))
        data = LOWER[b.data]
        words = Words(b, LETTERS)
        if not len(words.start):
            continue
        lang, source = (column(shard, c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("lang", "source"))
        of_row = lang * (source.max() + 1) + source
        order, first = Pointers(data, words.start, words.end).sort()
        row, run = words.row[order], np.cumsum(first) - 1
        # within a run of equal words: by group, and there by document
        by = np.lexsort((row, of_row[row], run))
        order, row, run = order[by], row[by], run[by]
        g = of_row[row]
        cell = np.ones(len(run), bool)
        cell[1:] = (run[1:] != run[:-1]) | (g[1:] != g[:-1])
        doc = cell.copy()
        doc[1:] |= row[1:] != row[:-1]
        at = np.flatnonzero(cell)
        size = words.end[order[at]] - words.start[order[at]]
        offsets = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - words.start[order[at]], size)
        term = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[places].tobytes())])
        rows = pa.array(row[at])
        yield pa.record_batch({"lang": column(shard, "lang").take(rows), "source": column(shard, "source").take(rows), "term": term,
                               "n": pa.array(np.diff(np.append(at, len(run)))), "df": pa.array(np.add.reduceat(doc.astype(np.int64), at))})


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value), a < b: what the terms that both sources have add to their divergence, beyond what they would add if each stood against a zero count.

    A row holds the sources of a term as structs: number g, share p, and z, the share of a term it does not have.
    """
    for batch in batches:
        cells = column(batch, "cells")
        length = cells.value_lengths().to_numpy()
        g, p, z = (cells.flatten().field(name).to_numpy() for name in ("g", "p", "z"))
        last = np.repeat(np.cumsum(length), length)             # of each entry: where its term ends
        # entries of a term ascend by g, so each entry is paired with those after it
        after = last - np.arange(len(g)) - 1
        edges = np.concatenate([[0], np.cumsum(after)])
        lo = 0
        while lo < len(g):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PAIRS, "right")) - 1)
            n = after[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(edges[lo:hi] - edges[lo], n)
            lo = hi
            if not len(a):
                continue
            value = divergence(p[a], p[b]) - divergence(p[a], z[b]) - divergence(z[a], p[b]) + divergence(z[a], z[b])
            order = np.lexsort((g[b], g[a]))
            a, b, value = g[a][order], g[b][order], value[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield pa.record_batch({"a": pa.array(a[first]), "b": pa.array(b[first]), "value": pa.array(np.add.reduceat(value, first))})


def _share(n: str, total: str):
    """The smoothed share of a count; 0 where a language keeps no term."""
    return F.expr(f"CASE WHEN v = 0 THEN 0L ELSE 1 + ({SCALE}L * ({n} + 2)) div ({total} + 2 * v) END")


def _f(p: str, q: str):
    return F.expr(f"CASE WHEN {p} + {q} = 0 THEN 0L ELSE (({p} - {q}) * ({p} - {q})) div ({p} + {q}) END")


def term_counts(steps: Steps, docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, and of each kept term its count ``total`` in the language; ``one`` marks one row of each (lang, term)."""
    counted = docs.mapInArrow(count_terms, OUT).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"docs": F.sum("df").over(term), "total": F.sum("n").over(term), "one": F.row_number().over(term.orderBy("source")) == 1})
    return steps.keep(kept.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "one"), "counts")


def group_table(steps: Steps, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Each occurring (lang, source): its number g, N and V, the language's N (``n_lang``), and z, its share of a term that it does not have."""
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count_if("one").alias("ones"))
    lang = Window.partitionBy("lang")
    table = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select(
        F.monotonically_increasing_id().alias("g"), "lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"),
        F.coalesce(F.sum("ones").over(lang), F.lit(0)).alias("v"), F.coalesce(F.sum("n_group").over(lang), F.lit(0)).alias("n_lang"))
    return steps.keep(table.withColumn("none", F.lit(0).cast("long")).withColumn("z", _share("none", "n_group")).drop("none"), "groups")


def pair_values(steps: Steps, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language."""
    entry = F.array_sort(F.collect_list(F.struct("g", "p", "z")))
    both = cells.groupBy("lang", "term").agg(entry.alias("cells")).select("cells").mapInArrow(_pair_sums, "a long, b long, value long") \
        .groupBy("a", "b").agg(F.sum("value").alias("both"))
    both = steps.keep(both, "both")
    bars = cells.groupBy("lang", "g", "z", "p").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("g").alias("b"), F.col("z").alias("zb"))
    one = bars.withColumnsRenamed({"g": "a", "z": "za"}).join(other, "lang").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("m") * (_f("p", "zb") - _f("za", "zb"))).alias("one"))
    one = steps.keep(one, "one")
    x = groups.select("lang", "source", F.col("g").alias("a"), F.col("z").alias("za"), "v")
    y = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("z").alias("zb"))
    turned = one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("one").alias("eno"))
    pairs = x.join(y, "lang").filter("a <> b").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    pairs = pairs.join(both.withColumnsRenamed({"a": "lo", "b": "hi"}), ["lo", "hi"], "left").join(one, ["a", "b"], "left").join(turned, ["a", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pairs.select("lang", "source", "item", (zero("both") + zero("one") + zero("eno") + F.col("v") * _f("za", "zb")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    steps = Steps(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(steps, docs, min_docs)
    groups = group_table(steps, docs, counts)
    cells = counts.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "n_group"), "q": _share("total", "n_lang")})
    cells = steps.keep(cells.select("lang", "source", "term", "g", "p", "q", "z"), "cells")
    steps.drop(counts)
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *by)))
    pairs = ranked(pair_values(steps, cells, groups), "item").withColumn("part", F.lit("pair"))
    terms = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    terms = ranked(terms, "item").filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*order).unionByName(terms.select(*order))
