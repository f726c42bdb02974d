"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

Symbols are words. A pattern is a window of ``window`` consecutive words of a benchmark item; an item of fewer words,
but not none, is one pattern of its own length, and patterns of one length are searched together. Per length m:

- a block is ``BLOCK`` words (one, where m is 1). The shift table gives, for the block that ends at the current word, how
  far the search may move without missing a pattern: m - BLOCK + 1 for a block that no pattern has;
- where the shift is 0, the block is the end of some pattern. Its bucket, chosen by the hash of that suffix, holds the
  patterns to test;
- each tested pattern is compared with the text word by word, on the bytes of the words.

Many stretches of a batch are searched side by side: each lane of ``LANE`` words moves by its own shift.

Patterns come to the tasks in blocks of about ``max_patterns``, each a broadcast of bounded size. With more patterns the
documents are read once per block: a block is searched, its hits are written, and it leaves the driver and the executors before the next one
comes. The hits of the blocks are united per document.

Null and empty texts have no words: no hits, never contaminated. Repeated rows get a row each. Items without words
match nothing. Without items nothing is hit; without documents the result is empty. A null item_id counts as one item,
but is left out of the list of ids. Columns beyond those named are ignored, or kept by ``without_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import ALNUM, LOWER, Bytes, Steps, Words, column, list_array, mix, slices, text_key

BLOCK = 2
LANE = 256
TABLE_BITS = 18
WINDOW = 13
MAX_PATTERNS = 200_000

RUNS = "array<struct<first:int,last:int>>"
HITS = f"doc_id long, text_key long, n_words long, n_hit long, n_items long, item_ids array<string>, hit_words {RUNS}"


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words of one text, as bytes."""
    b = Bytes(pa.array([text], pa.string()))
    data, w = LOWER[b.data], Words(b, ALNUM)
    return [data[s:e].tobytes() for s, e in zip(w.start.tolist(), w.end.tolist())]


def patterns_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(pattern, item_id) rows; a pattern is its words joined by spaces."""
    for batch in batches:
        patterns, owners = [], []
        for item, text in zip(column(batch, "item_id").to_pylist(), column(batch, "text").to_pylist()):
            words = normal_words(text)
            size = min(window, len(words))
            for j in range(len(words) - size + 1 if words else 0):
                patterns.append(b" ".join(words[j:j + size]).decode())
                owners.append(item)
        yield pa.record_batch({"pattern": pa.array(patterns, pa.string()), "item_id": pa.array(owners, pa.string())})


def _suffix_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that end at each word; the first ``width`` - 1 entries mean nothing."""
    out = h.copy()
    for j in range(1, width):
        out[j:] += h[:-j] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * j)
    return mix(out)


class Table:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, m: int):
        self.m, self.width = m, min(BLOCK, m)
        self.shift = np.full(1 << TABLE_BITS, m - self.width + 1, np.int16 if m < 2**15 else np.int64)
        self.buckets: dict[int, list[tuple[list[bytes], int]]] = defaultdict(list)

    def add(self, words: list[bytes], number: int, code: np.ndarray) -> None:
        block = _suffix_hashes(code, self.width)
        slots = (block & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        for end in range(self.width - 1, self.m):
            self.shift[slots[end]] = min(self.shift[slots[end]], self.m - 1 - end)
        self.buckets[int(block[-1])].append((words, number))

    def close(self) -> None:
        self.suffixes = np.sort(np.array(list(self.buckets), np.uint64))

    def search(self, h: np.ndarray, w: Words, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(number of the pattern, its first word) for every occurrence."""
        n, m = len(h), self.m
        if n < m:
            return
        block = _suffix_hashes(h, self.width)
        slot = (block & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        ends = []
        while len(at):
            move = self.shift[slot[at]]
            ends.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.sort(np.concatenate(ends))
        ends = ends[w.row[ends] == w.row[ends - m + 1]]
        place = np.minimum(np.searchsorted(self.suffixes, block[ends]), len(self.suffixes) - 1)
        for e in ends[self.suffixes[place] == block[ends]].tolist():
            first = e - m + 1
            text = [data[s:t].tobytes() for s, t in zip(w.start[first:e + 1].tolist(), w.end[first:e + 1].tolist())]
            for words, number in self.buckets[int(block[e])]:
                if words == text:
                    yield number, first


class Found:
    """What a search found in a slice: per row the counts, the items and the runs of hit words."""

    def __init__(self, w: Words, mark: np.ndarray, items: dict[int, set], n: int):
        self.n, self.words, self.items = n, w.count, items
        hit = np.cumsum(mark[:-1]) > 0
        self.hits = np.bincount(w.row[hit], minlength=n).astype(np.int64)
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (w.row[1:] != w.row[:-1])
        edges = np.append(np.flatnonzero(edge), len(hit))
        begin = edges[:-1][hit[edges[:-1]]]
        last = edges[np.searchsorted(edges, begin, "right")] - 1
        self.rows = w.row[begin]
        self.first, self.last = begin - w.first[self.rows], last - w.first[self.rows]

    def contaminated(self) -> np.ndarray:
        return (self.hits > 0) & (20 * self.hits >= self.words)

    def columns(self) -> dict[str, pa.Array]:
        ids = [sorted(x for x in self.items.get(i, ()) if x is not None) for i in range(self.n)]
        runs = pa.StructArray.from_arrays([pa.array(self.first.astype(np.int32)), pa.array(self.last.astype(np.int32))], names=["first", "last"])
        return {"n_words": pa.array(self.words), "n_hit": pa.array(self.hits),
                "n_items": pa.array([len(self.items.get(i, ())) for i in range(self.n)], pa.int64()),
                "item_ids": pa.array(ids, pa.list_(pa.string())), "hit_words": list_array(runs, np.bincount(self.rows, minlength=self.n))}


class Searcher:
    """Tables for a block of patterns, each with the items it belongs to."""

    def __init__(self, rows: list[tuple[str, list[str | None]]]):
        self.items = [items for _, items in rows]
        tables: dict[int, Table] = {}
        for number, (pattern, _) in enumerate(rows):
            b = Bytes(pa.array([pattern], pa.string()))
            words = b.data.tobytes().split(b" ")
            if len(words) not in tables:
                tables[len(words)] = Table(len(words))
            tables[len(words)].add(words, number, Words(b, ALNUM).hashes(b.data))
        self.tables = list(tables.values())
        for t in self.tables:
            t.close()

    def search(self, texts: pa.Array) -> Found:
        b = Bytes(texts)
        data, w = LOWER[b.data], Words(b, ALNUM)
        h = w.hashes(data)
        mark, items = np.zeros(len(h) + 1, np.int64), defaultdict(set)
        for t in self.tables:
            for number, first in t.search(h, w, data):
                mark[first] += 1
                mark[first + t.m] -= 1
                items[int(w.row[first])].update(self.items[number])
        return Found(w, mark, items, b.n)


def pattern_table(items: DataFrame, window: int) -> DataFrame:
    """Distinct patterns, each with the items it belongs to."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        lambda it: patterns_of(it, window), "pattern string, item_id string")
    return rows.groupBy("pattern").agg(F.collect_set(F.struct("item_id")).alias("items"))


class Blocks:
    """The patterns of all items, written once and handed out as broadcast searchers of about ``max_patterns`` patterns."""

    def __init__(self, items: DataFrame, window: int, max_patterns: int):
        self.steps = Steps(items.sparkSession, "decontamination")
        self.table = self.steps.keep(pattern_table(items, window), "patterns")
        self.n = max(1, -(-self.table.count() // max_patterns))

    def searcher(self, i: int):
        mine = self.table if self.n == 1 else self.table.filter(F.pmod(F.xxhash64("pattern"), F.lit(self.n)) == i)
        return self.table.sparkSession.sparkContext.broadcast(Searcher([(r.pattern, [x.item_id for x in r["items"]]) for r in mine.collect()]))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Per document: its words, the words inside occurrences of item windows (count and runs), and the items they belong to.

    ``docs`` has doc_id and text, ``items`` has item_id and text. ``text_key`` tells rows of one doc_id apart.
    """
    blocks = Blocks(items, window, max_patterns)
    steps = blocks.steps
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")

    def search(one):
        def run(it):
            for part in slices(it, "text"):
                found = one.value.search(column(part, "text"))
                yield pa.record_batch({"doc_id": column(part, "doc_id"), "text_key": column(part, "text_key"), **found.columns()})
        return docs.mapInArrow(run, HITS)

    if blocks.n == 1:
        one = blocks.searcher(0)
        steps.drop(blocks.table)
        return search(one)
    found = []
    for i in range(blocks.n):
        one = blocks.searcher(i)
        found.append(steps.keep(search(one) if i == 0 else search(one).filter("n_hit > 0"), "block"))
        one.destroy()
    steps.drop(blocks.table)
    out, *rest = found
    hits = out.filter("n_hit > 0")
    for r in rest:
        hits = hits.unionByName(r)
    hits = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_items").alias("_most"), F.max(F.col("n_items") - F.size("item_ids")).alias("_unnamed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("runs"))
    joined = out.select("doc_id", "text_key", "n_words").alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.text_key = h.text_key"), "left")
    return joined.select("d.doc_id", "d.text_key", "n_words", F.coalesce(F.size("item_ids") + F.col("_unnamed"), F.lit(0)).cast("long").alias("_items"),
                         F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                         F.coalesce("runs", F.array().cast(RUNS)).alias("runs")).mapInArrow(_joined_runs, HITS)


def _joined_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite overlapping runs of the hit words of a document."""
    for batch in it:
        rows = batch.to_pylist()
        for r in rows:
            runs = []
            for x in r.pop("runs"):
                if runs and x["first"] <= runs[-1]["last"] + 1:
                    runs[-1]["last"] = max(runs[-1]["last"], x["last"])
                else:
                    runs.append(dict(x))
            r |= {"hit_words": runs, "n_hit": sum(x["last"] - x["first"] + 1 for x in runs), "n_items": r.pop("_items")}
        kind = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
            ("item_ids", pa.list_(pa.string())), ("hit_words", pa.list_(kind))]))


def contaminated():
    """A document is contaminated where a twentieth of its words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``docs`` with all its columns, without the contaminated rows."""
    blocks = Blocks(items, window, max_patterns)
    if blocks.n == 1:
        one = blocks.searcher(0)
        blocks.steps.drop(blocks.table)

        def run(it):
            for part in slices(it, "text"):
                yield part.filter(pa.array(~one.value.search(column(part, "text")).contaminated()))
        return docs.mapInArrow(run, docs.schema)
    blocks.steps.drop(blocks.table)
    bad = find_hits(docs, items, window, max_patterns).filter(contaminated()).select("doc_id", "text_key").distinct().alias("b")
    return docs.alias("d").join(bad, (F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id"))) & (text_key("d.text") == F.col("b.text_key")), "left_anti")
