"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats.

A window is ``window`` consecutive words of one document. A word goes if a window over it also starts in a document with a smaller doc_id.

1. Anchors: each document is cut into non-overlapping blocks of (window + 1) / 2 words from its first word on, so that every window holds a whole
   block of its own document. The blocks are the index.
2. Probes: every rolling window of the block's length, of every document. Their hashes go to buckets by their leading bits, as sorted arrays
   of 32-bit rests, each at most once per slice of rows, with a bit for those that several of its documents have. So a probe costs four bytes of shuffle, and
   a passage in a third of all documents is one entry per slice. An anchor that two documents probe is live.
3. Extension: a document learns which of its own anchors are live. Only windows whose anchors are all live can be repeated; a partial
   minimum finds the smallest document of each of them, by a 64-bit hash. Windows that a smaller document has are joined to maximal runs of words, which go.

Only documents with live anchors are shuffled with their texts, and a few others that a Bloom filter lets pass. The bucket count follows the
size of the input. Hashes of 64 bits stand for word sequences: two different ones agree with a probability of 2^-64.

Words are ``[^\\x20\\x09-\\x0D]+`` and not changed. Null, empty and wordless texts have no words and nothing to remove; texts of any length are
processed whole. Repeated rows get a row each and the same result; rows that share a doc_id are no smaller than each other. A null doc_id is larger than any
other (as large as the largest long). A window that occurs twice in one document only stays. An empty table gives an empty result. Columns beyond doc_id and text
are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import NOT_SPACE, PLACE, Bytes, Steps, Words, column, list_array, marked_members, mix, places, signed, slices

WINDOW = 50
BUCKET_BYTES = 4 << 20        # of text whose probes go to one bucket
REST = 31                     # bits of a hash beyond those that choose the bucket
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string"

_inverse = np.ones(1, np.uint64)


def _inverse_places(n: int) -> np.ndarray:
    """Powers of the inverse of ``PLACE`` modulo 2^64."""
    global _inverse
    if len(_inverse) < n:
        new = np.full(max(n, 2 * len(_inverse)), pow(int(PLACE), -1, 1 << 64), np.uint64)
        new[0] = 1
        _inverse = np.cumprod(new, dtype=np.uint64)
    return _inverse


class Texts:
    """The words of a slice of rows, with hashes of every window of some number of them."""

    def __init__(self, texts: pa.Array):
        self.bytes = Bytes(texts)
        self.words = Words(self.bytes, NOT_SPACE)
        self.local = np.arange(len(self.words.start)) - self.words.first[self.words.row]      # number of a word in its document
        h = self.words.hashes(self.bytes.data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * places(len(h))[:len(h)], dtype=np.uint64)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows that lie in one document, and their hashes."""
        row = self.words.row
        n = max(len(row) - size + 1, 0)
        first = np.flatnonzero(row[:n] == row[len(row) - n:])
        h = (self.sums[first + size] - self.sums[first]) * _inverse_places(n)[first]
        return first, mix(h + np.uint64(size))

    def joined(self, keep: np.ndarray) -> list[str]:
        """Per row its kept words, joined by one blank."""
        w, n = self.words, len(self.bytes.data)
        kept = np.flatnonzero(keep)
        edge = np.zeros(n + 1, np.int8)
        edge[w.start[kept]] += 1
        edge[w.end[kept]] -= 1
        mask = np.cumsum(edge[:n]).astype(bool)
        data = self.bytes.data.copy()
        blank = w.end[kept[:-1]][w.row[kept[:-1]] == w.row[kept[1:]]]           # a word with another one after it ends before a separator
        data[blank] = 0x20
        mask[blank] = True
        size = np.concatenate([[0], np.cumsum(mask)])[self.bytes.offsets]
        text = data[mask].tobytes()
        return [text[a:b].decode() for a, b in zip(size[:-1].tolist(), size[1:].tolist())]


def _block(window: int) -> int:
    """The longest block of which every window holds a whole one at a multiple of its length."""
    return (window + 1) // 2


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The parts of an array from each ``first`` to the next as binary values."""
    offsets = np.append(first, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _probes(window: int, bits: int):
    """(bucket, probes, blocks): the rests of the hashes of a slice's rolling windows and anchors, sorted; bit 0 of a probe is set if several documents have it."""
    block = _block(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = Texts(column(part, "text"))
            first, h = t.windows(block)
            row = t.words.row[first]
            long = t.words.count[row] >= window
            first, row, key = first[long], row[long], h[long] >> np.uint64(64 - bits - REST)
            order = np.argsort(key, kind="stable")
            key, row, anchor = key[order], row[order], (t.local[first] % block == 0)[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(key)) - 1 if len(start) else start
            several = row[start] != row[end]            # rows ascend within a key
            anchored = np.add.reduceat(anchor, start) > 0 if len(start) else np.zeros(0, bool)
            key = key[start]
            rest = (key & np.uint64((1 << REST) - 1)).astype(np.uint32)
            bucket = (key >> np.uint64(REST)).astype(np.int32)
            here, at = np.unique(bucket, return_index=True)
            blocks, block_bucket = rest[anchored], bucket[anchored]
            yield pa.record_batch({"bucket": pa.array(here), "probes": _binary(rest << np.uint32(1) | several.astype(np.uint32), at),
                                   "blocks": _binary(blocks, np.searchsorted(block_bucket, here))})
    return run


def _live(table: pa.Table) -> pa.Table:
    """The anchors of a bucket that at least two documents probe."""
    numbers = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), np.uint32)
    blocks, probes = np.unique(numbers("blocks")), numbers("probes")
    found = np.zeros(0, np.int64)
    if len(blocks):
        at = np.minimum(np.searchsorted(blocks, probes >> np.uint32(1)), len(blocks) - 1)
        hit = blocks[at] == probes >> np.uint32(1)
        # two slices, or one slice with several documents
        n = np.bincount(at[hit], minlength=len(blocks)) + np.bincount(at[hit & (probes & np.uint32(1) == 1)], minlength=len(blocks))
        found = blocks[n >= 2].astype(np.int64)
    return pa.table({"anchor": found + (table["bucket"][0].as_py() << REST)})


def _anchors(window: int, bits: int):
    """(r1, r2, anchors) of each document that is long enough for a window."""
    block = _block(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = Texts(column(part, "text"))
            first, h = t.windows(block)
            mine = (t.local[first] % block == 0) & (t.words.count[t.words.row[first]] >= window)
            count = np.bincount(t.words.row[first[mine]], minlength=part.num_rows)
            anchors = list_array(pa.array((h[mine] >> np.uint64(64 - bits - REST)).astype(np.int64)), count)
            some = pa.array(count > 0)
            yield pa.record_batch({"r1": column(part, "r1").filter(some), "r2": column(part, "r2").filter(some), "anchors": anchors.filter(some)})
    return run


def _candidates(t: Texts, blocks: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows whose anchors are all live. ``blocks`` has the numbers of the live ones per row."""
    block, count = _block(window), t.words.count
    offset = np.concatenate([[0], np.cumsum(count // block)])
    live = np.zeros(offset[-1] + 1, np.int64)
    row = np.repeat(np.arange(len(blocks)), blocks.value_lengths().fill_null(0).to_numpy())
    live[offset[row] + blocks.flatten().to_numpy()] = 1
    before = np.concatenate([[0], np.cumsum(live)])
    first, h = t.windows(window)
    a = offset[t.words.row[first]] + -(-t.local[first] // block)
    b = offset[t.words.row[first]] + (t.local[first] + window - block) // block + 1
    whole = before[b] - before[a] == b - a
    return first[whole], h[whole]


def _smallest(window: int):
    """(h, least, most): the smallest and largest document of each candidate window in a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = Texts(column(part, "text"))
            first, h = _candidates(t, column(part, "blocks"), window)
            if not len(h):
                continue
            doc = column(part, "doc").to_numpy()[t.words.row[first]]
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            yield pa.record_batch({"h": pa.array(signed(h[start])), "least": pa.array(np.minimum.reduceat(doc, start)), "most": pa.array(np.maximum.reduceat(doc, start))})
    return run


def _located(window: int):
    """(h, no, doc, place) of every candidate window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = Texts(column(part, "text"))
            first, h = _candidates(t, column(part, "blocks"), window)
            row = t.words.row[first]
            yield pa.record_batch({"h": pa.array(signed(h)), "no": pa.array(column(part, "no").to_numpy()[row]), "doc": pa.array(column(part, "doc").to_numpy()[row]),
                                   "place": pa.array(t.local[first].astype(np.int32))})
    return run


def _cut(window: int):
    """The result of each row from its text and the first words of its repeated windows (``places``, null for none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t, gone = Texts(column(part, "text")), column(part, "places")
            row = np.repeat(np.arange(part.num_rows), gone.value_lengths().fill_null(0).to_numpy())
            first = t.words.first[row] + gone.flatten().to_numpy()
            n = len(t.words.start)
            cover = np.cumsum(np.bincount(first, minlength=n + 1)[:n + 1] - np.bincount(first + window, minlength=n + 1)[:n + 1])[:n] > 0
            edge = np.ones(n, bool)
            edge[1:] = (cover[1:] != cover[:-1]) | (t.words.row[1:] != t.words.row[:-1])
            start = np.flatnonzero(edge & cover)
            end = np.append(np.flatnonzero(edge), n)
            end = end[np.searchsorted(end, start, "right")]
            spans = pa.StructArray.from_arrays([pa.array(t.local[start].astype(np.int32)), pa.array((t.local[end - 1] + 1).astype(np.int32))], ["first", "last"])
            yield pa.record_batch({"doc_id": column(part, "doc_id"), "n_words": pa.array(t.words.count), "n_removed": pa.array(np.bincount(t.words.row[cover], minlength=part.num_rows).astype(np.int64)),
                                   "spans": list_array(spans, np.bincount(t.words.row[start], minlength=part.num_rows)), "kept": pa.array(t.joined(~cover), pa.string())})
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, ``spans`` (maximal runs of removed words, end exclusive) and ``kept`` (the other words, joined by one blank)."""
    if window < 2:
        raise ValueError("a window has at least two words")
    steps = Steps(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(max(-(-size // BUCKET_BYTES) - 1, 0).bit_length(), 63 - REST - 1)
    probes = docs.select("text").mapInArrow(_probes(window, bits), "bucket int, probes binary, blocks binary")
    live = steps.keep(probes.groupBy("bucket").applyInArrow(_live, "anchor long"), "live")
    keyed = docs.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "doc_id", "text")})
    anchors = keyed.mapInArrow(_anchors(window, bits), "r1 long, r2 long, anchors array<long>").select("r1", "r2", F.posexplode("anchors").alias("block", "anchor"))
    mine = steps.keep(anchors.join(live, "anchor").groupBy("r1", "r2").agg(F.collect_set("block").alias("blocks")), "blocks")
    split = marked_members(keyed, "r1", mine, "maybe")
    doc = F.coalesce("doc_id", F.lit(sys.maxsize)).alias("doc")
    touched = split.filter("maybe").join(mine, ["r1", "r2"], "left").select(F.monotonically_increasing_id().alias("no"), "doc_id", doc, "text", "blocks")
    touched = steps.keep(touched, "touched")
    again = touched.filter("blocks IS NOT NULL")
    smallest = again.mapInArrow(_smallest(window), "h long, least long, most long").groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    smallest = steps.keep(smallest.filter("most > least").select("h", "least"), "smallest")
    located = again.mapInArrow(_located(window), "h long, no long, doc long, place int")
    gone = located.join(smallest, "h").filter("doc > least").groupBy("no").agg(F.collect_list("place").alias("places"))
    cut = steps.keep(touched.join(gone, "no", "left").select("doc_id", "text", "places").mapInArrow(_cut(window), OUT), "cut")
    steps.drop(live, mine, touched, smallest)
    rest = split.filter("NOT maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"))
    return cut.unionByName(rest.mapInArrow(_cut(window), OUT))
