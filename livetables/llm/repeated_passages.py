"""Suffix-array dedup: passages of ``length`` bytes that start in more than one place, found by prefix doubling.

Prefix doubling ranks positions by ever longer prefixes: the pair of ranks at p and p + h ranks the prefix of 2h, and a position
whose rank is unique, or whose prefix has reached the threshold, needs no further round. Three things keep this within the size of
the texts instead of rows for every byte and round:

- Ranks are fingerprints. Only equality up to ``length`` bytes is asked for, not the order beyond it, so the rank of a prefix is a 64-bit
  fingerprint of the string: the pair at any offset is known where the text is, and a round is one shuffle that sorts the ranks together
  and drops the unique ones.
- Positions are sampled by content. Of every ``length`` - ``seed`` + 1 consecutive positions, the one whose ``seed``-byte prefix has the least rank is
  an anchor of the passage that starts at the first of them. Equal passages have their anchors at the same place, so ranking anchors
  first loses nothing; passages whose anchor is unique are done.
- Positions go in runs while they agree. A round ranks (a prefix all its passages share, a stretch that holds all its passages whole):
  where the stretch occurs twice, all its positions do; where the shared prefix is unique, none does; only the others are split and
  ranked again.

    round   prefix shared                    stretch
    1       ``seed`` bytes at the anchor            all passages of the anchor (69 positions on average)
    2       ``length`` - ``BLOCK`` + 1 bytes              ``BLOCK`` positions
    3       ``length`` bytes, the threshold          1 position

Equal texts are taken as one: all their passages repeat. Ranks are counted with partial sums, and joined back, so a passage of
a third of all documents is one row per task and rank. Within a document its own places are gathered, which its size bounds.

Fingerprints of different strings are taken as different: 64 bits of a polynomial hash with random byte codes, well mixed; about
one chance in 10^19 per pair compared. Texts are named by 128 bits.

A null text is empty. Texts shorter than ``length`` keep all bytes. Matches never cross documents, and may overlap themselves. Repeated rows get a
row each, and are repeats of each other. An empty table gives an empty result. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import BYTE_CODE, PLACE, Bytes, Steps, column, list_array, mix, signed, slices

LENGTH = 200
SEED = 64
BLOCK = 8
SEGMENT, PLACE_BITS = 1 << 22, 23

_step_back = np.uint64(pow(int(PLACE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((PLACE, _step_back)):
            new = np.full(max(n, 2 * len(_powers[0])) if i == 0 else len(_powers[0]), base, np.uint64)
            new[0] = 1
            _powers[i] = np.cumprod(new, dtype=np.uint64)
    return _powers


class Fingerprints:
    """Fingerprints of substrings of ``data``, each in constant time after one pass."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[:len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least_in_windows(keys: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive keys."""
    out, span = keys, 1
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:-(size - span)], out[size - span:]) if size > span else out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA24BAED4963EE407) + b)


def anchors(b: Bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each anchor: its rank, the rank of its stretch, its row, its place in the row, and its first and last passage (bytes before it)."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sizes = b.lengths()
    n = len(b.data)
    if not (sizes >= length).any():
        return none
    prints = Fingerprints(b.data)
    at = np.arange(n - seed + 1)
    rank = prints.of(at, at + seed)
    # the least rank, the first one of equals: the high bits of a rank above its place within a segment
    span = length - seed + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    parts = []
    for s in range(0, n - length + 1, SEGMENT):
        mine = rank[s:s + SEGMENT + span - 1]
        least = _least_in_windows((mine & ~low) | np.arange(len(mine), dtype=np.uint64), span) & low
        parts.append(least.astype(np.int64) + s)
    least = np.concatenate(parts)
    begins = np.zeros(n + 1, np.int32)
    long_ = sizes >= length
    np.add.at(begins, b.offsets[:-1][long_], 1)
    np.add.at(begins, b.offsets[1:][long_] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(begins)[:len(least)] > 0)
    a = least[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    starts = np.flatnonzero(new)
    first, last, anchor = p[starts], p[np.append(starts[1:], len(p)) - 1], a[starts]
    stretch = _pair(prints.of(first, last + length), ((anchor - first) << 32 | (anchor - last)).astype(np.uint64))
    row = np.searchsorted(b.offsets, anchor, "right") - 1
    return rank[anchor], stretch, row, anchor - b.offsets[row], anchor - first, anchor - last


def _anchor_rows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rank, stretch, row, place, most, least = anchors(Bytes(column(part, "text")), length, seed)
            yield pa.record_batch({"rank": pa.array(signed(rank)), "stretch": pa.array(signed(stretch)), "id": column(part, "id").take(pa.array(row)),
                                   "spot": pa.array(place << 32 | most << 16 | least)})
    return run


def _block_rows(length: int, block: int):
    """Round 2: per block of passages of an unresolved anchor its ranks, and the ranks of its passages for round 3."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            b = Bytes(column(part, "text"))
            lists = column(part, "unresolved")
            count = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            field = lambda name: lists.flatten().field(name).to_numpy(zero_copy_only=False).astype(np.int64)
            rank, spot = field("rank").view(np.uint64), field("spot")
            place, most, least = spot >> 32, spot >> 16 & 0xFFFF, spot & 0xFFFF
            row = np.repeat(np.arange(b.n), count)
            prints = Fingerprints(b.data)
            blocks = most // block - least // block + 1
            which = np.repeat(np.arange(len(place)), blocks)
            number = least[which] // block + np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            anchor = b.offsets[row[which]] + place[which]
            near, far = np.maximum(number * block, least[which]), np.minimum(number * block + block - 1, most[which])
            shared = prints.of(anchor - number * block, anchor - number * block - block + 1 + length)
            core = _pair(_pair(rank[which], number.astype(np.uint64)), shared)
            stretch = _pair(_pair(core, (near << 32 | far).astype(np.uint64)), prints.of(anchor - far, anchor - near + length))
            sizes = far - near + 1
            each = np.repeat(np.arange(len(which)), sizes)
            start = anchor[each] - far[each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            passages = list_array(pa.array(signed(prints.of(start, start + length))), sizes)
            yield pa.record_batch({"core": pa.array(signed(core)), "stretch": pa.array(signed(stretch)), "id": column(part, "id").take(pa.array(row[which])),
                                   "first": pa.array(anchor - far - b.offsets[row[which]]), "passages": passages})
    return run


def _cut(length: int):
    """Per text: what stays, the removed bytes and the maximal removed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            b = Bytes(column(part, "text"))
            raw = b.data.tobytes()
            kept, removed, spans = [], [], []
            for i, (runs, all_) in enumerate(zip(column(part, "runs").to_pylist(), column(part, "all_").to_pylist())):
                start, end = int(b.offsets[i]), int(b.offsets[i + 1])
                merged: list[list[int]] = [[0, end - start]] if all_ else []
                for r in sorted(((r["first"], r["last"] + length) for r in runs or []) if not all_ else []):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                out, at = [], start
                for a, z in merged:
                    out.append(raw[at:start + a])
                    at = start + z
                out.append(raw[at:end])
                kept.append(b"".join(out))
                removed.append(end - start - len(kept[-1]))
                spans.append([{"first": a, "last": z} for a, z in merged])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.record_batch({"t1": column(part, "t1"), "t2": column(part, "t2"), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})
    return run


def distinct_texts(steps: Steps, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, name of the text, n_bytes), and each distinct text once, numbered, with the number of rows that have it."""
    text = F.coalesce("text", F.lit(""))
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, -10).cast("long")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), half(1).alias("t1"), half(17).alias("t2"))
    once = named.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = steps.keep(once.withColumn("id", F.monotonically_increasing_id()), "texts")
    return named.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes")), texts


def repeated_starts(steps: Steps, texts: DataFrame, length: int, seed: int, block: int) -> DataFrame:
    """Per text the runs (first, last) of starts of passages that occur elsewhere; texts are distinct."""
    found = steps.keep(texts.select("id", "text").mapInArrow(_anchor_rows(length, seed), "rank long, stretch long, id long, spot long"), "anchors")
    # round 1
    again = found.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank")
    again = steps.keep(found.join(again, "rank"), "round-1")
    steps.drop(found)
    stretches = steps.keep(again.groupBy("rank", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("id", "spot")).alias("one")), "stretches")
    place = F.shiftright("spot", 32)
    whole = again.join(stretches.filter("n > 1").select("rank", "stretch"), ["rank", "stretch"]).select(
        "id", (place - F.shiftright("spot", 16).bitwiseAND(0xFFFF)).alias("first"), (place - F.col("spot").bitwiseAND(0xFFFF)).alias("last"))
    # round 2: one place of each stretch stands for all of them
    split = stretches.groupBy("rank").agg(F.count("*").alias("different")).filter("different > 1").select("rank")
    split = stretches.join(split, "rank").groupBy("one.id").agg(F.collect_list(F.struct("rank", "one.spot")).alias("unresolved"))
    blocks = split.join(texts.select("id", "text"), "id").select("id", "unresolved", "text")
    blocks = steps.keep(blocks.mapInArrow(_block_rows(length, block), "core long, stretch long, id long, first long, passages array<long>"), "round-2")
    ranks = steps.keep(blocks.groupBy("core", "stretch").agg(F.count("*").alias("n")), "block-ranks")
    blocks_whole = blocks.join(ranks.filter("n > 1").select("core", "stretch"), ["core", "stretch"]) \
        .select("id", "first", (F.col("first") + F.size("passages") - 1).alias("last"))
    # round 3: passages of blocks that share their core with a different block; again one place stands for equal ones
    cores = ranks.groupBy("core").agg(F.count("*").alias("different")).filter("different > 1").select("core")
    third = blocks.join(ranks.join(cores, "core"), ["core", "stretch"]).groupBy("core", "stretch", "n").agg(F.min(F.struct("id", "first", "passages")).alias("one"))
    single = steps.keep(third.select("n", "one.id", "one.first", F.posexplode("one.passages").alias("at", "passage")), "round-3")
    common = single.groupBy("passage").agg(F.count("*").alias("places")).filter("places > 1").select("passage")
    start = F.col("first") + F.col("at")
    rest = single.filter("n = 1").join(common, "passage").select("id", start.alias("first"), start.alias("last"))
    runs = whole.unionByName(blocks_whole).unionByName(rest)
    runs = steps.keep(runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), "runs")
    steps.drop(again, stretches, blocks, ranks, single)
    return runs


def cut_texts(docs: DataFrame, length: int = LENGTH, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t1, t2, n_bytes), and for each distinct text (t1, t2): n_removed, the removed ``spans`` (byte offsets, end exclusive) and the ``kept`` bytes."""
    steps = Steps(docs.sparkSession, "repeated-passages")
    rows, texts = distinct_texts(steps, docs)
    runs = repeated_starts(steps, texts, length, seed, block)
    all_ = (F.col("copies") > 1) & (F.octet_length("text") >= length)
    cut = texts.join(runs, "id", "left").select("t1", "t2", "text", "runs", all_.alias("all_")).mapInArrow(
        _cut(length), "t1 long, t2 long, n_removed long, spans array<struct<first:long,last:long>>, kept binary")
    return rows, cut


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """Per row of (doc_id, text): n_bytes, n_removed, ``spans`` and ``kept``."""
    rows, cut = cut_texts(docs, **options)
    return rows.join(cut, ["t1", "t2"]).select("doc_id", "n_bytes", "n_removed", "spans", "kept")
