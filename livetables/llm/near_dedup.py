"""MinHash near-dedup: bottom-k sketches from one hash function.

1. Each document becomes its set of distinct word shingles, hashed to 63 bits by one hash function. Its sketch is the
   ``k`` smallest values (all of them, where there are at most k). Documents with equal sets form one class, seen from here on
   as one set.
2. Inverted lists: for each retained value, the sets that retain it. A linked pair shares at least ``_least_overlap`` of its retained
   values - certainly where the sketches are whole, otherwise but for about one pair in 10^10 - so each set enters only the
   lists of its rarest n - overlap + 1 values. Short lists give pairs. A list of more than ``list_cap`` sets gives, in one step,
   stars around its most common members; then only pairs of sets that are still in different components are left to find, and these
   come from the full sets (step 4). Each list entry carries a bitmap of its set's retained values; two bitmaps bound the overlap from
   above, so a pair that cannot overlap enough is ruled out by the join that would make it.
3. Union sketch: the k smallest values of both sketches together, and the share of them that both have, estimate the
   similarity. Pairs that the estimate puts clearly below the threshold go. Exact similarity of the full sets decides on the
   rest.
4. The sets of long lists are joined once more without any sketch: their shingles are counted among them, each set is listed under
   the rarest of its shingles (prefix filter: enough of them that a linked pair must meet), and sizes, places in that order and bitmaps of
   the full sets bound the overlap before a pair is made. Pairs within one component are left out. Exact similarity decides. What a list
   compares inside the join still grows with the square of those of its members that stay in different components; what it makes does not.
5. Components of the links give each document the smallest doc_id it can reach.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. With fewer than ``shingle`` words the whole sequence is one shingle. Null and empty texts, and
texts without words, have an empty set and are linked with nothing. Repeated rows get a row each and are linked. A null doc_id is
larger than any other; a group of nulls only has a null component. Columns beyond doc_id and text are ignored, or kept by
``without_near_copies``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from livetables.llm.base import LOWER, NOT_SPACE, Bytes, Steps, Words, column, distinct_in_rows, free_name, list_array, mix, probable_members, row_key, signed, slices, windows
from livetables.llm.components import components

SHINGLE = 5
PERCENT = 80
K = 64
LIST_CAP = 64
STAR = 3
MISS = 1e-10
SKETCH_BITS = 512        # of the bitmap of the retained values
SET_BITS = 512           # of each of the two bitmaps of a full set

SKETCHES = "doc_id long, row_key string, n long, s1 long, s2 long, sketch array<long>, bits array<long>, over long"
MAPS = "id long, once array<long>, twice array<long>, more long"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes and their rows, ordered by row and hash."""
    b = Bytes(texts)
    data, w = LOWER[b.data], Words(b, NOT_SPACE)
    h, row = windows(w.hashes(data), w, size)
    h, row = distinct_in_rows(h >> np.uint64(1), row)
    return h, row, b.n


def bitmaps(h: np.ndarray, row: np.ndarray, n: int, bits: int, levels: int) -> tuple[list[pa.Array], pa.Array]:
    """Per row, for each level the places that at least so many values fall on, and how many values are in no level.

    Two sets share at most as many values as the levels have places in common, and the lesser of what is in no level.
    """
    at = (h & np.uint64(bits - 1)).astype(np.int64)
    count = np.bincount(row * bits + at, minlength=n * bits).reshape(n, bits)
    pack = lambda level: pa.array(np.packbits(count >= level, axis=1, bitorder="little").view(np.int64).ravel())
    return [list_array(pack(i + 1), np.full(n, bits // 64)) for i in range(levels)], pa.array(np.maximum(count - levels, 0).sum(axis=1))


SKETCH_MAP, SET_MAP = [f"bits{i}" for i in range(SKETCH_BITS // 64)], [f"{level}{i}" for level in ("once", "twice") for i in range(SET_BITS // 64)]


def _flat(*levels: str, bits: int):
    """The words of bitmaps as columns of their own: a condition over arrays of them would be too long to be compiled."""
    return [F.col(c)[i].alias(f"{c}{i}") for c in levels for i in range(bits // 64)]


def _in_common(x: str, y: str, words: list[str], over: str):
    """The most values that two sets can share, by their bitmaps."""
    return reduce(add, [F.bit_count(F.col(f"{x}.{w}").bitwiseAND(F.col(f"{y}.{w}"))) for w in words]) + F.least(f"{x}.{over}", f"{y}.{over}")


def sketches(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        h, row, n = shingle_sets(column(part, "text"), size)
        count = np.bincount(row, minlength=n).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        small = np.arange(len(h)) - first[row] < k
        digest = []
        for seed in (np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ seed), dtype=np.uint64)])
            digest.append(signed(total[first[1:]] - total[first[:-1]]))
        (bits,), over = bitmaps(h[small], row[small], n, SKETCH_BITS, 1)
        yield pa.record_batch({"doc_id": column(part, "doc_id"), "row_key": column(part, "row_key"), "n": pa.array(count), "s1": pa.array(digest[0]),
                               "s2": pa.array(digest[1]), "sketch": list_array(pa.array(signed(h[small])), np.minimum(count, k)), "bits": bits, "over": over})


def _least_overlap(k: int, percent: int) -> int:
    """The most retained values that a linked pair of large sets can be relied on to share: P(fewer) < ``MISS``."""
    p, q, total, t = percent / 100, 1 - percent / 100, 0.0, 0
    while t <= k:
        total += comb(k, t) * p**t * q**(k - t)
        if total >= MISS:
            return t
        t += 1
    return k


def _sizes_fit(a: str, b: str, percent: int):
    """Sets of these sizes can be similar enough: the smaller has at least ``percent`` of the larger."""
    return (100 * F.col(f"{a}.n") >= percent * F.col(f"{b}.n")) & (100 * F.col(f"{b}.n") >= percent * F.col(f"{a}.n"))


def _estimated(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that the union sketch does not rule out."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    enough = F.when(whole, 100 * F.size(F.array_intersect("sketch_a", "sketch_b")) >= percent * F.size(F.array_union("sketch_a", "sketch_b"))) \
        .otherwise(shared >= F.least(F.lit(_least_overlap(k, percent)), F.size(union)))
    return both.filter(enough).select("a", "b")


def _similar(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough, from (a, b, text_a, text_b)."""
    for part in slices(batches, "text_a", "text_b"):
        ha, ra, n = shingle_sets(column(part, "text_a"), size)
        hb, rb, _ = shingle_sets(column(part, "text_b"), size)
        h, r = np.concatenate([ha, hb]), np.concatenate([ra, rb])
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
        union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
        linked = pa.array(100 * both >= percent * union)
        yield pa.record_batch({"a": column(part, "a").filter(linked), "b": column(part, "b").filter(linked)})


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Exact check; ``texts`` has id and text."""
    pairs = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _similar(it, size, percent), "a long, b long")


def _full_lists(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        h, row, _ = shingle_sets(column(part, "text"), size)
        yield pa.record_batch({"id": column(part, "id").take(pa.array(row)), "value": pa.array(signed(h))})


def _full_maps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        h, row, n = shingle_sets(column(part, "text"), size)
        (once, twice), more = bitmaps(h, row, n, SET_BITS, 2)
        yield pa.record_batch({"id": column(part, "id"), "once": once, "twice": twice, "more": more})


def _sketches_fit(x: str, y: str):
    """The bitmaps of the retained values allow the overlap that a linked pair has."""
    return _in_common(x, y, SKETCH_MAP, "over") >= F.greatest(f"{x}.need", f"{y}.need")


def _pair(x: str, y: str):
    return F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")


def _cross_pairs(steps: Steps, texts: DataFrame, sets: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of sets in different components whose full sets may be similar enough (step 4)."""
    maps = texts.mapInArrow(lambda it: _full_maps(it, size), MAPS)
    members = sets.select("id", "n").join(roots, F.col("id") == F.col("node"), "left").join(maps, "id") \
        .select("id", "n", *_flat("once", "twice", bits=SET_BITS), "more", F.coalesce("root", "id").alias("root"))
    values = steps.keep(texts.mapInArrow(lambda it: _full_lists(it, size), "id long, value long"), "values")
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("id")
    shared = values.join(common, "value").withColumn("place", F.row_number().over(own.orderBy("df", "value"))).withColumn("n_shared", F.count("*").over(own))
    # the values that no other set has come first in the order by rarity: they make no list, but take places
    placed = shared.join(members, "id").withColumn("place", F.col("place") + F.col("n") - F.col("n_shared"))
    # a linked pair overlaps in ``percent`` of the larger set, and in 2 p / (1 + p) of the smaller one
    prefix = placed.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    lists = steps.keep(prefix.select("value", "id", "n", "root", "place", *SET_MAP, "more"), "prefixes")
    steps.drop(values)
    smaller = lists.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1)
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1     # where this is the first value they share
    apart = (F.col("x.value") == F.col("y.value")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.n")) \
        & (100 * F.col("x.n") >= percent * F.col("y.n")) & (most >= need) \
        & (_in_common("x", "y", SET_MAP, "more") >= need)
    return smaller.alias("x").join(lists.alias("y"), apart).select(*_pair("x", "y")).distinct()


def sketch_table(steps: Steps, docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """One row per document, with its set's size, digest and sketch; ``g`` names the class of equal sets, null for an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), "text")
    rows = docs.mapInArrow(lambda it: sketches(it, shingle, k), SKETCHES)
    g = F.when(F.col("n") > 0, F.concat(F.hex("s1"), F.lpad(F.hex("s2"), 16, "0"), F.lit("."), F.col("n").cast("string")))
    return steps.keep(rows.select("doc_id", "row_key", "n", g.alias("g"), "sketch", "bits", "over"), "sketches")


def set_table(steps: Steps, table: DataFrame, percent: int, k: int) -> DataFrame:
    """One row per class of equal sets, with a number; ``need`` is the least overlap of its sketch with one it is linked to."""
    one = table.filter("g IS NOT NULL").groupBy("g").agg(F.min(F.struct("row_key", "n", "sketch", "bits", "over")).alias("s"))
    need = F.when(F.col("s.n") <= k * percent // 100, F.ceil(F.col("s.n") * percent / 100)).otherwise(F.lit(_least_overlap(k, percent)))
    return steps.keep(one.select(F.monotonically_increasing_id().alias("id"), "g", "s.row_key", "s.n", "s.sketch", "s.bits", "s.over", need.alias("need")), "sets")


def link_sets(steps: Steps, docs: DataFrame, sets: DataFrame, shingle: int, percent: int, k: int, list_cap: int) -> DataFrame:
    """(node, root) over the sets that are linked with another one."""
    values = steps.keep(sets.select("id", "n", F.explode("sketch").alias("value")), "values")
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("id")
    shared = values.join(common, "value").withColumn("place", F.row_number().over(own.orderBy("df", "value"))).withColumn("n_shared", F.count("*").over(own))
    kept = F.least(F.col("n"), F.lit(k))
    shared = shared.withColumn("alone", kept - F.col("n_shared"))
    entries = shared.join(sets.select("id", *_flat("bits", bits=SKETCH_BITS), "over", "need"), "id").filter(F.col("place") + F.col("alone") <= kept - F.col("need") + 1)
    lists = steps.keep(entries.select("value", "id", "n", "alone", *SKETCH_MAP, "over", "need"), "lists")
    steps.drop(values)
    lengths = lists.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    short = lists.join(lengths.filter(F.col("members") <= list_cap), "value")
    crowded = steps.keep(lists.join(lengths.filter(F.col("members") > list_cap), "value"), "long-lists")
    meet = (F.col("x.value") == F.col("y.value")) & _sizes_fit("x", "y", percent) & _sketches_fit("x", "y")
    pairs = short.alias("x").join(short.alias("y"), meet & (F.col("x.id") < F.col("y.id")))
    # the members with the fewest values of their own stand in the middle of a long list
    entry = ["id", "n", *SKETCH_MAP, "over", "need"]
    centre = crowded.groupBy("value").agg(*[F.min(F.struct("alone", F.xxhash64("id", F.lit(i)).alias("h"), *entry)).alias(f"c{i}") for i in range(STAR)])
    centre = centre.select("value", F.explode(F.array_distinct(F.array(*[F.struct(*[f"c{i}.{c}" for c in entry]) for i in range(STAR)]))).alias("c")).select("value", "c.*")
    # a member is compared in a few of its lists, which near copies choose alike; what that leaves open is found from the full sets
    place = lambda *order: F.row_number().over(own.orderBy(*order, "value"))
    chosen = crowded.withColumn("by_value", place()).withColumn("by_size", place("members")).withColumn("from_largest", place(F.desc("members"))) \
        .filter("by_value <= 2 OR by_size = 1 OR from_largest = 1")
    star = chosen.alias("x").join(centre.alias("y"), meet & (F.col("x.id") != F.col("y.id")))
    candidates = steps.keep(pairs.select(*_pair("x", "y")).unionByName(star.select(*_pair("x", "y"))).distinct(), "candidates")
    pairs = steps.keep(_estimated(candidates, sets, k, percent), "pairs")
    steps.drop(lists, candidates)
    crowd = steps.keep(crowded.select("id").distinct(), "crowd")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowd).distinct()
    wanted = steps.keep(sets.join(wanted, "id").select("id", "row_key"), "wanted")
    keyed = docs.select(row_key("doc_id", "text").alias("row_key"), "text")
    texts = probable_members(keyed, "row_key", wanted).join(wanted, "row_key").dropDuplicates(["id"]).select("id", "text")
    texts = steps.keep(texts, "texts")
    links = steps.keep(_verified(pairs, texts, shingle, percent), "links")
    roots = components(steps, links)
    steps.drop(pairs, crowded, wanted)
    if not crowd.isEmpty():
        cross = steps.keep(_cross_pairs(steps, texts.join(crowd, "id"), sets.join(crowd, "id"), roots, shingle, percent), "pairs")
        more = steps.keep(_verified(cross, texts, shingle, percent), "links")
        roots = components(steps, links.unionByName(more))
        steps.drop(cross, more)
    steps.drop(crowd, texts, links)
    return roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = K, list_cap: int = LIST_CAP) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, component_id, kept (doc_id = component_id), row_key, and ``group_id``, the number of the group."""
    steps = Steps(docs.sparkSession, "near-dedup")
    table = sketch_table(steps, docs, shingle, k)
    sets = set_table(steps, table, percent, k)
    roots = link_sets(steps, docs, sets, shingle, percent, k, list_cap)
    group = steps.keep(sets.select("id", F.col("g").alias("_g")).join(roots, F.col("id") == F.col("node"), "left")
                       .select("_g", F.coalesce("root", "id").alias("group_id")), "groups")
    named = table.select("doc_id", "row_key", "n", "g").join(group, F.col("g") == F.col("_g"), "left")
    least = named.filter("group_id IS NOT NULL").groupBy(F.col("group_id").alias("_id")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, F.col("group_id") == F.col("_id"), "left")
    component = F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row_key", "group_id")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns: one row of each group, the one with the smallest doc_id, and every row with an empty set."""
    steps = Steps(docs.sparkSession, "near-dedup")
    key = free_name(docs.columns, "row_key")
    found = near_duplicates(docs, **options).filter("group_id IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("o")
    chosen = steps.keep(found.groupBy("group_id").agg(first).select(F.col("o.row_key").alias(key)), "chosen")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(has_words).withColumn(key, row_key("doc_id", "text"))
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).select(*docs.columns).unionByName(docs.filter(~has_words))
