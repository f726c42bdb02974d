"""What the text operators share: session settings, steps in the shared folder, and word arithmetic on Arrow batches.

The arithmetic works on the UTF-8 bytes of a slice of rows at a time (``SLICE_BYTES``, at least one row), so memory
follows the longest text and not the partition. Words are given a 64-bit hash; equal words always have equal hashes.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

import livetables
from livetables.session import configure, workdir

ARCHIVE = "livetables.zip"
FILTER_BITS = 1 << 26
SLICE_BYTES = 2 << 20
LLM_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # a step is written before the next one starts, so its shuffle files are of no more use
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that it need not be installed on the executors."""
    if ARCHIVE in spark.sparkContext._python_includes:
        return
    package = Path(livetables.__file__).parent
    path = f"{tempfile.mkdtemp(prefix='ship-')}/{ARCHIVE}"        # on the driver, which serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def ready(spark: SparkSession) -> SparkSession:
    configure(spark)
    ship(spark)
    for key, value in LLM_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Steps:
    """Written intermediate tables below the cluster's shared folder: cut lineage, survive lost executors.

    ``keep`` writes and rereads a frame; ``drop`` deletes one that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, workdir(spark, label), 0

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._step_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _bloom(key: str, members: DataFrame) -> np.ndarray:
    """The words of a Bloom filter of ``FILTER_BITS`` bits."""
    bit = members.select(F.explode(F.array(*_bloom_hashes(key))).alias("h")).select(F.pmod("h", F.lit(FILTER_BITS)).alias("b"))
    words = bit.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v")).toArrow()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[words["w"].to_numpy()] = words["v"].to_numpy()
    return filled.view(np.uint64)


def _bloom_hashes(key: str):
    return [F.xxhash64(F.col(key), F.lit(i)) for i in range(3)]


def marked_members(df: DataFrame, key: str, members: DataFrame, mark: str) -> DataFrame:
    """``df`` with a flag ``mark``: the row's ``key`` is in ``members``, or one of a few others. The Bloom filter has a fixed size
    (``FILTER_BITS``); with more members than it can tell apart it flags more rows, never fewer.
    """
    shared, columns = df.sparkSession.sparkContext.broadcast(_bloom(key, members)), df.columns

    def run(it):
        for batch in it:
            may = np.ones(batch.num_rows, bool)
            for i in range(3):
                b = column(batch, f"_h{i}").to_numpy() % FILTER_BITS
                may &= (shared.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, pa.array(may)], [*columns, mark])
    return df.select("*", *[h.alias(f"_h{i}") for i, h in enumerate(_bloom_hashes(key))]).mapInArrow(run, StructType([*df.schema, StructField(mark, BooleanType())]))


def probable_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``members``, and a few others: a Bloom filter before an exact join, so that a large row that finds no partner is not
    shuffled.
    """
    mark = free_name(df.columns, "may")
    return marked_members(df, key, members, mark).filter(F.col(mark)).drop(mark)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(text: str = "text"):
    """With the doc_id, the identity of a row: rows that agree in both are repeats of each other."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_key(*columns: str):
    """A digest of the given columns: rows that agree in all of them are repeats of each other. Nulls differ from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    sizes = [F.char_length(p).cast("string") for p in parts[:-1]]     # so that the borders between columns count
    return F.md5(F.concat(*[x for p, n in zip(parts, sizes) for x in (n, F.lit(":"), p)], parts[-1]))


def held_out(doc_id: str = "doc_id"):
    """The test fold: crc32 of the id as text leaves 1 when divided by 3. A null id is in no fold and counts as learned from nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


# ---- bytes and words of a batch ---------------------------------------------------------------------------------------

def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE                                            # [^\x20\x09-\x0D]
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))     # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64(0x9E3779B97F4A7C15)
_places = np.ones(1, np.uint64)


def places(n: int) -> np.ndarray:
    """Powers of ``PLACE`` modulo 2^64, at least ``n`` of them."""
    global _places
    if len(_places) < n:
        new = np.full(max(n, 2 * len(_places)), PLACE, np.uint64)
        new[0] = 1
        _places = np.cumprod(new, dtype=np.uint64)
    return _places


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Bytes:
    """The UTF-8 bytes of a string array: ``data`` and, per row, ``offsets``. A null is an empty text."""

    def __init__(self, column: pa.Array):
        if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
            column = column.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int32)[column.offset:column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        self.offsets = offsets - first
        self.n = n

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


class Words:
    """Maximal runs of the bytes of ``kind``, never across rows: ``start``, ``end`` and ``row`` per word."""

    def __init__(self, b: Bytes, kind: np.ndarray):
        d, self.kind = b.data, kind
        inside = np.zeros(len(d) + 1, bool)
        inside[:-1] = kind[d]
        new_row = np.zeros(len(d) + 1, bool)
        new_row[b.offsets] = True
        before = np.zeros(len(d) + 1, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | new_row))
        self.end = np.flatnonzero(before & (~inside | new_row))
        self.row = np.searchsorted(b.offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=b.n).astype(np.int64)
        self.first = np.zeros(b.n + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])

    def hashes(self, data: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        first = int(self.start[0])
        segment = np.diff(np.append(self.start, len(data)))      # a word and what follows it up to the next
        place = np.arange(len(data) - first) - np.repeat(self.start - first, segment)
        code = np.where(self.kind, BYTE_CODE, np.uint64(0))[data[first:]] * places(int(segment.max()))[place]
        return mix(np.add.reduceat(code, self.start - first) + (self.end - self.start).astype(np.uint64))


def windows(word_hash: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``size`` words; a row with fewer words, but not none, has its whole sequence as one."""
    factor = places(size + 1)[1:size + 1] | np.uint64(1)
    n = len(word_hash)
    out_h, out_r = [], []
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            h += word_hash[j:n - size + 1 + j] * factor[j]
        whole = words.row[:n - size + 1] == words.row[size - 1:]
        out_h.append(mix(h[whole] + np.uint64(size)))
        out_r.append(words.row[:n - size + 1][whole])
    for length in range(1, size):
        rows = np.flatnonzero(words.count == length)
        if len(rows):
            h = np.zeros(len(rows), np.uint64)
            for j in range(length):
                h += word_hash[words.first[rows] + j] * factor[j]
            out_h.append(mix(h + np.uint64(length)))
            out_r.append(rows)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r)


def distinct_in_rows(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, ordered by row and then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, row


def slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``SLICE_BYTES`` bytes in the given string columns, or one row."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            sizes += Bytes(batch.column(batch.schema.get_field_index(name))).lengths()
        start, total = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if i > start and total + s > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += s
        if batch.num_rows > start:
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
