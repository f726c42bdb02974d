"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. ``statistics`` reads each whole text once and gives a short vector: lengths, shares of kinds of characters, of distinct and repeated words, of
   repeated lines, and the like. It is the only input of a score.
2. Standardised by the mean and deviation of the fitted rows, the vector is mapped to cosines of random projections, whose inner
   products approximate a Gaussian kernel.
3. Each partition of the labelled rows sums its part of the normal equations; the sums are added and solved with a ridge.
4. Pool-adjacent-violators on other labelled rows than those of the fit turns the ridge scores into rising probabilities; between
   the centres of pools the score is interpolated.

Labelled rows are a bounded sample (``max_labelled``, in the order of a hash of doc_id), and only they are broadcast and
gathered, as numbers. Rows of the test fold are never used. Of the rest, those whose crc32 leaves 0 are fitted, those that leave 2
calibrate.

Null and empty texts have a vector of zeros and get a score like any other. Repeated rows get a row each. Null labels are
ignored; of several labels of a doc_id the lowest counts. Without labels of both kinds every score is 0.5. An empty table gives an empty result.
Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import LOWER, NOT_SPACE, Bytes, Steps, Words, byte_set, column, distinct_in_rows, held_out, list_array, slices, windows

MAX_LABELLED = 30_000
DIMENSIONS = 256
RIDGE = 1e-3
CLIP = 6.0
PARTITIONS = 16

UPPER, DIGITS, HIGH = byte_set((0x41, 0x5A)), byte_set((0x30, 0x39)), byte_set((0x80, 0xFF))
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SYMBOLS = byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
MARKS = byte_set(*[(ord(c), ord(c)) for c in "!?"])
STOPS = byte_set(*[(ord(c), ord(c)) for c in ".,;:"])
NEWLINE = byte_set((0x0A, 0x0A))

NAMES = ["bytes", "words", "lines", "word_length", "word_spread", "line_words", "upper", "digits", "symbols", "marks", "stops", "high", "letters", "distinct",
         "repeated_next", "repeated_windows", "repeated_lines", "most_common", "bare_symbols", "short_lines"]


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    b = Bytes(texts)
    d, n = LOWER[b.data], b.n
    w, lines = Words(b, NOT_SPACE), Words(b, ~NEWLINE)
    h = w.hashes(d)
    size, words, n_lines = b.lengths(), w.count, lines.count
    per_word = lambda x: x / np.maximum(words, 1)
    per_byte = lambda x: x / np.maximum(size, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = per_word(np.bincount(w.row, length, n))
    spread = np.sqrt(np.maximum(per_word(np.bincount(w.row, length**2, n)) - mean**2, 0))
    # the same word set often in a row: its share, and that of the most common one
    order = np.lexsort((h, w.row))
    sh, sr = h[order], w.row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(sh)))
    most = np.zeros(n)
    np.maximum.at(most, sr[starts], runs)
    distinct = np.bincount(sr[starts], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    wh, wr = windows(h, w, 3)
    n_windows, n_distinct = np.bincount(wr, minlength=n), np.bincount(distinct_in_rows(wh, wr)[1], minlength=n)
    lh = lines.hashes(d)
    distinct_lines = np.bincount(distinct_in_rows(lh, lines.row)[1], minlength=n)
    bare = np.add.reduceat(LETTERS[b.data].astype(np.int64), w.start) == 0 if len(w.start) else np.zeros(0, bool)
    short = np.bincount(lines.row[(lines.end - lines.start) < 20], minlength=n)
    out = [np.log1p(size), np.log1p(words), np.log1p(n_lines), mean, spread, np.log1p(words / np.maximum(n_lines, 1)), per_byte(_per_row(UPPER[b.data], b.offsets)),
           per_word(_per_row(DIGITS[b.data], b.offsets)), per_word(_per_row(SYMBOLS[b.data], b.offsets)), per_word(_per_row(MARKS[b.data], b.offsets)),
           per_word(_per_row(STOPS[b.data], b.offsets)), per_byte(_per_row(HIGH[b.data], b.offsets)), per_byte(_per_row(LETTERS[b.data], b.offsets)), per_word(distinct),
           per_word(np.bincount(w.row[again], minlength=n)), 1 - n_distinct / np.maximum(n_windows, 1) - (n_windows == 0), 1 - distinct_lines / np.maximum(n_lines, 1) - (n_lines == 0),
           per_word(most), per_word(np.bincount(w.row[bare], minlength=n)), short / np.maximum(n_lines, 1)]
    return np.column_stack(out).astype(np.float64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        x = statistics(column(part, "text"))
        yield pa.record_batch({"fold": column(part, "fold"), "y": column(part, "y"), "x": list_array(pa.array(x.ravel()), np.full(len(x), x.shape[1]))})


@dataclass
class Model:
    """A fitted scorer; ``points`` are (ridge score, probability) pairs, rising in both."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    points: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.column_stack([np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def ridge_score(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge_score(x), self.points[:, 0], self.points[:, 1])


def isotonic(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pools of rising mean: (mean score, mean label) each, ties of the score pooled first, ends drawn out to 0 and 1."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], y[order].astype(np.float64)
    values, first, count = np.unique(s, return_index=True, return_counts=True)
    pools: list[list[float]] = []
    for v, total, n in zip(values.tolist(), np.add.reduceat(y, first).tolist(), count.tolist()):
        pools.append([v * n, total, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    # one label of each kind per pool keeps small pools from being certain
    p = np.array([[a / n, (t + 0.5) / (n + 1)] for a, t, n in pools])
    p[:, 1] = np.maximum.accumulate(p[:, 1])
    low, high = p[0], p[-1]
    return np.vstack([[low[0] - 1, low[1] / 2], p, [high[0] + 1, (1 + high[1]) / 2]])


def _normal_sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.phase) + 1
        gram, right, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            z = model.fourier(_matrix(batch))
            y = np.asarray(column(batch, "y").to_numpy(zero_copy_only=False), np.float64)
            gram += z.T @ z
            right += z.T @ (y * 2 - 1)
            n += len(y)
        yield pa.record_batch({"gram": pa.array([gram.tobytes()], pa.binary()), "right": pa.array([right.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})
    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, seed: int = 7) -> Model | None:
    """A model from labelled rows outside the test fold, or None without labels of both kinds."""
    steps = Steps(docs.sparkSession, "quality-classifier")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"))
    few = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    rows = rows.select((F.crc32(F.col("doc_id").cast("string")) % 3).cast("int").alias("fold"), F.when(F.col("y") != 0, 1).otherwise(0).alias("y"), "text")
    points = steps.keep(rows.mapInArrow(_vectors, "fold int, y int, x array<double>").repartition(PARTITIONS), "vectors")
    fit, held = points.filter("fold = 0"), points.filter("fold = 2")
    if fit.select("y").distinct().count() < 2 or held.isEmpty():
        fit = held = points
    if fit.select("y").distinct().count() < 2:
        return None
    moments = fit.select(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(NAMES))], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(NAMES))]).first()
    mean, scale = np.array(moments[:len(NAMES)]), np.array(moments[len(NAMES):])
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(len(NAMES)), (len(NAMES), dimensions)),
                  rng.uniform(0, 2 * np.pi, dimensions), np.zeros(dimensions + 1), np.array([[0.0, 0.5], [1.0, 0.5]]))
    sums = fit.mapInArrow(_normal_sums(model), "gram binary, right binary, n long").collect()     # at most PARTITIONS rows or so, each of fixed size
    d = dimensions + 1
    gram = sum(np.frombuffer(r.gram).reshape(d, d) for r in sums)
    right = sum(np.frombuffer(r.right) for r in sums)
    model.weights = np.linalg.solve(gram + RIDGE * sum(r.n for r in sums) / d * np.eye(d), right)

    def ridge(batches):
        for batch in batches:
            yield pa.record_batch({"s": pa.array(model.ridge_score(_matrix(batch))), "y": column(batch, "y")})
    scored = held.mapInArrow(ridge, "s double, y int").collect()
    model.points = isotonic(np.array([r.s for r in scored]), np.array([r.y for r in scored]))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            m = shared.value
            s = m.score(statistics(column(part, "text"))) if m else np.full(part.num_rows, 0.5)
            yield pa.record_batch({"doc_id": column(part, "doc_id"), "score": pa.array(np.clip(s, 0.0, 1.0))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
