"""Mixing sources to target weights along a time-varying curriculum.

Targets. Each source has a weight; all sources share the words of the corpus in proportion. A source gives at most
``MAX_EPOCHS`` times its own words, and what it cannot give is shared again by weight until no target is above.

Positions. Training time runs from 0 to 1. A source's schedule says how its share of the mix changes over that time: knots
(time, rate), linear between them. The integral of the rate, scaled to the target, is the source's cumulative demand in words.
Its documents stand in a fixed pseudo-random order, as often as needed; the one that crosses the target is cut there. The
copy that covers words c to c + n of this sequence gets the time at which the demand reaches c + n / 2, the inverse of the
integral. Sorting all copies by range of that position mixes the sources.

No step brings a source together in one task: running totals are taken in two levels, over ranges of rows and within them, and
only per-source sums are collected, as three numbers per round.

A null text has size 0. Null is a source of its own, the last. Sizes of 0 take nothing. Repeated rows are documents of their
own; which of two equal rows gets the last words of a target is not defined, everything else is the same on each run. An empty
table gives an empty result. Columns beyond those named are ignored, or kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from livetables.llm.base import Steps, free_name, row_key

WEIGHTS = [1, 2, 3]
MAX_EPOCHS = 3
# per weight, in turn: light sources come early, heavy ones late
SCHEDULES = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]]


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_before(steps: Steps, df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``_before``: the sum of ``value`` over the rows of the same keys that stand before."""
    ranged = steps.keep(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in keys + order]).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_range").alias("_p_range"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_earlier"))
    same = F.col("_range") == F.col("_p_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(parts, same).withColumn("_before", F.col("_earlier") + F.col("_inside")).select(*df.columns, "_before")


def source_targets(steps: Steps, sized: DataFrame, weights: list[int] = WEIGHTS) -> DataFrame:
    """source, source_size, turn (which weight and schedule), target."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = running_before(steps, sums, [], ["source"], "_one").drop("_one")
    turn = (F.col("_before") % len(weights)).cast("int")
    sources = steps.keep(ranked.select("source", "source_size", turn.alias("turn"), F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, weight = int(total[0]), int(total[1])
    full = F.lit(False)
    while True:
        full = F.col("weight") * F.lit(rest) > MAX_EPOCHS * F.col("source_size") * F.lit(weight) if weight else F.lit(True)
        size, w = sources.filter(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        new = int(total[0]) - MAX_EPOCHS * int(size), int(total[1]) - int(w)
        if new == (rest, weight) or not weight:
            break
        rest, weight = new
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(max(weight, 1)))
    return sources.select("source", "source_size", "turn", F.when(full, (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def integral(schedule: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Segments (time from, time to, rate from, rate to, demand before), with the whole demand scaled to 1."""
    area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
        out.append((t0, t1, r0 / area, r1 / area, done))
        done += (t1 - t0) * (r0 + r1) / 2 / area
    return out


def time_of(demand: Column, schedule: list[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches ``demand`` (0 to 1)."""
    out = None
    for t0, t1, r0, r1, done in reversed(integral(schedule)):
        slope = (r1 - r0) / (t1 - t0)
        u = demand - F.lit(done)
        if slope == 0:
            at = F.lit(t0) + u / F.lit(r0)
        else:   # r0 x + slope x^2 / 2 = u
            at = F.lit(t0) + (F.sqrt(F.greatest(F.lit(r0 * r0) + u * F.lit(2 * slope), F.lit(0.0))) - F.lit(r0)) / F.lit(slope)
        at = F.least(at, F.lit(t1))
        out = at if out is None else F.when(demand < F.lit(done + (t1 - t0) * (r0 + r1) / 2), at).otherwise(out)
    return out


def allocate(docs: DataFrame, weights: list[int] = WEIGHTS, schedules: list[list[tuple[float, float]]] = SCHEDULES, seed: str = "") -> DataFrame:
    """Per row of (doc_id, source, text): size, source_size, target, taken, and its ``copies`` (copy, words, position)."""
    steps = Steps(docs.sparkSession, "mixing")
    sized = steps.keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", row_key("doc_id", "source", "text").alias("row_key"), words_in(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))).alias("_order")), "sizes")
    targets = steps.keep(source_targets(steps, sized, weights), "targets").withColumnRenamed("source", "_s")
    placed = running_before(steps, sized, ["source"], ["_order", "doc_id", "row_key"], "size").join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quota = F.floor(F.col("target") + 0.5)
    start = lambda c: F.col("_before") + F.col("source_size") * c
    words = lambda c: F.least(F.greatest(quota - start(c), F.lit(0)), F.col("size"))
    middle = lambda c: (start(c) + words(c) / 2) / quota
    position = lambda c: F.element_at(F.array(*[F.when(F.col("turn") == i, time_of(middle(c), s)) for i, s in enumerate(schedules)]), F.col("turn") + 1)
    copies = F.filter(F.array(*[F.struct(F.lit(c).alias("copy"), words(c).cast("long").alias("words"),
                                         F.when(words(c) > 0, position(c)).alias("position")) for c in range(MAX_EPOCHS)]), lambda x: x["words"] > 0)
    out = placed.withColumn("copies", copies)
    return out.select("doc_id", "source", "row_key", "size", "source_size", "target",
                      F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix in training order: the columns of ``docs``, once per copy, with ``copy``, ``words`` (taken from the start of the text) and ``position``.

    Rows equal in doc_id, source and text are repeats; their copies carry the other columns of one of them.
    """
    names = {n: free_name(docs.columns, n) for n in ("copy", "words", "position")}
    key = free_name(docs.columns, "row_key")
    copies = allocate(docs, **options).filter("taken > 0").select(F.col("row_key").alias(key), F.explode("copies").alias("_c"))
    copies = copies.select(key, *[F.col(f"_c.{n}").alias(names[n]) for n in names])
    rows = docs.withColumn(key, row_key("doc_id", "source", "text")).dropDuplicates([key])
    return rows.join(copies, key).orderBy(names["position"], key, names["copy"]).select(*docs.columns, *names.values())
