"""Reading and folding change logs.

A log is a DataFrame of key and value columns plus ``_partition``, ``_offset``, ``_timestamp``;
a keyed log also has ``_deleted`` (true for a tombstone, whose value columns are null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# "Last" is the highest offset within one partition. Across partitions offsets do not compare.
WITHIN_PARTITION = ("_offset",)
ACROSS_PARTITIONS = ("_timestamp", "_partition", "_offset")


def last_change(df: DataFrame, keys: Sequence[str], order: Sequence[str] = WITHIN_PARTITION) -> DataFrame:
    """The last record of every key, tombstones included.

    ``row_number() = 1`` plans as a partial group limit before the shuffle, so a key that holds a
    third of the log sends one row per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = WITHIN_PARTITION) -> DataFrame:
    """Current state of a keyed log: the last record per key, keys ending in a tombstone removed."""
    last = last_change(df, keys, order)
    if "_deleted" in df.columns:
        last = last.filter(~F.col("_deleted")).drop("_deleted")
    return last


def compact_log(df: DataFrame, keys: Sequence[str], policy: str = "compact",
                order: Sequence[str] = WITHIN_PARTITION) -> DataFrame:
    """Log after cleanup: ``delete`` keeps every version, the others the last one per key."""
    if policy not in ("delete", "compact", "delete-compact"):
        raise ValueError(f"unknown cleanup policy {policy}")
    return df if policy == "delete" else last_change(df, keys, order)


def with_snapshot(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """One log from an initial snapshot (before every offset) and the changes that follow."""
    rows = snapshot.withColumns({"op": F.lit("r"), "_offset": F.lit(-1).cast("long"), "_deleted": F.lit(False)})
    return rows.unionByName(changes, allowMissingColumns=True)


def unwrap(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Envelope to flat keyed log: the after image, or a tombstone that carries the key only."""
    deleted = F.col("op") == "d"
    image = df.schema["after"].dataType.fieldNames()
    key_cols = [F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in keys]
    values = [F.when(~deleted, F.col(f"after.{c}")).alias(c) for c in image if c not in keys]
    system = [c for c in ("_partition", "_offset", "_timestamp") if c in df.columns]
    return df.select(*key_cols, *values, *system, deleted.alias("_deleted"))


def expand_envelope(df: DataFrame) -> DataFrame:
    """Envelope to signed rows: create/read +after, update -before +after, delete -before."""
    sides = F.array(
        F.struct(F.lit(-1).cast("long").alias("w"), F.col("before").alias("image")),
        F.struct(F.lit(1).cast("long").alias("w"), F.col("after").alias("image")),
    )
    system = [c for c in ("_partition", "_offset", "_timestamp") if c in df.columns]
    rows = df.select("op", *system, F.explode(sides).alias("side"))
    minus = (F.col("side.w") < 0) & F.col("op").isin("u", "d")
    plus = (F.col("side.w") > 0) & (F.col("op") != "d")
    return rows.filter(F.col("side.image").isNotNull() & (minus | plus)).select("side.image.*", *system, F.col("side.w").alias("_w"))


def retract_aggregate(signed: DataFrame, keys: Sequence[str], sums: dict[str, Column],
                      count: str = "n") -> DataFrame:
    """COUNT and SUM from signed rows; a group whose count returns to zero is gone."""
    w = F.col("_w")
    aggs = [F.sum(w).alias(count)] + [F.sum(w * value).alias(name) for name, value in sums.items()]
    return signed.groupBy(*keys).agg(*aggs).filter(F.col(count) != 0)


def signed_diff(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed rows that turn the old rows of some keys into the new ones."""
    minus = old.select(*columns, F.lit(-1).cast("long").alias("_w"))
    return minus.unionByName(new.select(*columns, F.lit(1).cast("long").alias("_w")))


def distinct_records(df: DataFrame) -> DataFrame:
    """One row per (partition, offset): a record delivered twice counts once."""
    return df.dropDuplicates(["_partition", "_offset"])


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def add_system_columns(df: DataFrame, mode: str, scalar_key: Column | None = None,
                       timestamp: Column | str = "_timestamp") -> DataFrame:
    """Serving columns: ``_timestamp`` always, the record position in append mode, ``_key`` for a scalar key."""
    value = [c for c in df.columns if not c.startswith("_")]
    system = ["_partition", "_offset"] if mode == "append" else []
    key = [scalar_key.alias("_key")] if scalar_key is not None and mode == "upsert" else []
    stamp = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return df.select(*key, *value, *system, stamp.alias("_timestamp"))


def offset_guard(batch: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """Records not yet committed. An unknown partition starts at its beginning.

    The offsets table has one row per partition of the topic, so the join is a broadcast.
    """
    if not offsets:
        return batch
    values = ", ".join(f"({int(p)}L, {int(n)}L)" for p, n in offsets.items())
    known = batch.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(_p, _next)")
    return (batch.join(F.broadcast(known), F.col("_partition").cast("long") == F.col("_p"), "left")
            .filter(F.col("_offset") >= F.coalesce(F.col("_next"), F.lit(0)))
            .drop("_p", "_next"))


def next_offsets(batch: DataFrame) -> DataFrame:
    """Per partition: the offset to read next and the newest record time."""
    return batch.groupBy("_partition").agg(
        (F.max("_offset") + 1).alias("next_offset"), F.max("_timestamp").alias("last_record_ts"))


def lag(end_offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Records still to read per topic; null where no end offset is known."""
    behind = F.col("end_offset") - F.coalesce(F.col("next_offset"), F.lit(0))
    gap = F.when(behind.isNotNull(), F.greatest(behind, F.lit(0).cast("long")))
    return (end_offsets.join(committed, ["topic", "_partition"], "left")
            .groupBy("topic").agg(F.sum(gap).alias("lag")))
