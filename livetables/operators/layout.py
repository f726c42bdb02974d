"""Table layouts: key columns, value columns, system columns, and how they evolve."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampNTZType

UPSERT, APPEND = "upsert", "append"

# The system columns and their place in a layout.
RECORD_POSITION = (StructField("_partition", IntegerType(), False), StructField("_offset", LongType(), False))
SCALAR_KEY = "_key"


class LayoutError(ValueError):
    """A schema that a table cannot take."""


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...] = ()
    schema: StructType = field(default_factory=StructType)

    def to_json(self) -> dict:
        return {"keys": list(self.keys), "schema": json.loads(self.schema.json())}

    @staticmethod
    def from_json(value: dict) -> "Layout":
        return Layout(tuple(value["keys"]), StructType.fromJson(value["schema"]))


def infer_mode(keys: Sequence[str], compacted: bool, mode: str | None = None) -> str:
    """An explicit mode wins; otherwise a compacted topic is upsert. Upsert needs a key."""
    chosen = mode or (UPSERT if compacted else APPEND)
    if chosen not in (UPSERT, APPEND):
        raise LayoutError(f"unknown mode {chosen}")
    if chosen == UPSERT and not keys:
        raise LayoutError("upsert mode needs a key")
    return chosen


def layout_of(mode: str, key_schema: StructType, value_schema: StructType, timestamp=TimestampNTZType()) -> Layout:
    """Key columns first (upsert), then value columns, then the system columns."""
    fields: dict[str, StructField] = {}
    if mode == UPSERT:
        for f in key_schema:
            fields[f.name] = StructField(f.name, f.dataType, False, f.metadata)
    for f in value_schema:
        if f.name.startswith("_"):
            raise LayoutError(f"{f.name}: a leading underscore is for system columns")
        known = fields.get(f.name)
        if known is None:
            fields[f.name] = StructField(f.name, f.dataType, True, f.metadata)
        elif known.dataType != f.dataType:
            raise LayoutError(f"{f.name} is {known.dataType.simpleString()} in the key, {f.dataType.simpleString()} in the value")
    system = list(RECORD_POSITION) if mode == APPEND else []
    system.append(StructField("_timestamp", timestamp, False))
    keys = tuple(f.name for f in key_schema) if mode == UPSERT else ()
    return Layout(keys, StructType([*fields.values(), *system]))


def merge_layout(old: Layout, new: Layout) -> Layout:
    """New columns are appended as nullable, missing ones stay; a changed key or type is an error."""
    if not old.schema.fields:
        return new
    if old.keys != new.keys:
        raise LayoutError(f"the key {list(old.keys)} cannot become {list(new.keys)}")
    merged = {f.name: f for f in old.schema}
    for f in new.schema:
        known = merged.get(f.name)
        if known is None:
            merged[f.name] = StructField(f.name, f.dataType, True, f.metadata)
        elif known.dataType != f.dataType:
            raise LayoutError(f"the type of {f.name} cannot change: "
                              f"{known.dataType.simpleString()} to {f.dataType.simpleString()}")
    return Layout(old.keys, StructType(list(merged.values())))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a layout, in its order; a column the data lacks is null."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{f.name}`") if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema])
