"""Raw records of a topic as keyed changes.

A record is a key and a value, both bytes, with its position (``_partition``, ``_offset``, ``_timestamp``). ``keyed_changes`` decodes both by
the schema ids in their headers, in one pass: each row takes the branch of its (key id, value id) pair. What each pair gives is one layout, and all layouts
must agree on the key columns and on the types of the value columns; that is checked when the plan is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from livetables.operators.layout import APPEND, UPSERT, Layout, layout_of, merge_layout
from livetables.sources.wire import WireFormatError, body_types, parsed_bodies, split_frame

KEY = "key"                                        # fixed value: the column of a key that is no record
PLAIN = {"text": StringType(), "bytes": BinaryType()}
POSITION = ("_partition", "_offset", "_timestamp")


@dataclass(frozen=True)
class RecordLayout:
    """What the records of a topic become: its layout, and the key schema ids (None: a key without a header) and value schema ids that lead there."""
    mode: str
    layout: Layout
    key_ids: tuple[int | None, ...]
    value_ids: tuple[int, ...]


def key_fields(kind: DataType) -> StructType:
    """A record key gives its fields; another key one column."""
    return kind if isinstance(kind, StructType) else StructType([StructField(KEY, kind, False)])


def record_layout(values: dict[int, DataType], keys: dict[int, DataType] | None = None, plain_key: str | None = "text", compacted: bool = True) -> RecordLayout:
    """The one layout of all (key id, value id) pairs; LayoutError where two of them do not go together.

    ``plain_key`` says what a key without a header is: ``text``, ``bytes``, or None where such keys must not occur.
    """
    if not compacted:
        layout = Layout()
        for value in values.values():
            layout = merge_layout(layout, layout_of(APPEND, StructType(), value))
        return RecordLayout(APPEND, layout, (), tuple(values))
    kinds: dict[int | None, StructType] = {i: key_fields(t) for i, t in (keys or {}).items()}
    if plain_key is not None and (not kinds or all(s == key_fields(PLAIN[plain_key]) for s in kinds.values())):
        kinds[None] = key_fields(PLAIN[plain_key])
    if not kinds:
        raise WireFormatError("no key schema")
    layout = Layout()
    for key in kinds.values():
        for value in values.values():
            layout = merge_layout(layout, layout_of(UPSERT, key, value))
    return RecordLayout(UPSERT, layout, tuple(kinds), tuple(values))


def _fail(message: Column, kind: DataType) -> Column:
    return F.raise_error(message).cast(kind)


def _position() -> Column:
    return F.concat(F.col("_partition").cast("string"), F.lit("/"), F.col("_offset").cast("string"))


def keyed_changes(records: DataFrame, values: dict[int, DataType | str], keys: dict[int, DataType | str] | None = None, plain_key: str | None = "text",
                  compacted: bool = True, fmt: str = "json") -> DataFrame:
    """Key columns, value columns, positions and ``_deleted``: what a ``KeyedTable`` merges. For a topic that is not compacted, value columns and positions.

    ``values`` and ``keys`` map schema ids to types (JSON bodies) or to Avro schema texts (``fmt="avro"``).

    - A null value deletes its key: ``_deleted`` is true and the value columns are null. In a topic that is not compacted there is nothing to delete and the record goes.
    - A key that is a record gives its fields, another key the column ``key``. A key without a header is text, or bytes.
    - A value without a header, an unknown schema id, a key of another layout and a value without a key fail the query; the message names the record.
    - A value field with the name of a key column takes the key's value; versions may add fields, and one that a version lacks is null.
    """
    value_types = body_types(records, values, fmt)
    key_types = body_types(records, keys or {}, fmt)
    want = record_layout(value_types, key_types, plain_key, compacted)
    framed = split_frame(records, "value").withColumnsRenamed({"_schema_id": "_value_id", "_body": "_value_body"}).drop("_framed", "value")
    if not compacted:
        framed = framed.filter("_value_id IS NOT NULL")
    else:
        framed = split_frame(framed, KEY, is_key=True).withColumnsRenamed({"_schema_id": "_key_id", "_body": "_key_body"}).drop("_framed", KEY)
        framed = parsed_bodies(framed, "_key", key_types, keys or {}, fmt)
    framed = parsed_bodies(framed, "_value", value_types, values, fmt)
    value_id, columns, key_columns = F.col("_value_id"), [], list(want.layout.keys)
    if compacted:
        key_id, body = F.col("_key_id"), F.col("_key_body")
        missing = body.isNull() & value_id.isNotNull()
        for field in want.layout.schema.fields[:len(key_columns)]:
            plain = body if isinstance(field.dataType, BinaryType) else F.decode(body, "UTF-8").cast(field.dataType) if None in want.key_ids else F.lit(None).cast(field.dataType)
            strange = key_id.isNotNull() | (body.isNotNull() if None not in want.key_ids else F.lit(False))
            pick = F.when(missing, _fail(F.concat(F.lit("a value without a key at "), _position()), field.dataType))
            for i, t in key_types.items():
                pick = pick.when(key_id == i, F.col(f"_key_{i}")[field.name] if isinstance(t, StructType) else F.col(f"_key_{i}"))
            pick = pick.when(strange, _fail(F.concat(F.lit("a key of another layout at "), _position()), field.dataType))
            columns.append(pick.otherwise(plain).alias(field.name))
    for field in want.layout.schema.fields[len(key_columns):]:
        if field.name.startswith("_"):
            continue
        pick = None
        for i, t in value_types.items():
            if field.name in t.names:
                value = F.col(f"_value_{i}")[field.name]
                pick = F.when(value_id == i, value) if pick is None else pick.when(value_id == i, value)
        columns.append(pick.alias(field.name))
    positions = [c for c in POSITION if c in records.columns]
    known = F.when(value_id.isNull() | value_id.isin(*values), value_id.isNull()) \
        .otherwise(_fail(F.concat(F.lit("unknown schema id "), value_id.cast("string"), F.lit(" at "), _position()), StringType()).cast("boolean"))
    if compacted:
        return framed.select(*columns, *positions, known.alias("_deleted"))
    return framed.filter(~known).select(*columns, *positions)
