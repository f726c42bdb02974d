"""Framed payloads: a zero byte, a four-byte schema id, the body."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

HEADER_BYTES = 5  # fixed value: magic byte 0x00 and a big-endian int


class WireFormatError(ValueError):
    """A value without a header, or with a schema id nobody registered."""


def split_frame(df: DataFrame, column: str, is_key: bool = False) -> DataFrame:
    """Add ``_schema_id``, ``_body`` and ``_framed``.

    A value that is too short or starts with another byte fails the query; such a key is plain
    text and stays whole in ``_body``. A null payload (tombstone) has neither.
    """
    payload = F.col(column)
    framed = (F.length(payload) >= HEADER_BYTES) & (F.hex(F.substring(payload, 1, 1)) == "00")
    schema_id = F.conv(F.hex(F.substring(payload, 2, 4)), 16, 10).cast("int")
    body = F.expr(f"substring(`{column}`, {HEADER_BYTES + 1})")
    if is_key:
        body = F.when(framed, body).otherwise(payload)
        ident = F.when(framed, schema_id)
    else:
        bad = F.raise_error(F.lit(f"{column}: not a framed payload"))
        ident = F.when(payload.isNull(), F.lit(None).cast("int")).when(framed, schema_id).otherwise(bad.cast("int"))
    return df.withColumns({"_schema_id": ident, "_body": body, "_framed": framed})


def body_types(df: DataFrame, schemas: dict[int, DataType | str], fmt: str = "json") -> dict[int, DataType]:
    """The type that each schema's bodies have in Spark."""
    if fmt == "avro":
        from pyspark.sql.avro.functions import from_avro
        empty = F.lit(None).cast("binary")
        return {i: df.select(from_avro(empty, s).alias("v")).schema["v"].dataType for i, s in schemas.items()}
    return {i: s if isinstance(s, DataType) else DataType.fromDDL(s) for i, s in schemas.items()}


def parsed_bodies(df: DataFrame, name: str, types: dict[int, DataType], schemas: dict[int, DataType | str], fmt: str = "json") -> DataFrame:
    """Add ``<name>_<id>`` per schema: the body ``<name>_body`` of the rows whose ``<name>_id`` it is, null elsewhere."""
    body, ident = F.col(f"{name}_body"), F.col(f"{name}_id")

    def parse(i: int):
        if fmt == "avro":
            from pyspark.sql.avro.functions import from_avro
            return from_avro(body, schemas[i])
        text = F.decode(body, "UTF-8")
        if isinstance(types[i], StructType):
            return F.from_json(text, types[i])
        # a JSON reader wants a record: a body of another type becomes the field of one
        return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), StructType([StructField("v", types[i])]))["v"]
    return df.withColumns({f"{name}_{i}": F.when(ident == i, parse(i)) for i in types})


def decode_topic(df: DataFrame, schemas: dict[int, StructType | str], fmt: str = "json") -> DataFrame:
    """Decode ``_body`` by ``_schema_id``; columns a version lacks are null.

    ``schemas`` maps each id to a StructType (JSON bodies) or to an Avro schema text
    (``fmt="avro"``, where the Avro jar is present). All ids are decoded in one pass over the
    data: each row takes the branch of its id, and an unknown id fails the query.
    """
    ident = F.col("_schema_id")
    types = body_types(df, schemas, fmt)
    fields: dict[str, object] = {}
    for t in types.values():
        for f in t.fields:
            if fields.setdefault(f.name, f.dataType) != f.dataType:
                raise WireFormatError(f"field {f.name} has several types")
    decoded = parsed_bodies(df.withColumns({"_value_id": ident, "_value_body": F.col("_body")}), "_value", types, schemas, fmt)
    unknown = F.when(ident.isNotNull() & ~ident.isin(*schemas), F.raise_error(F.concat(F.lit("unknown schema id "), ident.cast("string"))).cast("int"))
    decoded = decoded.withColumn("_schema_id", F.coalesce(unknown, ident))

    def pick(name):
        sources = [F.col(f"_value_{i}.{name}") for i, t in types.items() if name in t.names]
        return reduce(lambda a, b: F.coalesce(a, b), sources).alias(name)

    keep = [c for c in df.columns if c not in ("_body", "_framed") and c not in fields]
    return decoded.select(*[c for c in keep], *[pick(n) for n in fields])
