"""Wire values to column types, and nested values to JSON at the serving edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType


def _unscaled(value: Column, precision: int, scale: int) -> Column:
    """Big-endian two's complement bytes as decimal(p, s): hex digits in base-2^32 groups, highest first."""
    digits = F.hex(value)
    negative = (F.length(value) > 0) & (F.conv(F.substring(digits, 1, 1), 16, 10).cast("int") >= 8)
    # 16 bytes hold every decimal; a longer value may only repeat the sign before them
    tail = F.right(digits, F.lit(32))
    head = F.left(digits, F.greatest(F.length(digits) - 32, F.lit(0)))
    signs_only = F.when(negative, head.rlike("^F*$") & tail.rlike("^[89A-F]")).otherwise(head.rlike("^0*$") & tail.rlike("^[0-7]"))
    overlong = (F.length(digits) > 32) & ~signs_only
    padded = F.when(negative, F.lpad(tail, 32, "F")).otherwise(F.lpad(tail, 32, "0"))
    group = lambda i: F.conv(F.substring(padded, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    # the complement of each group keeps every step within 127 bits
    part = lambda i: F.when(negative, F.lit(2**32 - 1).cast("decimal(38,0)") - group(i)).otherwise(group(i))
    magnitude = F.lit(0).cast("decimal(38,0)")
    for i in range(4):
        magnitude = (magnitude * F.lit(2**32).cast("decimal(10,0)") + part(i)).cast("decimal(38,0)")
    magnitude = F.when(negative, magnitude + 1).otherwise(magnitude)
    # the point is set in the text: a division would round
    text = F.lpad(magnitude.cast("string"), 39, "0")
    text = F.concat(F.when(negative, "-").otherwise(""), F.left(text, F.lit(39 - scale)), F.lit("."), F.right(text, F.lit(scale)))
    text = F.when(overlong, F.raise_error(F.concat(F.lit("decimal of more than 16 bytes: "), digits)).cast("string")).otherwise(text)
    return text.cast(f"decimal({precision},{scale})")


def _decimal(value: Column, precision: int, scale: int) -> Column:
    return F.when(value.isNotNull(), _unscaled(value, precision, scale))


def logical_cast(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Cast columns by logical type; see ``cast_expr`` for the names."""
    return df.withColumns({name: cast_expr(F.col(name), kind) for name, kind in mapping.items()})


def cast_expr(c: Column, kind: str) -> Column:
    base, _, args = kind.partition("(")
    if base == "decimal":
        precision, scale = (int(a) for a in args.rstrip(")").split(","))
        return _decimal(c, precision, scale)
    micros_of_nanos = F.floor(c / F.lit(1000).cast("decimal(4,0)")).cast("long")
    casts = {
        "boolean": lambda: c.cast("boolean"), "int": lambda: c.cast("int"), "long": lambda: c.cast("long"),
        "float": lambda: c.cast("float"), "double": lambda: c.cast("double"),
        "string": lambda: c.cast("string"), "enum": lambda: c.cast("string"), "null": lambda: c.cast("string"),
        "bytes": lambda: c.cast("binary"), "fixed": lambda: c.cast("binary"),
        "date": lambda: F.date_from_unix_date(c),
        # micros of the day: the TIME type is off by default
        "time-millis": lambda: c.cast("long") * 1000,
        "time-micros": lambda: c.cast("long"),
        "timestamp-millis": lambda: F.timestamp_millis(c),
        "timestamp-micros": lambda: F.timestamp_micros(c),
        "timestamp-nanos": lambda: F.timestamp_micros(micros_of_nanos),
        "local-timestamp-millis": lambda: F.timestamp_millis(c).cast("timestamp_ntz"),
        "local-timestamp-micros": lambda: F.timestamp_micros(c).cast("timestamp_ntz"),
        "local-timestamp-nanos": lambda: F.timestamp_micros(micros_of_nanos).cast("timestamp_ntz"),
        "zoned-timestamp": lambda: F.to_timestamp(c),
        "record": lambda: F.to_json(c), "array": lambda: F.to_json(c), "map": lambda: F.to_json(c),
    }
    if base not in casts:
        raise ValueError(f"unknown logical type {kind}")
    return casts[base]()


def is_nested(data_type) -> bool:
    return isinstance(data_type, (StructType, ArrayType, MapType, VariantType))


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if is_nested(f.dataType) else F.col(f"`{f.name}`")
                       for f in df.schema])
