"""Topics as tables: where they are read from and which columns they get."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegralType, StringType, StructType

from livetables.operators.layout import APPEND, UPSERT, LayoutError

RETRACT = "retract"
EVENT_TIME_DELAY = "180 milliseconds"  # fixed value: bounded disorder every table declares
ENVELOPE = ("before", "after", "op")
INTERNAL_PREFIXES = ("_", "connect-")  # fixed values: topics that are not tables


@dataclass(frozen=True)
class TopicSpec:
    """Physical columns are the key columns, then the value columns."""
    keys: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    mode: str = APPEND
    key_prefix: str = ""
    not_null: tuple[str, ...] = field(default=())


def topic_name(source: str, schema: str, table: str) -> str:
    return f"{source}.{schema}.{table}"


def read_log(spark: SparkSession, path: str, spec: TopicSpec, streaming: bool = False, schema: StructType | None = None,
             fmt: str = "parquet", **options: str) -> DataFrame:
    """A topic from its first record: key columns, value columns, record position and time.

    ``fmt`` may be any source of the session, ``kafka`` included where its jar is present.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**options)
    if fmt == "kafka":
        raw = reader.option("startingOffsets", "earliest").option("subscribe", path).load()
        return raw.select("key", "value", F.col("partition").alias("_partition"), F.col("offset").alias("_offset"),
                          F.col("timestamp").alias("_timestamp"))
    if schema is not None:
        reader = reader.schema(schema)
    return log_columns(reader.load(path), spec)


def log_columns(df: DataFrame, spec: TopicSpec) -> DataFrame:
    system = [c for c in ("_partition", "_offset", "_timestamp", "_deleted") if c in df.columns]
    values = spec.values or tuple(c for c in df.columns if c not in spec.keys and c not in system)
    return df.select(*spec.keys, *[c for c in values if c not in spec.keys], *system)


def infer_spec(schema: StructType, compacted: bool) -> TopicSpec:
    """Table spec of a raw (key, value) topic.

    A change envelope keeps the columns of its after image and retracts. A record key gives
    not-null key columns, all prefixed ``key_`` if any name is also a value column; another key
    is one ``key`` column, not null in a compacted topic.
    """
    value = schema["value"].dataType
    if not isinstance(value, StructType):
        raise LayoutError(f"value must be a record, got {value.simpleString()}")
    if set(ENVELOPE) <= set(value.names) and isinstance(value["after"].dataType, StructType):
        return TopicSpec((), tuple(value["after"].dataType.names), RETRACT)
    key = schema["key"].dataType if "key" in schema.names else None
    record_key = isinstance(key, StructType)
    names = tuple(key.names) if record_key else (("key",) if key is not None else ())
    prefix = "key_" if set(names) & set(value.names) else ""
    keys = tuple(prefix + n for n in names)
    mode = UPSERT if compacted and keys else APPEND
    return TopicSpec(keys, tuple(value.names), mode, prefix, keys if record_key or compacted else ())


def key_bytes(key: Column, kind: DataType) -> Column:
    """A key that is neither a record nor text, as bytes: big-endian for whole numbers, else the UTF-8 bytes of its text."""
    if isinstance(kind, BinaryType):
        return key
    if isinstance(kind, IntegralType):
        digits = 2 * {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.simpleString()]
        return F.unhex(F.right(F.lpad(F.hex(key.cast("long")), 16, "0"), F.lit(digits)))
    return F.encode(key.cast("string"), "UTF-8")


def project_topic(df: DataFrame, compacted: bool, deletes: bool = False) -> DataFrame:
    """Key and value columns of a raw (key, value) topic, named by ``infer_spec``.

    A key that is neither a record nor text stays bytes. With ``deletes`` a compacted topic also has ``_deleted``: its null values are tombstones.
    """
    spec = infer_spec(df.schema, compacted)
    system = [c for c in df.columns if c.startswith("_")]
    if spec.mode == RETRACT:
        return df.select("value.before", "value.after", "value.op", *system)
    key = df.schema["key"].dataType if "key" in df.columns else None
    if isinstance(key, StructType):
        keys = [F.col(f"key.{n}").alias(spec.key_prefix + n) for n in key.names]
    elif key is not None:
        keys = [(F.col("key") if isinstance(key, StringType) else key_bytes(F.col("key"), key)).alias(spec.keys[0])]
    else:
        keys = []
    gone = [F.col("value").isNull().alias("_deleted")] if deletes and spec.mode == UPSERT else []
    return df.select(*keys, "value.*", *system, *gone)


def list_tables(topics: DataFrame, subjects: DataFrame) -> DataFrame:
    """Topics that are tables: they have a value schema and are not internal."""
    internal = [F.col("topic").startswith(p) for p in INTERNAL_PREFIXES]
    described = subjects.filter(F.col("subject").endswith("-value")).select(
        F.regexp_replace("subject", "-value$", "").alias("topic"))
    visible = topics.select("topic").distinct()
    for condition in internal:
        visible = visible.filter(~condition)
    return visible.join(described, "topic", "left_semi").orderBy("topic")


def with_event_time(df: DataFrame, column: str = "_timestamp") -> DataFrame:
    """The event-time column every table declares. Watermarks need an instant, not a local timestamp."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, EVENT_TIME_DELAY)


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def register_topics(tables: dict[str, DataFrame]) -> Sequence[str]:
    """One temporary view per topic, dots replaced by underscores."""
    names = []
    for topic, df in tables.items():
        name = topic.replace(".", "_")
        df.createOrReplaceTempView(name)
        names.append(name)
    return names


def jdbc_snapshot(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Initial rows of a source table, read in ranges of its numeric key."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
                                              upperBound=str(upper), numPartitions=str(partitions), **options).load())
