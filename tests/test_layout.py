import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from livetables.functions.casts import logical_cast
from livetables.functions.scalars import hash8, iso_time
from livetables.operators.layout import Layout, LayoutError, infer_mode, layout_of, merge_layout
from livetables.plans.catalog import definition_hash
from livetables.sources.topics import infer_spec, project_topic, register_topics, topic_name
from livetables.sources.wire import decode_topic, split_frame

ddl = StructType.fromDDL


def test_layout_order_and_system_columns():
    up = layout_of("upsert", ddl("id int"), ddl("name string, id int"))
    assert (up.keys, up.schema.names) == (("id",), ["id", "name", "_timestamp"])
    log = layout_of("append", ddl("id int"), ddl("name string"))
    assert (log.keys, log.schema.names) == ((), ["name", "_partition", "_offset", "_timestamp"])
    with pytest.raises(LayoutError):
        layout_of("append", ddl("id int"), ddl("_name string"))
    with pytest.raises(LayoutError):
        layout_of("upsert", ddl("id int"), ddl("id long"))


def test_merge_layout():
    a = layout_of("upsert", ddl("id int"), ddl("name string, email string"))
    b = layout_of("upsert", ddl("id int"), ddl("name string, tier string"))
    merged = merge_layout(a, b)
    assert merged.schema.names == ["id", "name", "email", "_timestamp", "tier"]
    assert merge_layout(Layout(), a) == a
    with pytest.raises(LayoutError):
        merge_layout(a, layout_of("upsert", ddl("key int"), ddl("name string")))
    with pytest.raises(LayoutError):
        merge_layout(a, layout_of("upsert", ddl("id int"), ddl("name int")))


def test_mode():
    assert infer_mode(["id"], True) == "upsert" and infer_mode(["id"], False) == "append"
    assert infer_mode(["id"], True, "append") == "append"
    with pytest.raises(LayoutError):
        infer_mode([], True)


def test_infer_spec():
    spec = lambda s, c=True: infer_spec(ddl(s), c)
    plain = spec("key struct<order_id:int>, value struct<status:string,total:double>")
    assert (plain.keys, plain.values, plain.mode, plain.key_prefix) == (("order_id",), ("status", "total"), "upsert", "")
    both = spec("key struct<a:int,b:int>, value struct<b:int,c:int>")
    assert (both.keys, both.key_prefix) == (("key_a", "key_b"), "key_")
    assert spec("key string, value struct<a:int>").keys == ("key",)
    assert spec("key string, value struct<a:int>", False).mode == "append"
    envelope = spec("key struct<id:int>, value struct<before:struct<id:int,name:string>,after:struct<id:int,name:string>,op:string>")
    assert (envelope.mode, envelope.values) == ("retract", ("id", "name"))
    with pytest.raises(LayoutError):
        spec("key string, value string")


def test_project_topic(spark):
    df = spark.sql("SELECT named_struct('id', 1) AS key, named_struct('id', 2, 'x', 'y') AS value, 5L AS _offset")
    assert project_topic(df, True).columns == ["key_id", "id", "x", "_offset"]


def test_register_topics(spark):
    name = topic_name("shop", "public", "orders")
    assert register_topics({name: spark.range(3)}) == ["shop_public_orders"]
    assert spark.sql("SELECT count(*) FROM shop_public_orders").first()[0] == 3


def frame(schema_id, body):
    return bytes([0]) + schema_id.to_bytes(4, "big") + body


def test_frames(spark):
    df = spark.createDataFrame([(frame(7, b'{"a":1}'), bytearray(b"plain")), (None, bytearray(frame(9, b"k")))], "value binary, key binary")
    got = split_frame(df, "value").select("_schema_id", F.decode("_body", "UTF-8"), "_framed").collect()
    assert [tuple(r) for r in got] == [(7, '{"a":1}', True), (None, None, None)]
    got = split_frame(df, "key", is_key=True).select("_schema_id", F.decode("_body", "UTF-8"), "_framed").collect()
    assert [tuple(r) for r in got] == [(None, "plain", False), (9, "k", True)]


@pytest.mark.parametrize("payload", [b"\x00\x00\x00", b"\x01\x00\x00\x00\x07{}"])
def test_bad_value_frame_fails(spark, payload):
    df = spark.createDataFrame([(bytearray(payload),)], "value binary")
    with pytest.raises(PySparkException):
        split_frame(df, "value").collect()


def test_decode_versions(spark):
    df = spark.createDataFrame([(bytearray(frame(1, b'{"a":1}')),), (bytearray(frame(2, b'{"a":2,"b":"x"}')),)], "value binary")
    got = decode_topic(split_frame(df, "value").drop("value"), {1: "a int", 2: "a int, b string"}).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, 1, None), (2, 2, "x")]
    with pytest.raises(PySparkException):
        decode_topic(split_frame(df, "value").drop("value"), {1: "a int"}).collect()


@pytest.mark.parametrize("value, precision, scale", [
    ("0.00", 10, 2), ("12.34", 10, 2), ("-12.34", 10, 2), ("-0.01", 10, 2), ("99999999.99", 10, 2), ("-1", 20, 0),
    ("123456789012345678901234567890.12345678", 38, 8), ("-99999999999999999999999999999999999999", 38, 0)])
def test_decimal_bytes(spark, value, precision, scale):
    unscaled = int(Decimal(value).scaleb(scale).to_integral_value()) if precision < 28 else int(value.replace(".", ""))
    raw = unscaled.to_bytes((unscaled.bit_length() + 8) // 8, "big", signed=True)
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "x binary")
    got = [r[0] for r in logical_cast(df, {"x": f"decimal({precision},{scale})"}).collect()]
    assert got == [Decimal(value), None]


def test_logical_casts(spark):
    df = spark.sql("SELECT 19000 AS d, 1500L AS ms, -1L AS us, 1999L AS ns, '2026-01-01T02:00:00+02:00' AS z, 1000 AS t")
    r = logical_cast(df, {"d": "date", "ms": "timestamp-millis", "us": "timestamp-micros", "ns": "local-timestamp-nanos",
                          "z": "zoned-timestamp", "t": "time-millis"}).select(
        "d", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("ms", "us", "ns", "z")], "t").first()
    epoch = dt.datetime(1970, 1, 1)
    assert r["d"] == dt.date(2022, 1, 8) and r["ms"] == epoch + dt.timedelta(milliseconds=1500)
    assert r["us"] == epoch - dt.timedelta(microseconds=1) and r["ns"] == epoch + dt.timedelta(microseconds=1)
    assert r["z"] == dt.datetime(2026, 1, 1) and r["t"] == 1_000_000


def test_hash_matches_its_driver_form(spark):
    got = spark.sql("SELECT 'a' AS x, 'b' AS y").select(hash8("x", "y")).first()[0]
    assert got == definition_hash("a", "b") != definition_hash("ab", "")


@pytest.mark.parametrize("ts, text", [
    ("2026-01-01 10:00:00", "2026-01-01T10:00Z"), ("2026-01-01 10:00:05", "2026-01-01T10:00:05Z"),
    ("2026-01-01 10:00:05.120", "2026-01-01T10:00:05.120Z"), ("2026-01-01 10:00:05.000123", "2026-01-01T10:00:05.000123Z")])
def test_iso_time(spark, ts, text):
    df = spark.createDataFrame([(ts,)], "x string").select(F.col("x").cast("timestamp").alias("x"))
    assert df.select(iso_time("x", "timestamp")).first()[0] == text
    assert df.select(iso_time(F.col("x").cast("timestamp_ntz"), "timestamp_ntz")).first()[0] == text[:-1]


def test_iso_time_query_matches_its_sql_on_whole_seconds(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.check import compare
    import duckdb
    times = ["2024-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:05", "2024-01-01 10:00:05.12", "2024-01-01 10:00:05.000123", "2024-01-01 10:00:05.100001", "1969-12-31 23:59:59", None]
    con = duckdb.connect()
    values = ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(times))
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, CAST(t AS TIMESTAMP) AS ts FROM (VALUES {values}) v(i, t)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert compare("fn_iso_time", entry.queries()["fn_iso_time"](spark, str(tmp_path)), con, entry.oracle_sql()["fn_iso_time"]) is None


def test_overlong_decimals_fail(spark):
    from livetables.functions.casts import cast_expr
    read = lambda b: spark.createDataFrame([(bytearray(b),)], "b binary").select(cast_expr(F.col("b"), "decimal(10,2)")).first()[0]
    assert str(read(b"\x00" * 20 + b"\x01\x00")) == "2.56" and str(read(b"\xff" * 20)) == "-0.01"
    with pytest.raises(Exception, match="more than 16 bytes"):
        read(b"\x01" + b"\x00" * 16)
