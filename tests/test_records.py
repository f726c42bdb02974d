"""Raw records as keyed changes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from livetables.operators.layout import LayoutError
from livetables.operators.tables import KeyedTable, LogTable
from livetables.sources.records import keyed_changes, record_layout
from livetables.sources.topics import infer_spec, project_topic
from livetables.sources.wire import WireFormatError
from tests.conftest import rows

RAW = "key binary, value binary, _partition int, _offset long, _timestamp timestamp_ntz"
VALUES = {1: "id int, name string", 2: "id int, name string, tier string"}
KEYS = {7: "id int", 8: "id int"}


def frame(schema_id, body):
    return bytearray(bytes([0]) + schema_id.to_bytes(4, "big") + body.encode())


def raw(spark, *pairs):
    return spark.createDataFrame([(k, v, 0, i, None) for i, (k, v) in enumerate(pairs)], RAW)


def test_updates_new_fields_and_tombstones_reach_a_table(spark, store):
    first = raw(spark, (frame(7, '{"id":1}'), frame(1, '{"id":1,"name":"a"}')), (frame(7, '{"id":2}'), frame(1, '{"id":2,"name":"b"}')), (frame(7, '{"id":3}'), frame(1, '{"id":3,"name":"c"}')))
    more = raw(spark, (None, None), (None, None), (None, None), (frame(8, '{"id":1}'), frame(2, '{"id":1,"name":"A","tier":"gold"}')), (frame(8, '{"id":2}'), None), (frame(7, '{"id":9}'), None))
    table = KeyedTable(store, "it.customers", ["id"])
    table.merge(keyed_changes(first, VALUES, KEYS))
    table.merge(keyed_changes(more, VALUES, KEYS))
    assert rows(table.read(), "id", "name", "tier") == [(1, "A", "gold"), (3, "c", None)]
    assert table.offsets() == {"0": 6}
    changes = keyed_changes(more, VALUES, KEYS)
    assert changes.columns == ["id", "name", "tier", "_partition", "_offset", "_timestamp", "_deleted"]
    assert rows(changes.filter("_offset >= 4"), "id", "name", "_deleted") == [(2, None, True), (9, None, True)]


def test_a_value_field_named_like_the_key_takes_the_keys_value(spark):
    got = keyed_changes(raw(spark, (frame(7, '{"id":5}'), frame(1, '{"id":6,"name":"x"}'))), VALUES, KEYS)
    assert rows(got, "id", "name") == [(5, "x")]


def test_keys_that_are_no_records(spark):
    values = {1: "name string"}
    one = frame(1, '{"name":"a"}')
    assert rows(keyed_changes(raw(spark, (bytearray("kéy".encode()), one), (bytearray(b""), one)), values), "key", "name") == [("", "a"), ("kéy", "a")]
    assert keyed_changes(raw(spark, (bytearray(b"\xff\x01"), one)), values, plain_key="bytes").first()["key"] == b"\xff\x01"
    # a framed text and a plain one are the same key column; a framed number is not
    mixed = keyed_changes(raw(spark, (frame(3, '"k"'), one), (bytearray(b"k"), None)), values, {3: "string"})
    assert rows(mixed, "key", "_deleted") == [("k", False), ("k", True)]
    assert rows(keyed_changes(raw(spark, (frame(3, "12"), one)), values, {3: "long"}), "key") == [(12,)]
    with pytest.raises(PySparkException, match="another layout at 0/0"):
        keyed_changes(raw(spark, (bytearray(b"k"), one)), values, {3: "long"}).collect()


@pytest.mark.parametrize("key, value, message", [
    (None, frame(1, '{"id":1}'), "without a key at 0/0"), (frame(7, '{"id":1}'), frame(5, "{}"), "unknown schema id 5 at 0/0"),
    (frame(9, '{"id":1}'), frame(1, '{"id":1}'), "another layout at 0/0"), (frame(7, '{"id":1}'), bytearray(b"{}"), "not a framed payload"), (bytearray(b"1"), None, "another layout")])
def test_bad_records_fail_the_query(spark, key, value, message):
    with pytest.raises(PySparkException, match=message):
        keyed_changes(raw(spark, (key, value)), VALUES, KEYS).collect()


def test_a_topic_that_is_not_compacted_has_no_keys_and_drops_null_values(spark, store):
    log = raw(spark, (None, frame(1, '{"id":1,"name":"a"}')), (bytearray(b"k"), None), (frame(9, "?"), frame(2, '{"id":2,"name":"b","tier":"t"}')))
    changes = keyed_changes(log, VALUES, compacted=False)
    assert changes.columns == ["id", "name", "tier", "_partition", "_offset", "_timestamp"]
    table = LogTable(store, "log")
    table.append(changes)
    assert rows(table.read(), "id", "tier", "_offset") == [(1, None, 0), (2, "t", 2)]


def test_layouts_that_do_not_go_together():
    ddl = StructType.fromDDL
    with pytest.raises(LayoutError):
        record_layout({1: ddl("a int")}, {1: ddl("id int"), 2: ddl("id int, b int")})
    with pytest.raises(LayoutError):
        record_layout({1: ddl("a int"), 2: ddl("a string")}, {1: ddl("id int")})
    with pytest.raises(LayoutError):
        record_layout({1: ddl("id string")}, {1: ddl("id int")})
    with pytest.raises(WireFormatError):
        record_layout({1: ddl("a int")}, {}, plain_key=None)
    assert record_layout({1: ddl("a int")}, {}).key_ids == (None,) and record_layout({1: ddl("a int")}, {4: ddl("id int")}).key_ids == (4,)


def test_raw_keys_of_a_topic(spark):
    df = spark.sql("SELECT -2L AS key, named_struct('x', 1) AS value UNION ALL SELECT 258L, NULL")
    assert infer_spec(df.schema, True).not_null == ("key",) and infer_spec(df.schema, False).not_null == ()
    got = {bytes(r["key"]): (r["x"], r["_deleted"]) for r in project_topic(df, True, deletes=True).collect()}
    assert got == {b"\xff" * 7 + b"\xfe": (1, False), b"\0" * 6 + b"\x01\x02": (None, True)}
    assert bytes(project_topic(df.selectExpr("CAST(key AS INT) AS key", "value"), True).filter("x = 1").first()["key"]) == b"\xff\xff\xff\xfe"
    assert bytes(project_topic(spark.sql("SELECT 1.5D AS key, named_struct('x', 1) AS value"), True).first()["key"]) == b"1.5"
