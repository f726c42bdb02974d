"""Sources and change-log reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from livetables import fixtures as fx
from livetables.functions.casts import flatten_nested, logical_cast
from livetables.operators import changelog as cl
from livetables.operators.store import TableStore
from livetables.operators.tables import KeyedTable
from livetables.plans.catalog import create_view
from livetables.plans.views import customer_360
from livetables.registry.core import oracle, query
from livetables.registry.writes import by_time
from livetables.session import workdir
from livetables.sources import topics
from livetables.sources.records import keyed_changes
from livetables.sources.wire import decode_topic, split_frame

ORDER_COLUMNS = "order_id, customer_id, status, CAST(total AS DOUBLE) AS total, created_at"


def money(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("scan_append", oracle("clicks", body="SELECT * FROM clicks"))
def scan_append(spark, d):
    return topics.log_columns(fx.clicks(spark, d), topics.TopicSpec(keys=("user_id",)))


@query("scan_upsert_latest", oracle("orders_cdc", body=f"""
    SELECT {ORDER_COLUMNS}, _offset FROM (
        SELECT * FROM orders_cdc QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _offset DESC) = 1)
    WHERE NOT _deleted"""))
def scan_upsert_latest(spark, d):
    now = cl.latest_by_key(fx.orders_cdc(spark, d), ["order_id"])
    return money(now.select("order_id", "customer_id", "status", "total", "created_at", "_offset"), "total")


@query("scan_retract", oracle("orders_envelope", body="""
    SELECT order_id, s.img.customer_id AS customer_id, s.img.status AS status, CAST(s.img.total AS DOUBLE) AS total,
           s.img.created_at AS created_at, _partition, _offset, _timestamp, CAST(s.w AS BIGINT) AS _w
    FROM (SELECT order_id, _partition, _offset, _timestamp, struct_pack(img := before, w := -1) AS s FROM orders_envelope WHERE op IN ('u', 'd')
          UNION ALL
          SELECT order_id, _partition, _offset, _timestamp, struct_pack(img := after, w := 1) AS s FROM orders_envelope WHERE op IN ('c', 'r', 'u'))"""))
def scan_retract(spark, d):
    return money(cl.expand_envelope(fx.orders_envelope(spark, d)), "total")


@query("unwrap_envelope", oracle("orders_cdc", body=f"""
    SELECT {ORDER_COLUMNS}, _partition, _offset, _timestamp, _deleted FROM orders_cdc"""))
def unwrap_envelope(spark, d):
    return money(cl.unwrap(fx.orders_envelope(spark, d), ["order_id"]), "total")


@query("initial_snapshot_then_changes", oracle("orders_t", "orders_cdc", body=f"""
    SELECT {ORDER_COLUMNS}, _offset, op FROM (
        SELECT * FROM (
            SELECT order_id, customer_id, 'open' AS status, total, created_at, 'r' AS op, -1 AS _offset, FALSE AS _deleted FROM orders_t
            UNION ALL
            SELECT order_id, customer_id, status, total, created_at, op, _offset, _deleted FROM orders_cdc WHERE op = 'd' OR order_id % 3 = 0)
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _offset DESC) = 1)
    WHERE NOT _deleted"""))
def initial_snapshot_then_changes(spark, d):
    snapshot = fx.orders(spark, d).withColumn("status", F.lit("open"))
    # some keys change after the snapshot, the others keep their snapshot row
    changes = fx.orders_cdc(spark, d).filter("op = 'd' OR order_id % 3 = 0")
    now = cl.latest_by_key(cl.with_snapshot(snapshot, changes), ["order_id"])
    return money(now.select("order_id", "customer_id", "status", "total", "created_at", "_offset", "op"), "total")


@query("topic_projection", oracle("orders_t", body="""
    SELECT 'record' AS topic, 'key_order_id,key_customer_id' AS not_null, order_id AS key_order_id, customer_id AS key_customer_id, NULL AS raw_key,
           CASE WHEN order_id % 10 > 0 THEN customer_id END AS customer_id, CASE WHEN order_id % 10 > 0 THEN status END AS status,
           CASE WHEN order_id % 10 > 0 THEN CAST(total AS DOUBLE) END AS total, order_id % 10 = 0 AS _deleted FROM orders_t
    UNION ALL SELECT 'raw', 'key', NULL, NULL, lpad(hex(order_id), 16, '0'), CASE WHEN order_id % 10 > 0 THEN customer_id END,
           CASE WHEN order_id % 10 > 0 THEN status END, CASE WHEN order_id % 10 > 0 THEN CAST(total AS DOUBLE) END, order_id % 10 = 0 FROM orders_t"""))
def topic_projection(spark, d):
    """Two compacted topics: with a record key whose names clash with the value's, and with a number as key, which stays bytes. Every tenth record is a tombstone."""
    value = F.struct("customer_id", "status", F.col("total").cast("double").alias("total"))
    live = F.when(F.col("order_id") % 10 > 0, value).alias("value")
    orders = fx.orders(spark, d)
    record = orders.select(F.struct("order_id", "customer_id").alias("key"), live)
    raw = orders.select(F.col("order_id").alias("key"), live)
    columns = lambda df, name: topics.project_topic(df, compacted=True, deletes=True).withColumns(
        {"topic": F.lit(name), "not_null": F.lit(",".join(topics.infer_spec(df.schema, compacted=True).not_null))})
    return columns(record, "record").unionByName(columns(raw, "raw").withColumn("raw_key", F.hex("key")).drop("key"), allowMissingColumns=True)


@query("wire_header", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 + 1 AS INTEGER) END AS key_schema_id,
           CASE WHEN event_id % 2 = 0 THEN '' ELSE 'u' END || user_id AS key_text, event_id % 2 = 0 AS key_framed,
           CAST(event_id % 3 + 1 AS INTEGER) AS value_schema_id,
           '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value_text
    FROM events""")
def wire_header(spark, d):
    keys = split_frame(fx.framed(spark, d), "key", is_key=True).select(
        "event_id", "value", F.col("_schema_id").alias("key_schema_id"), F.decode("_body", "UTF-8").alias("key_text"),
        F.col("_framed").alias("key_framed"))
    return split_frame(keys, "value").select(
        "event_id", "key_schema_id", "key_text", "key_framed", F.col("_schema_id").alias("value_schema_id"),
        F.decode("_body", "UTF-8").alias("value_text"))


KEY_SCHEMAS = {11: "user_id long", 12: "user_id long"}
VALUE_SCHEMAS = {1: "event_id long, user_id long", 2: "event_id long, user_id long, event_type string", 3: "event_id long, user_id long, event_type string"}


@query("decode_by_schema_id", oracle("clicks", body="""
    SELECT user_id, CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
           CASE WHEN event_type <> 'error' AND event_id % 3 > 0 THEN event_type END AS event_type, _partition, _offset, _timestamp, event_type = 'error' AS _deleted FROM clicks"""))
def decode_by_schema_id(spark, d):
    """Raw records as keyed changes: framed keys, three versions of the value, tombstones."""
    return keyed_changes(fx.framed_changes(spark, d), VALUE_SCHEMAS, KEY_SCHEMAS)


@query("records_to_table", oracle("user_state", body="""
    SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, _timestamp FROM user_state"""))
def records_to_table(spark, d):
    """The same records, merged into a table in three batches, the second one twice."""
    table = KeyedTable(TableStore(spark, workdir(spark, "records")), "users", ["user_id"])
    first, second, third = by_time(fx.framed_changes(spark, d))
    for batch in (first, second, second, third):
        table.merge(keyed_changes(batch, VALUE_SCHEMAS, KEY_SCHEMAS))
    return table.read()


@query("decode_versions", """
    SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS _schema_id, user_id,
           CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type FROM events""")
def decode_versions(spark, d):
    return decode_topic(split_frame(fx.framed(spark, d), "value").drop("key", "value"), VALUE_SCHEMAS)


@query("logical_type_cast", oracle("orders_t", body="""
    SELECT order_id, strftime(created_at, '%Y-%m-%d') AS as_date, created_at AS as_millis, created_at AS as_micros,
           created_at AS as_nanos, created_at - INTERVAL 2 HOURS AS as_zoned, CAST(total - 200000 AS DOUBLE) AS as_decimal,
           CAST(order_id % 86400 * 1000000 AS BIGINT) AS as_time, CAST(order_id AS VARCHAR) AS as_text,
           order_id % 2 = 0 AS as_bool FROM orders_t"""))
def logical_type_cast(spark, d):
    seconds = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    cents = ((F.col("total") - 200000) * 100).cast("long")
    wire = fx.orders(spark, d).select(
        "order_id",
        F.unix_date(F.col("created_at").cast("date")).alias("as_date"),
        (seconds * 1000).alias("as_millis"),
        (seconds * 1_000_000).alias("as_micros"),
        (seconds * 1_000_000_000 + 999).alias("as_nanos"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("as_zoned"),
        F.unhex(F.lpad(F.hex(cents), 16, "0")).alias("as_decimal"),
        (F.col("order_id") % 86400 * 1000).cast("int").alias("as_time"),
        F.col("order_id").alias("as_text"),
        (F.col("order_id") % 2 == 0).alias("as_bool"))
    typed = logical_cast(wire, {
        "as_date": "date", "as_millis": "timestamp-millis", "as_micros": "local-timestamp-micros",
        "as_nanos": "local-timestamp-nanos", "as_zoned": "zoned-timestamp", "as_decimal": "decimal(18,2)",
        "as_time": "time-millis", "as_text": "string", "as_bool": "boolean"})
    return typed.withColumns({
        "as_date": F.col("as_date").cast("string"), "as_decimal": F.col("as_decimal").cast("double"),
        "as_millis": F.col("as_millis").cast("timestamp_ntz"), "as_zoned": F.col("as_zoned").cast("timestamp_ntz")})


@query("nested_to_json", oracle("orders_t", body="""
    SELECT order_id, '{"status":"' || status || '","customer":' || customer_id || '}' AS detail,
           '["' || status || '","' || customer_id || '"]' AS tags, '{"' || status || '":' || customer_id || '}' AS props FROM orders_t"""))
def nested_to_json(spark, d):
    nested = fx.orders(spark, d).select(
        "order_id", F.struct("status", F.col("customer_id").alias("customer")).alias("detail"),
        F.array("status", F.col("customer_id").cast("string")).alias("tags"),
        F.create_map("status", "customer_id").alias("props"))
    return flatten_nested(nested)


@query("scan_lake", oracle("customer_360", body="SELECT * FROM customer_360"))
def scan_lake(spark, d):
    lake = TableStore(spark, workdir(spark, "lake"))
    view = customer_360(fx.customers(spark, d), fx.orders(spark, d))
    return create_view(lake, "customer_360", ["customer_id"], view, "customer_360").read()


@query("list_topics_as_tables", oracle(body="""
    SELECT DISTINCT 'shop.' || c_mktsegment || '.' || c_custkey AS topic FROM customer WHERE c_custkey % 3 <> 0"""))
def list_topics_as_tables(spark, d):
    customer = fx.load(spark, d, "customer")
    topic = F.concat_ws(".", F.lit("shop"), "c_mktsegment", F.col("c_custkey").cast("string"))
    key = F.col("c_custkey")
    names = [topic, F.concat(F.lit("_"), topic), F.concat(F.lit("connect-"), topic)]
    all_topics = customer.select(F.explode(F.array(*names)).alias("topic"))
    # every topic has a key schema, two thirds also a value schema
    subjects = customer.select(F.explode(F.array(
        F.concat(topic, F.lit("-key")),
        *[F.concat(n, F.when(key % 3 != 0, "-value").otherwise("-other")) for n in names])).alias("subject"))
    return topics.list_tables(all_topics, subjects)
