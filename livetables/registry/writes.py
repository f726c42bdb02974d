"""Keyed and append writes, lake tables, views as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables import fixtures as fx
from livetables.operators import changelog as cl
from livetables.operators.store import TableStore
from livetables.operators.tables import KeyedTable, LogTable, set_mode
from livetables.plans import catalog, views
from livetables.registry.core import oracle, query
from livetables.session import workdir

USER_STATE = "SELECT user_id, event_id, event_type, value, props FROM user_state"
USER_COLUMNS = ["user_id", "event_id", "event_type", "value", "props"]
ORDER_ROW = "order_id, customer_id, status, CAST(total AS DOUBLE) AS total, created_at"
ORDER_COLUMNS = ["order_id", "customer_id", "status", "total", "created_at"]
CUTS = ("2024-01-10", "2024-01-20")


def store(spark) -> TableStore:
    return TableStore(spark, workdir(spark, "tables"))


def by_time(log: DataFrame) -> list[DataFrame]:
    """A log whose offsets follow its time, as three consecutive batches."""
    t = F.col("_timestamp").cast("date")
    first, second = (F.lit(c).cast("date") for c in CUTS)
    return [log.filter(t < first), log.filter((t >= first) & (t < second)), log.filter(t >= second)]


def by_step(log: DataFrame, n: int = 3) -> list[DataFrame]:
    """Order, customer and product logs: one batch per round of changes."""
    step = F.floor(F.col("_offset") / fx.OFFSET_STEP)
    return [log.filter(step == i) for i in range(n)]


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def merged_users(spark, d, log=None, name="users") -> KeyedTable:
    table = KeyedTable(store(spark), name, ["user_id"])
    for batch in by_time(fx.user_state_log(spark, d) if log is None else log):
        table.merge(batch)
    return table


@query("materialize_upsert", oracle("user_state", body=USER_STATE))
def materialize_upsert(spark, d):
    return merged_users(spark, d).read().select(USER_COLUMNS)


@query("materialize_append", oracle("clicks", body="SELECT * FROM clicks"))
def materialize_append(spark, d):
    table = LogTable(store(spark), "clicks")
    log = fx.clicks_replayed(spark, d)
    table.append(by_time(log)[0])
    table.append(log)  # the first records once more, with the rest
    return table.read()


@query("system_columns", oracle("clicks", body="""
    SELECT 'append' AS mode, NULL AS _key, event_id, event_type, _partition, _offset, _timestamp FROM clicks
    UNION ALL SELECT 'upsert', CAST(user_id AS VARCHAR), event_id, event_type, NULL, NULL, _timestamp FROM clicks"""))
def system_columns(spark, d):
    log = fx.clicks(spark, d).select("event_id", "event_type", "user_id", "_partition", "_offset", "_timestamp")
    key = F.col("user_id").cast("string")
    append = cl.add_system_columns(log, "append", key).withColumn("mode", F.lit("append"))
    upsert = cl.add_system_columns(log, "upsert", key).withColumn("mode", F.lit("upsert"))
    return append.unionByName(upsert, allowMissingColumns=True).drop("user_id")


@query("exactly_once_offsets", oracle("clicks", body="""
    SELECT _partition, max(_offset) + 1 AS next_offset, count(*) AS rows FROM clicks GROUP BY _partition"""))
def exactly_once_offsets(spark, d):
    table = LogTable(store(spark), "clicks")
    first, second, third = by_time(fx.clicks(spark, d))
    table.append(first)
    table.append(first.unionByName(second))
    table.append(first.unionByName(second).unionByName(third))
    table.append(second)
    counts = table.read().groupBy("_partition").agg(F.count(F.lit(1)).alias("rows"))
    return table.progress().select("_partition", "next_offset").join(counts, "_partition")


@query("progress", oracle("clicks", body="""
    SELECT 'users' AS topic, _partition, max(_offset) + 1 AS next_offset, (SELECT max(_timestamp) FROM clicks) AS last_record_ts,
           TRUE AS ingested FROM clicks GROUP BY _partition"""))
def progress(spark, d):
    rows = merged_users(spark, d).progress()
    return rows.select("topic", "_partition", "next_offset", "last_record_ts", F.col("last_ingested_at").isNotNull().alias("ingested"))


@query("schema_evolution", oracle("clicks", body=f"""
    SELECT event_id, user_id, event_type, value, CASE WHEN _timestamp < '{CUTS[0]}' THEN props END AS props,
           CASE WHEN _timestamp >= '{CUTS[0]}' THEN event_id % 3 END AS channel FROM clicks"""))
def schema_evolution(spark, d):
    """A column is added and another removed: old rows are null in the first, new rows in the second."""
    table = KeyedTable(store(spark), "clicks", ["event_id"])
    old, *rest = by_time(fx.clicks(spark, d))
    table.merge(old)
    for batch in rest:
        table.merge(batch.drop("props").withColumn("channel", F.col("event_id") % 3))
    return table.read().drop("_timestamp")


@query("lake_upsert", oracle("orders_now", body=f"SELECT {ORDER_ROW} FROM orders_now"))
def lake_upsert(spark, d):
    table = KeyedTable(store(spark), "shop.public.orders", ["order_id"])
    log = fx.orders_cdc(spark, d).drop("op").unionByName(fx.orders_move(spark, d).drop("op"))
    for batch in by_step(log, 4):
        table.merge(batch)
    return as_double(table.read().select(ORDER_COLUMNS), "total")


@query("lake_append_history", oracle("orders_cdc", body=f"""
    SELECT {ORDER_ROW}, _partition, _offset, _timestamp FROM orders_cdc WHERE NOT _deleted"""))
def lake_append_history(spark, d):
    table = LogTable(store(spark), "shop.public.orders")
    for batch in by_step(fx.orders_cdc(spark, d).drop("op")):
        table.append(batch)
    return as_double(table.read(), "total")


@query("not_null_drop", oracle("clicks", body="""
    SELECT user_id, event_id, event_type FROM clicks WHERE event_id % 3 <> 0
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _offset DESC) = 1"""))
def not_null_drop(spark, d):
    log = fx.clicks(spark, d).withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")))
    return merged_users(spark, d, log).read().select("user_id", "event_id", "event_type")


def view_table(spark, d, tables: TableStore) -> KeyedTable:
    return catalog.create_view(tables, "customer_360", ["customer_id"],
                               views.customer_360(fx.customers(spark, d), fx.orders(spark, d)), "customers LEFT JOIN orders")


@query("ctas_upsert", oracle("customer_360", body="SELECT * FROM customer_360"))
def ctas_upsert(spark, d):
    return view_table(spark, d, store(spark)).read()


@query("insert_into", oracle("customers", "orders_now", body="""
    SELECT c.customer_id, c.tier, COUNT(o.order_id) AS orders FROM customers c LEFT JOIN orders_now o USING (customer_id) GROUP BY ALL"""))
def insert_into(spark, d):
    """A stopped view resumes: its query runs again into the table it has."""
    tables = store(spark)
    table = view_table(spark, d, tables)
    now = cl.latest_by_key(fx.orders_cdc(spark, d).unionByName(fx.orders_move(spark, d)), ["order_id"])
    again = views.customer_360(fx.customers(spark, d), now)
    catalog.refresh_view(table, again)
    catalog.refresh_view(table, again)
    return table.read().select("customer_id", "tier", "orders")


@query("switch_mode_rebuild", oracle("orders_cdc", body="""
    SELECT 'append' AS mode, order_id, status FROM orders_cdc WHERE NOT _deleted
    UNION ALL SELECT 'upsert', order_id, status FROM (
        SELECT * FROM orders_cdc QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _offset DESC) = 1) WHERE NOT _deleted"""))
def switch_mode_rebuild(spark, d):
    tables, log = store(spark), fx.orders_cdc(spark, d).drop("op")
    KeyedTable(tables, "a", ["order_id"]).merge(log)
    LogTable(tables, "b").append(log)
    a = set_mode(tables, "a", "append", log)
    b = set_mode(tables, "b", "upsert", log, ["order_id"])
    b = set_mode(tables, "b", "upsert", log.limit(0), ["order_id"])  # same mode: the data stays
    pick = lambda t, m: t.read().select(F.lit(m).alias("mode"), "order_id", "status")
    return pick(a, "append").unionByName(pick(b, "upsert"))


@query("bucketed_write", oracle("orders_t", body="""
    SELECT order_id, customer_id, status, CAST(1 AS BIGINT) AS reads FROM orders_t"""))
def bucketed_write(spark, d):
    """Every row, and in how many of the sixteen buckets a read of that bucket alone returns it."""
    table = KeyedTable(store(spark), "orders", ["order_id"], buckets=16)
    table.merge(fx.orders(spark, d))
    parts = [table.read(buckets=[b]) for b in range(16)]
    return reduce(DataFrame.unionByName, parts).groupBy("order_id", "customer_id", "status").agg(F.count(F.lit(1)).alias("reads"))


@query("compaction_policy", oracle("orders_cdc", body="""
    SELECT 'delete' AS policy, order_id, _offset, _deleted FROM orders_cdc
    UNION ALL SELECT 'compact', order_id, _offset, _deleted FROM orders_cdc
    QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _offset DESC) = 1"""))
def compaction_policy(spark, d):
    log = fx.orders_cdc(spark, d)
    keep = lambda p: cl.compact_log(log, ["order_id"], p).select(F.lit(p).alias("policy"), "order_id", "_offset", "_deleted")
    return keep("delete").unionByName(keep("compact"))
