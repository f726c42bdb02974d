"""Streams over logs that arrive in steps, and views kept current by them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables import fixtures as fx
from livetables.operators import changelog as cl
from livetables.operators.tables import KeyedTable, LogTable
from livetables.plans import catalog
from livetables.registry.core import oracle, query
from livetables.registry.writes import ORDER_COLUMNS, ORDER_ROW, USER_COLUMNS, USER_STATE, as_double, by_step, by_time, store
from livetables.session import workdir
from livetables.sources.topics import TopicSpec, read_log, write_log
from livetables.streaming import streams
from livetables.streaming.incremental import CustomerView, GroupCount, InventoryView
from livetables.streaming.windows import ClosingWindows


def arrive(spark, batches: Iterable[DataFrame], run: Callable[[DataFrame, str], object], fresh_checkpoints: bool = False) -> None:
    """Write each batch to a log and run the stream on what has arrived; every run is a restart.

    With fresh checkpoints the stream also reads again all that it has read before.
    """
    root = workdir(spark, "stream")
    for i, batch in enumerate(batches):
        write_log(batch, f"{root}/log")
        log = read_log(spark, f"{root}/log", TopicSpec(), streaming=True, schema=batch.schema)
        query_or_none = run(log, f"{root}/checkpoint{i if fresh_checkpoints else ''}")
        if query_or_none is not None:
            query_or_none.awaitTermination()


@query("stream_upsert_table", oracle("user_state", body=USER_STATE))
def stream_upsert_table(spark, d):
    table = KeyedTable(store(spark), "users", ["user_id"])
    # each step is one file, and commits in pieces
    arrive(spark, by_time(fx.user_state_log(spark, d)), lambda log, cp: streams.stream_upsert(log, table, cp, every=None, most=streams.BATCH_RECORDS))
    return table.read().select(USER_COLUMNS)


@query("stream_append_table", oracle("clicks", body="SELECT * FROM clicks"))
def stream_append_table(spark, d):
    table = LogTable(store(spark), "clicks")
    arrive(spark, by_time(fx.clicks_replayed(spark, d)), lambda log, cp: streams.stream_append(log, table, cp, every=None))
    return table.read()


@query("stream_restart_exactly_once", oracle("clicks", body="SELECT * FROM clicks"))
def stream_restart_exactly_once(spark, d):
    """Every restart has lost its checkpoint and replays the log: stored offsets skip what is there."""
    table = LogTable(store(spark), "clicks")
    arrive(spark, by_time(fx.clicks(spark, d)), lambda log, cp: streams.stream_append(log, table, cp, every=None), fresh_checkpoints=True)
    return table.read()


@query("stream_lake", oracle("orders_cdc", body=f"""
    SELECT 'upsert' AS mode, {ORDER_ROW} FROM (SELECT * FROM orders_cdc QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY _offset DESC) = 1)
    WHERE NOT _deleted UNION ALL SELECT 'append', {ORDER_ROW} FROM orders_cdc"""))
def stream_lake(spark, d):
    """Both lake tables lose their checkpoint before every batch."""
    tables = store(spark)
    table, history = KeyedTable(tables, "shop.public.orders", ["order_id"]), LogTable(tables, "shop.public.orders.history", deletes=True)
    log = fx.orders_cdc(spark, d).drop("op")
    arrive(spark, by_step(log), lambda s, cp: streams.stream_lake_upsert(s, table, cp, every=None), fresh_checkpoints=True)
    arrive(spark, by_step(log), lambda s, cp: streams.stream_lake_append(s, history, cp, every=None), fresh_checkpoints=True)
    rows = lambda df, m: as_double(df.select(F.lit(m).alias("mode"), *ORDER_COLUMNS), "total")
    return rows(table.read(), "upsert").unionByName(rows(history.read(), "append"))


def customer_view(spark, d) -> CustomerView:
    """Customers and orders as one stream of two topics, in four steps."""
    view = CustomerView(store(spark))
    # each step makes its own round of the logs only
    logs = [(fx.customers_cdc(spark, d, [i]), fx.orders_cdc(spark, d, [i]).drop("op")) for i in range(3)]
    logs.append((fx.customers_cdc(spark, d, [2]).limit(0), fx.orders_move(spark, d).drop("op")))
    c, o = (log.columns for log in logs[0])
    both = [customers.withColumn("topic", F.lit("customers")).unionByName(orders.withColumn("topic", F.lit("orders")), allowMissingColumns=True)
            for customers, orders in logs]

    def apply(batch: DataFrame) -> None:
        view.refresh(batch.filter("topic = 'customers'").select(c), batch.filter("topic = 'orders'").select(o))

    arrive(spark, both, lambda log, cp: streams.start(log, apply, cp, every=None))
    return view


@query("incr_customer_360", oracle("customer_360_now", body="SELECT * FROM customer_360_now"))
def incr_customer_360(spark, d):
    return customer_view(spark, d).view.read()


@query("incr_inventory_live", oracle("inventory_live_now", body="SELECT * FROM inventory_live_now"))
def incr_inventory_live(spark, d):
    view = InventoryView(store(spark))
    products, inventory = fx.products_cdc(spark, d), fx.inventory_cdc(spark, d)
    p, i = products.columns, inventory.columns
    both = (products.withColumn("topic", F.lit("products"))
            .unionByName(inventory.withColumn("topic", F.lit("inventory")), allowMissingColumns=True))

    def apply(batch: DataFrame) -> None:
        view.refresh(batch.filter("topic = 'products'").select(p), batch.filter("topic = 'inventory'").select(i))

    arrive(spark, by_step(both), lambda log, cp: streams.start(log, apply, cp, every=None))
    return view.view.read()


@query("incr_group_count", oracle("orders_now", body="""
    SELECT customer_id, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total FROM orders_now GROUP BY customer_id"""))
def incr_group_count(spark, d):
    tables = store(spark)
    counts = GroupCount(tables, KeyedTable(tables, "orders", ["order_id"]), "orders_per_customer", ["customer_id"], {"total": F.col("total")})
    log = fx.orders_cdc(spark, d).drop("op").unionByName(fx.orders_move(spark, d).drop("op"))
    arrive(spark, by_step(log, 4), lambda s, cp: streams.start(s, counts.refresh, cp, every=None))
    return as_double(counts.read(), "total")


@query("watermark_180ms", oracle("clicks", body="""
    SELECT date_trunc('day', _timestamp) AS window_start, count(*) AS n,
           date_trunc('day', _timestamp) + INTERVAL 1 DAY <= (SELECT max(_timestamp) FROM clicks) - INTERVAL 180 MILLISECOND AS closed FROM clicks GROUP BY ALL"""))
def watermark_180ms(spark, d):
    """Windows of two topics, of which one never sends: it does not hold the windows of the other back."""
    windows = ClosingWindows(store(spark), "per_day", "1 day", ["clicks", "silent"], idle=0)
    log = fx.clicks(spark, d).withColumn("topic", F.lit("clicks"))
    split = lambda batch: windows.refresh({t: batch.filter(F.col("topic") == t) for t in ("clicks", "silent")})
    arrive(spark, by_time(log), lambda s, cp: streams.start(s, split, cp, every=None))
    return windows.read()


@query("windowed_counts", oracle("clicks", body="""
    SELECT date_trunc('day', _timestamp) AS window_start, count(*) AS n FROM clicks GROUP BY ALL"""))
def windowed_counts(spark, d):
    """The engine's own windows, in update mode."""
    table = KeyedTable(store(spark), "clicks_per_day", ["window_start"])
    arrive(spark, by_time(fx.clicks(spark, d)), lambda log, cp: streams.stream_windowed_counts(log, "1 day", table, cp, every=None))
    return table.read()


@query("stream_topics", oracle("clicks", "user_state", body="""
    SELECT 'clicks' AS topic, event_id, user_id, event_type FROM clicks UNION ALL SELECT 'users', event_id, user_id, event_type FROM user_state"""))
def stream_topics(spark, d):
    """One stream of two topics, each into its own table."""
    tables = store(spark)
    users, clicks = KeyedTable(tables, "users", ["user_id"]), LogTable(tables, "clicks")
    state, log = fx.user_state_log(spark, d).withColumn("topic", F.lit("users")), fx.clicks(spark, d).withColumn("topic", F.lit("clicks"))
    columns = {"users": fx.user_state_log(spark, d).columns, "clicks": fx.clicks(spark, d).columns}
    both = state.unionByName(log, allowMissingColumns=True)
    arrive(spark, by_time(both), lambda s, cp: streams.stream_tables(s, {"users": users, "clicks": clicks}, cp, columns=columns, every=None))
    pick = lambda t, name: t.read().select(F.lit(name).alias("topic"), "event_id", "user_id", "event_type")
    return pick(clicks, "clicks").unionByName(pick(users, "users"))


@query("late_rows", oracle("user_state", body=USER_STATE))
def late_rows(spark, d):
    """Record times run backwards: keyed state follows offsets, so no late record is lost."""
    table = KeyedTable(store(spark), "users", ["user_id"])
    backwards = F.timestamp_micros(F.lit(2_000_000_000_000_000) - F.col("_offset") * 1_000_000).cast("timestamp_ntz")
    batches = [b.withColumn("_timestamp", backwards) for b in by_time(fx.user_state_log(spark, d))]
    arrive(spark, batches, lambda log, cp: streams.stream_upsert(log, table, cp, every=None))
    return table.read().select(USER_COLUMNS)


@query("batch_dedup_in_flight", oracle("orders_now", body=f"SELECT {ORDER_ROW} FROM orders_now"))
def batch_dedup_in_flight(spark, d):
    """All changes of every key in one batch, deletes included."""
    table = KeyedTable(store(spark), "orders", ["order_id"])
    log = fx.orders_cdc(spark, d).drop("op").unionByName(fx.orders_move(spark, d).drop("op"))
    arrive(spark, [log], lambda s, cp: streams.stream_upsert(s, table, cp, every=None))
    return as_double(table.read().select(ORDER_COLUMNS), "total")


@query("lag", oracle("clicks", body="""
    SELECT 'clicks' AS topic, CAST(sum(greatest(e - c, 0)) AS BIGINT) AS lag FROM (
        SELECT _partition, max(_offset) + 1 AS e, max(CASE WHEN _timestamp < '2024-01-10' THEN _offset END) + 1 AS c FROM clicks GROUP BY _partition)
    UNION ALL SELECT 'unknown', NULL"""))
def lag(spark, d):
    table = LogTable(store(spark), "clicks")
    log = fx.clicks(spark, d)
    table.append(by_time(log)[0])
    ends = cl.next_offsets(log).select(F.lit("clicks").alias("topic"), "_partition", F.col("next_offset").alias("end_offset"))
    unknown = ends.select(F.lit("unknown").alias("topic"), "_partition", F.lit(None).cast("long").alias("end_offset"))
    return cl.lag(ends.unionByName(unknown), table.progress().select("topic", "_partition", "next_offset"))


@query("new_partitions", oracle("clicks", body="SELECT * FROM clicks"))
def new_partitions(spark, d):
    """Two partitions at first; those added later start at their beginning."""
    table = LogTable(store(spark), "clicks")
    log = fx.clicks(spark, d)
    arrive(spark, [log.filter("_partition < 2"), log.filter("_partition >= 2")],
           lambda s, cp: streams.stream_append(s, table, cp, every=None))
    return table.read()


@query("view_change_rebuild", oracle("orders_t", body="""
    SELECT customer_id, count(*) AS n, max(created_at) AS last_order_at FROM orders_t GROUP BY customer_id"""))
def view_change_rebuild(spark, d):
    tables, orders = store(spark), fx.orders(spark, d)
    count = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    more = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_order_at"))
    catalog.create_view(tables, "orders_of", ["customer_id"], count, "count")
    before = tables.snapshot()["commit"]
    catalog.create_view(tables, "orders_of", ["customer_id"], count, "count")
    if tables.snapshot()["commit"] != before:
        raise AssertionError("an unchanged definition was rebuilt")
    return catalog.create_view(tables, "orders_of", ["customer_id"], more, "count, max").read()


@query("view_chain", oracle("customer_360_now", body="""
    SELECT tier, count(*) AS n, CAST(sum(orders) AS DOUBLE) AS orders, CAST(sum(CAST(lifetime_value AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM customer_360_now GROUP BY tier"""))
def view_chain(spark, d):
    """Tier totals read the customer view, which reads customers and orders; all move in one commit."""
    return as_double(customer_view(spark, d).tiers.read().select("tier", "n", "orders", "revenue"), "orders", "revenue")
