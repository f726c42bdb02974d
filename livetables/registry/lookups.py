"""Projections, predicates, order, limits and aggregates of bounded lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from livetables import fixtures as fx
from livetables.operators.lookup import Agg, Col, Lit, keyed_membership, lookup, scan
from livetables.operators.serving import AuditSink, Caller, serve
from livetables.operators.store import TableStore
from livetables.operators.tables import KeyedTable
from livetables.plans import reports
from livetables.plans.views import customer_360, inventory_live
from livetables.registry.core import oracle, query
from livetables.session import workdir

COLUMNS = ["event_id", "user_id", "event_type"]


def clicks(spark, d):
    """Events with a nullable number, a boolean and a system column."""
    return fx.clicks(spark, d).withColumns({
        "score": F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 100),
        "big": F.when(F.col("event_id") % 5 != 0, F.col("value") > 20)})


CLICKS = oracle("clicks", body="", ).rstrip() + """,
    c AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_id % 100 END AS score,
                 CASE WHEN event_id % 5 <> 0 THEN value > 20 END AS big FROM clicks)
"""


def _where(name: str, where: tuple, sql: str):
    @query(name, CLICKS + f"SELECT event_id, user_id, event_type FROM c WHERE {sql}")
    def run(spark, d):
        return scan(clicks(spark, d), COLUMNS, where)
    return run


@query("project_columns", CLICKS + "SELECT event_id AS id, event_type, user_id AS \"User\" FROM c")
def project_columns(spark, d):
    return scan(clicks(spark, d), [("event_id", "id"), "EVENT_TYPE", ("user_id", "User")])


@query("project_star", CLICKS + "SELECT event_id, user_id, event_type, value, props, score, big FROM c")
def project_star(spark, d):
    return scan(clicks(spark, d), "*")


@query("cmp_literal", CLICKS + """
    SELECT 'eq' AS op, event_id FROM c WHERE user_id = 7 UNION ALL SELECT 'ne', event_id FROM c WHERE event_type <> 'click'
    UNION ALL SELECT 'lt', event_id FROM c WHERE value < 10.5 UNION ALL SELECT 'le', event_id FROM c WHERE score <= 40
    UNION ALL SELECT 'gt', event_id FROM c WHERE _timestamp > TIMESTAMP '2024-01-10 12:00:00'
    UNION ALL SELECT 'ge', event_id FROM c WHERE score >= 60""")
def cmp_literal(spark, d):
    rows = clicks(spark, d)
    tests = [("eq", ("=", "user_id", 7)), ("ne", ("<>", "event_type", "click")), ("lt", ("<", "value", 10.5)),
             ("le", ("<=", "score", 40)), ("gt", (">", "_timestamp", "2024-01-10 12:00:00")), ("ge", (">=", "score", "60"))]
    parts = [scan(rows, ["event_id"], w).select(F.lit(op).alias("op"), "event_id") for op, w in tests]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_where("cmp_reversed", ("and", ("<", Lit(5), Col("user_id")), (">=", 40, Col("score"))), "5 < user_id AND 40 >= score")
_where("cmp_columns", ("or", ("<", "user_id", Col("score")), ("=", Col("event_id"), Col("_offset"))), "user_id < score OR event_id = _offset")
_where("between", ("or", ("between", "score", 10, 20), ("not_between", "value", 1, 90)), "score BETWEEN 10 AND 20 OR value NOT BETWEEN 1 AND 90")
_where("in_list", ("and", ("in", "event_type", ["click", "view"]), ("not_in", "score", [1, 2, 3])),
       "event_type IN ('click', 'view') AND score NOT IN (1, 2, 3)")
_where("like", ("or", ("like", "event_type", "%i_k"), ("and", ("like", "event_id", "%77"), ("not_like", "event_type", "p%"))),
       "event_type LIKE '%i_k' OR (CAST(event_id AS VARCHAR) LIKE '%77' AND event_type NOT LIKE 'p%')")
_where("ilike", ("ilike", "event_type", "%CLI%"), "event_type ILIKE '%CLI%'")
_where("is_null", ("or", ("is_null", "score"), ("and", ("is_not_null", "big"), ("=", "user_id", 3))),
       "score IS NULL OR (big IS NOT NULL AND user_id = 3)")
_where("is_true_false", ("or", ("is_true", "big"), ("and", ("is_not_false", "big"), ("is_not_true", "big"))),
       "big IS TRUE OR (big IS NOT FALSE AND big IS NOT TRUE)")
_where("and_or_not", ("not", ("or", ("=", "score", 5), ("and", (">", "value", 30), ("not", ("=", "event_type", "view"))))),
       "NOT (score = 5 OR (value > 30 AND NOT event_type = 'view'))")
_where("typed_literals", ("and", (">", "value", -1.5), ("<>", "event_type", "it's"), ("=", "big", True),
                          ("between", "_timestamp", "2024-01-05", "2024-01-20 10:15:30")),
       "value > -1.5 AND event_type <> 'it''s' AND big = TRUE "
       "AND _timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 10:15:30'")


def orders_table(spark, d, buckets: int = 6) -> KeyedTable:
    table = KeyedTable(TableStore(spark, workdir(spark, "serving")), "orders", ["order_id"], buckets)
    table.merge(fx.orders_cdc(spark, d).drop("op"))
    return table


@query("point_lookup", oracle("orders_cdc", body="""
    SELECT order_id, customer_id, status, CAST(total AS DOUBLE) AS total FROM orders_cdc WHERE order_id = 77 AND op = 'u'"""))
def point_lookup(spark, d):
    """As a caller asks for it; only the key's bucket is read."""
    with AuditSink(spark, workdir(spark, "audit")) as audit:
        found = serve(spark, Caller("shop", ["engineer"]), "orders", {"orders": orders_table(spark, d)}, fx.grants(spark, d), audit,
                      select=["order_id", "customer_id", "status", "total"], where=("and", ("=", "order_id", 77), ("not", ("is_null", "status"))))
    return spark.createDataFrame(found.rows, "order_id long, customer_id long, status string, total decimal(18,2)").withColumn("total", F.col("total").cast("double"))


@query("keys_lookup", oracle("orders_t", body="""
    SELECT order_id, customer_id, status FROM orders_t WHERE order_id IN (1, 2, 3, 33, 69, 71, 77, 99) AND order_id % 10 <> 0"""))
def keys_lookup(spark, d):
    """A condition that names several keys, by ``in``, ``or`` and equality: the rows come from their buckets."""
    where = ("or", ("in", "order_id", [1, 2, 3, 33]), ("and", ("in", "order_id", [69, 71, 77, 5]), ("<>", "order_id", 5)), ("=", Lit(99), Col("order_id")))
    return scan(orders_table(spark, d, buckets=32).matching(where), ["order_id", "customer_id", "status"], where)


@query("keyed_membership", oracle("orders_t", "customers", body="""
    SELECT order_id, customer_id, status FROM orders_t WHERE customer_id IN (SELECT customer_id FROM customers WHERE tier = 'gold')"""))
def membership(spark, d):
    wanted = fx.customers(spark, d).filter("tier = 'gold'")
    return keyed_membership(fx.orders(spark, d), wanted, ["customer_id"]).select("order_id", "customer_id", "status")


@query("order_by", CLICKS + """
    SELECT event_id, event_type AS kind, user_id FROM c ORDER BY event_type DESC, user_id ASC, event_id DESC LIMIT 501""")
def order_by(spark, d):
    return lookup(clicks(spark, d), ["event_id", ("event_type", "kind"), "user_id"],
                  order_by=[("kind", "desc"), "user_id", ("event_id", "desc")], limit=500)


@query("nulls_order", CLICKS + """
    SELECT * FROM (SELECT 'asc' AS o, event_id, score FROM c ORDER BY score ASC NULLS LAST, event_id LIMIT 301)
    UNION ALL SELECT * FROM (SELECT 'desc' AS o, event_id, score FROM c ORDER BY score DESC NULLS FIRST, event_id LIMIT 301)
    UNION ALL SELECT * FROM (SELECT 'asc first' AS o, event_id, score FROM c ORDER BY score ASC NULLS FIRST, event_id LIMIT 301)
    UNION ALL SELECT * FROM (SELECT 'desc last' AS o, event_id, score FROM c ORDER BY score DESC NULLS LAST, event_id LIMIT 301)""")
def nulls_order(spark, d):
    rows = clicks(spark, d)
    orders = {"asc": ("score",), "desc": ("score", "desc"), "asc first": ("score", "asc", "nulls_first"), "desc last": ("score", "desc", "nulls_last")}
    parts = [lookup(rows, ["event_id", "score"], order_by=[o, "event_id"], limit=300).select(F.lit(n).alias("o"), "event_id", "score")
             for n, o in orders.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("limit_truncated", CLICKS + "SELECT event_id, user_id, event_type FROM c ORDER BY event_id DESC LIMIT 101")
def limit_truncated(spark, d):
    return lookup(clicks(spark, d), COLUMNS, order_by=[("event_id", "desc")])


@query("offset", CLICKS + "SELECT event_id, user_id, event_type FROM c ORDER BY user_id, event_id LIMIT 51 OFFSET 120")
def offset(spark, d):
    return lookup(clicks(spark, d), COLUMNS, order_by=["user_id", "event_id"], limit=50, offset=120)


@query("top_customers", oracle("customer_360", body="""
    SELECT customer_id, name, country, orders, round(lifetime_value, 2) AS lifetime_value
    FROM customer_360 ORDER BY lifetime_value DESC, customer_id LIMIT 5"""))
def top_customers(spark, d):
    return reports.top_customers(customer_360(fx.customers(spark, d), fx.orders(spark, d)))


@query("restock_list", oracle("inventory_live", body="""
    SELECT product_id, name, category, available FROM inventory_live WHERE low_stock ORDER BY available, product_id"""))
def restock_list(spark, d):
    return reports.restock_list(inventory_live(fx.products(spark, d), fx.inventory(spark, d)))


def _aggregate(name: str, aggs, sql: str, where: tuple | None = None, casts: dict | None = None):
    @query(name, CLICKS + sql)
    def run(spark, d):
        return scan(clicks(spark, d), aggs, where).withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})
    return run


_aggregate("agg_count_star", Agg("COUNT"), "SELECT count(*) AS count FROM c")
_aggregate("agg_count_col", [Agg("count", "score", "scores"), Agg("count", "props", "props")], "SELECT count(score) AS scores, count(props) AS props FROM c")
_aggregate("agg_sum", [Agg("sum", "event_id", "ids"), Agg("sum", "score", "scores")],
           "SELECT CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(score) AS BIGINT) AS scores FROM c", casts={"ids": "long", "scores": "long"})
_aggregate("agg_avg", [Agg("avg", "score", "score"), Agg("avg", "user_id", "users")], "SELECT avg(score) AS score, avg(user_id) AS users FROM c")
_aggregate("agg_min", [Agg("min", "value", "low"), Agg("min", "_timestamp", "first_at"), Agg("min", "event_type", "kind")],
           "SELECT min(value) AS low, min(_timestamp) AS first_at, min(event_type) AS kind FROM c")
_aggregate("agg_max", [Agg("max", "value", "high"), Agg("max", "_timestamp", "last_at"), Agg("max", "score", "score")],
           "SELECT max(value) AS high, max(_timestamp) AS last_at, max(score) AS score FROM c")
_aggregate("agg_filtered", [Agg("count"), Agg("sum", "score", "scores"), Agg("max", "event_id", "last_id")],
           "SELECT count(*) AS count, CAST(sum(score) AS BIGINT) AS scores, max(event_id) AS last_id FROM c WHERE event_type = 'purchase' AND value > 10",
           where=("and", ("=", "event_type", "purchase"), (">", "value", 10)), casts={"scores": "long"})
