"""Grants, audit, freshness and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from livetables import fixtures as fx
from livetables.operators import changelog as cl
from livetables.operators import governance as gov
from livetables.operators.tables import KeyedTable, LogTable
from livetables.registry.core import oracle, query
from livetables.registry.writes import by_time, store
from livetables.session import workdir


def tables(spark, d):
    key = F.col("c_custkey").cast("string")
    return fx.load(spark, d, "customer").select(F.concat(F.lit("customer."), key).alias("topic"), "c_name")


@query("visible_tables", oracle("grants", body="""
    SELECT 'support_agent' AS caller, 'customer.' || c_custkey AS topic FROM customer
    WHERE 'customer.' || c_custkey IN (SELECT topic FROM grants WHERE role = '5-LOW')
    UNION ALL SELECT 'admin', 'customer.' || c_custkey FROM customer"""))
def visible_tables(spark, d):
    see = lambda who, roles: gov.visible_tables(tables(spark, d), fx.grants(spark, d), roles).select(F.lit(who).alias("caller"), "topic")
    return see("support_agent", ["5-LOW"]).unionByName(see("admin", ["admin"]))


@query("grant_revoke", oracle("grants", body="""
    SELECT DISTINCT topic, role FROM (SELECT topic, role FROM grants UNION ALL SELECT 'part.' || p_partkey, '1-URGENT' FROM part)
    WHERE NOT (role = '3-MEDIUM' AND topic IN (SELECT 'customer.' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))"""))
def grant_revoke(spark, d):
    grants = fx.grants(spark, d)
    ahead = fx.load(spark, d, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("topic"), F.lit("1-URGENT").alias("role"))
    building = fx.load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    revoked = building.select(F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("topic"), F.lit("3-MEDIUM").alias("role"))
    return gov.revoke(gov.grant(gov.grant(grants, ahead), ahead), revoked)


@query("grants_by_topic", oracle("grants", body="""
    SELECT topic, string_agg(role, ',' ORDER BY role) AS roles FROM (SELECT DISTINCT topic, role FROM grants) GROUP BY topic"""))
def grants_by_topic(spark, d):
    return gov.grants_by_topic(fx.grants(spark, d))


OUTCOME = "CASE WHEN reason IS NULL THEN 'OK' WHEN reason = 'NOT_FOUND' THEN 'DENIED' WHEN reason = 'INVALID' THEN 'INVALID' ELSE 'ERROR' END"


def audit(spark, d):
    return fx.audit(spark, d).withColumn("outcome", gov.audit_outcome("reason"))


@query("audit_append", oracle("audit", body=f"""
    SELECT "at", principal, roles, channel, topic, query, {OUTCOME} AS outcome, row_count, duration_ms, strftime("at", '%Y-%m-%d') AS day FROM audit"""))
def audit_append(spark, d):
    path = workdir(spark, "audit")
    rows = audit(spark, d).drop("reason")
    cut = F.col("at").cast("date") < F.lit("2024-01-15").cast("date")
    gov.append_audit(rows.filter(cut), path)
    gov.append_audit(rows.filter(~cut), path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


@query("audit_outcome", oracle("audit", body=f"""SELECT "at", principal, reason, {OUTCOME} AS outcome FROM audit"""))
def audit_outcome(spark, d):
    return audit(spark, d).select("at", "principal", "reason", "outcome")


@query("audit_rollup", oracle("audit", body=f"""
    SELECT principal, {OUTCOME} AS outcome, count(*) AS n FROM audit
    WHERE "at" >= TIMESTAMP '2024-01-05 00:00:00' AND "at" < TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL"""))
def audit_rollup(spark, d):
    return gov.audit_rollup(audit(spark, d), "2024-01-05", "2024-01-25")


def _closure(start: str, near: str, far: str) -> str:
    return oracle("edges", recursive=True, body=f"""
    , walk AS (SELECT * FROM edges WHERE {near} = '{start}' UNION SELECT e.* FROM edges e JOIN walk ON e.{near} = walk.{far})
    SELECT * FROM walk""")


@query("lineage_closure", _closure("region/0", "source", "target"))
def lineage_closure(spark, d):
    return gov.lineage_closure(fx.edges(spark, d), "region/0")


@query("lineage_closure_upstream", _closure("order/7", "target", "source"))
def lineage_closure_upstream(spark, d):
    return gov.lineage_closure(fx.edges(spark, d), "order/7", upstream=True)


# Suppliers produce the parts they supply as topics; customers' views read the parts they order.
PRODUCED = """SELECT 'view' AS kind, 'supplier.' || (p_partkey % (SELECT count(*) FROM supplier)) AS name, 'part.' || p_partkey AS topic FROM part WHERE p_partkey % 3 > 0"""
READS = """SELECT 'statement' AS kind, 'order.' || l_orderkey AS name, 'part.' || l_partkey AS topic FROM lineitem"""


def produced(spark, d):
    n = fx.load(spark, d, "supplier").count()
    key = F.col("p_partkey")
    return fx.load(spark, d, "part").filter(key % 3 > 0).select(
        F.lit("view").alias("kind"), F.concat(F.lit("supplier."), (key % n).cast("string")).alias("name"),
        F.concat(F.lit("part."), key.cast("string")).alias("topic"))


def reads(spark, d):
    return fx.load(spark, d, "lineitem").select(
        F.lit("statement").alias("kind"), F.concat(F.lit("order."), F.col("l_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("topic"))


@query("topic_usage", f"""
    WITH p AS ({PRODUCED}), r AS ({READS})
    SELECT t.topic, COALESCE(p.kind || ' ' || p.name, '') AS produced_by, COALESCE(u.users, '') AS used_by
    FROM (SELECT 'part.' || p_partkey AS topic FROM part) t LEFT JOIN p USING (topic)
    LEFT JOIN (SELECT topic, string_agg(DISTINCT kind || ' ' || name, ', ' ORDER BY kind || ' ' || name) AS users FROM r GROUP BY topic) u USING (topic)""")
def topic_usage(spark, d):
    names = fx.load(spark, d, "part").select(F.explode(F.array(
        F.concat(F.lit("part."), F.col("p_partkey").cast("string")), F.concat(F.lit("_part."), F.col("p_partkey").cast("string")))).alias("topic"))
    return gov.topic_usage(names, produced(spark, d), reads(spark, d))


@query("usage_pages", f"""
    WITH p AS ({PRODUCED}), r AS ({READS}),
    pairs AS (SELECT topic, 'produced_by' AS role, kind || ' ' || name AS resource FROM p UNION SELECT topic, 'used_by', kind || ' ' || name FROM r),
    placed AS (SELECT *, row_number() OVER (PARTITION BY topic, role ORDER BY resource) AS n FROM pairs)
    SELECT topic, role, CAST((n - 1) // 7 + 1 AS INTEGER) AS page, string_agg(resource, ', ' ORDER BY resource) AS items FROM placed GROUP BY ALL""")
def usage_pages(spark, d):
    """Readers and writers of each topic in pages of seven."""
    names = fx.load(spark, d, "part").select(F.explode(F.array(
        F.concat(F.lit("part."), F.col("p_partkey").cast("string")), F.concat(F.lit("_part."), F.col("p_partkey").cast("string")))).alias("topic"))
    pairs = gov.usage_pairs(names, produced(spark, d), reads(spark, d))
    return gov.pages(pairs, ["topic", "role"], "resource", size=7).withColumn("items", F.array_join("items", ", "))


@query("drop_blockers", f"""
    WITH p AS ({PRODUCED}), r AS ({READS})
    SELECT DISTINCT p.kind, p.name, r.kind || ' ' || r.name AS blocked_by FROM p JOIN r USING (topic)
    UNION ALL SELECT 'connection', 'pg' || s_nationkey, 'source supplier.' || s_suppkey FROM supplier""")
def drop_blockers(spark, d):
    supplier = fx.load(spark, d, "supplier")
    sources = supplier.select(F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("pg"), F.col("s_nationkey").cast("string")).alias("connection"))
    return gov.drop_blockers(produced(spark, d), reads(spark, d), sources.unionByName(sources))


@query("statement_edges", """
    SELECT 'st' || o_orderkey AS name, 'shop.customer.' || o_custkey AS reads, 'order-' || o_orderkey AS writes FROM orders
    UNION ALL SELECT 'st' || o_orderkey, 'clerk_' || o_custkey % 10, 'order-' || o_orderkey FROM orders WHERE o_custkey % 10 < 5""")
def statement_edges(spark, d):
    """Each order as a statement: it reads a customer topic by its bare name and a clerk topic in
    backquotes; longer names, its own target and plain words are not reads."""
    oid, cid = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    sql = F.concat(F.lit("INSERT INTO `lake`.`db`.`order-"), oid, F.lit("` SELECT c.x, clerk_9x FROM shop.customer."), cid,
                   F.lit(" AS c JOIN `clerk_"), (F.col("o_custkey") % 10).cast("string"),
                   F.lit("` ON xshop.customer."), cid, F.lit(" = c.y WHERE `order-"), oid, F.lit("` IS NULL"))
    statements = fx.load(spark, d, "orders").select(F.concat(F.lit("st"), oid).alias("name"), sql.alias("sql"))
    customers = fx.load(spark, d, "customer").select(F.concat(F.lit("shop.customer."), F.col("c_custkey").cast("string")).alias("topic"))
    clerks = spark.range(5).select(F.concat(F.lit("clerk_"), F.col("id").cast("string")).alias("topic"))
    own = fx.load(spark, d, "orders").select(F.concat(F.lit("order-"), oid).alias("topic"))
    return gov.statement_edges(statements, customers.unionByName(clerks).unionByName(own))


@query("lineage_edges", oracle(body="""
    SELECT 'postgres://shop_pg/public.' || n_name AS source, 'kafka://shop.public.' || n_name AS target, 'SOURCE' AS via_kind, 'shop' AS via_name FROM nation
    UNION ALL SELECT 'kafka://shop.public.' || n_name, 'kafka://customer_' || c_custkey, 'MATERIALIZED_VIEW', 'customer_' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'kafka://shop.public.' || n_name, 'iceberg://lake/streams.shop_public_' || n_name, 'ICEBERG_TABLE', 'shop.public.' || n_name FROM nation
    UNION ALL SELECT 'kafka://customer_' || c_custkey, 'context://customer_' || c_custkey, 'CONTEXT_TABLE', 'customer_' || c_custkey FROM customer
    UNION ALL SELECT 'kafka://customer_' || c_custkey, 'kafka://stats_' || c_custkey, 'STATEMENT', 'st' || c_custkey FROM customer
    UNION ALL SELECT 'kafka://shop.public.' || n_name, 'kafka://stats_' || c_custkey, 'STATEMENT', 'st' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""))
def lineage_edges(spark, d):
    """Sources, views, lake and serving tables, and one statement per customer that reads its view and the nation's topic."""
    nation, customer = fx.load(spark, d, "nation"), fx.load(spark, d, "customer")
    topic, view = F.concat(F.lit("shop.public."), F.col("n_name")), F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"))
    sources = nation.select(F.lit("shop").alias("name"), F.lit("shop_pg").alias("connection"), F.concat(F.lit("public."), F.col("n_name")).alias("table"), topic.alias("topic"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    views = joined.select(view.alias("name"), view.alias("topic"), topic.alias("input"))
    lake = nation.select(topic.alias("name"), F.lit("streams").alias("namespace"), topic.alias("table"), topic.alias("topic"))
    sql = F.concat(F.lit("INSERT INTO stats_"), F.col("c_custkey").cast("string"), F.lit(" SELECT * FROM "), view, F.lit(" v JOIN `shop.public."), F.col("n_name"), F.lit("` n ON v.x = n.x"))
    known = views.select("topic").unionByName(sources.select("topic"))
    statements = gov.statement_edges(joined.select(F.concat(F.lit("st"), F.col("c_custkey").cast("string")).alias("name"), sql.alias("sql")), known)
    return gov.lineage_edges(sources, views, lake, customer.select(view.alias("name"), view.alias("topic")), statements)


def _datasets(column: str, side: str) -> str:
    """JSON list of a page of the datasets of a job, by name."""
    item = f"""CASE WHEN side = '{side}' THEN '{{"namespace":"kafka","name":"' || {column} || '"}}' END"""
    return f"""'[' || coalesce(string_agg({item}, ',' ORDER BY {column}), '') || ']'"""


@query("openlineage_events", oracle("edges", body=f"""
    , ends AS (SELECT DISTINCT via_name, 's' AS side, replace(source, '/', '.') AS name FROM edges UNION SELECT DISTINCT via_name, 't', replace(target, '/', '.') FROM edges),
    placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY via_name, side ORDER BY name) - 1) // 100 + 1 AS INTEGER) AS part FROM ends)
    SELECT via_name, part, CAST(count(*) FILTER (WHERE side = 's') AS INTEGER) AS n_inputs, CAST(count(*) FILTER (WHERE side = 't') AS INTEGER) AS n_outputs,
           '{{"eventType":"RUNNING","eventTime":"2024-01-01T00:00:00Z","run":{{"runId":"' || substring(sha256(via_name), 1, 32)
           || '"}},"job":{{"namespace":"livetables","name":"' || via_name || '"}},"inputs":' || {_datasets("name", "s")} || ',"outputs":' || {_datasets("name", "t")}
           || ',"producer":"livetables","schemaURL":"https://openlineage.io/spec/2-0-2/OpenLineage.json#/definitions/RunEvent"}}' AS event
    FROM placed GROUP BY via_name, part"""))
def openlineage_events(spark, d):
    """A few jobs, one of which leads to every order: its datasets come in events of a hundred."""
    uri = lambda c: F.concat(F.lit("kafka://"), F.translate(c, "/", "."))
    edges = fx.edges(spark, d).withColumns({"source": uri("source"), "target": uri("target")})
    return gov.openlineage_events(edges, "livetables", "livetables", "2024-01-01T00:00:00Z", most=100)


@query("freshness", oracle("clicks", body="""
    SELECT topic, max(t) AS last_record_ts, TRUE AS ingested, CAST(sum(e - c) AS BIGINT) AS lag FROM (
        SELECT 'users' AS topic, max(CASE WHEN _timestamp < '2024-01-10' THEN _timestamp END) AS t, max(_offset) + 1 AS e,
               max(CASE WHEN _timestamp < '2024-01-10' THEN _offset END) + 1 AS c FROM clicks GROUP BY _partition
        UNION ALL SELECT 'clicks', max(_timestamp), max(_offset) + 1, max(_offset) + 1 FROM clicks GROUP BY _partition)
    GROUP BY topic"""))
def freshness(spark, d):
    """Two tables of one store: one has read a third of its topic, the other all of it."""
    tables = store(spark)
    users, log = KeyedTable(tables, "users", ["user_id"]), LogTable(tables, "clicks")
    users.merge(by_time(fx.user_state_log(spark, d))[0])
    log.append(fx.clicks(spark, d))
    ends = cl.next_offsets(fx.clicks(spark, d)).select(
        F.explode(F.array(F.lit("users"), F.lit("clicks"))).alias("topic"), "_partition", F.col("next_offset").alias("end_offset"))
    progress = users.progress().unionByName(log.progress())
    behind = cl.lag(ends, progress.select("topic", "_partition", "next_offset"))
    return gov.freshness(progress, behind).withColumn("ingested", F.col("last_ingested_at").isNotNull()).drop("last_ingested_at")


@query("dataset_split", oracle("edges", body="""
    SELECT split_part(source, '/', 1) AS namespace, split_part(source, '/', 2) AS name FROM edges"""))
def dataset_split(spark, d):
    namespace, name = gov.dataset_split(F.replace("source", F.lit("/"), F.lit("://")))
    return fx.edges(spark, d).select(namespace.alias("namespace"), name.alias("name"))
