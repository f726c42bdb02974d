import json

import pytest
from pyspark.sql import functions as F

from livetables.operators import governance as gov
from tests.conftest import rows

EDGE = "source string, target string, via_kind string, via_name string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "VIEW", f"{a}{b}") for a, b in pairs], EDGE)


def test_closure_ends_on_cycles_and_finds_all(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("z", "a"))
    assert rows(gov.lineage_closure(e, "a"), "source", "target") == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert rows(gov.lineage_closure(e, "d", upstream=True), "source", "target") == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a")]
    assert gov.lineage_closure(e, "nowhere").count() == 0
    starts = spark.createDataFrame([("x",), ("b",), ("b",)], "node string")
    assert gov.lineage_closure(e.unionByName(e), starts).count() == 5


def test_closure_equals_brute_force(spark, sf):
    from livetables import fixtures as fx
    e = fx.edges(spark, sf)
    known, reached = e.collect(), set()
    todo = {"region/1"}
    while todo:
        step = {tuple(r) for r in known if r["source"] in todo} - reached
        reached |= step
        todo = {r[1] for r in step}
    assert {tuple(r) for r in gov.lineage_closure(e, "region/1").collect()} == reached


def statement(spark, sql, *topics):
    st = spark.createDataFrame([("s", sql)], "name string, sql string")
    names = spark.createDataFrame([(t,) for t in topics], "topic string")
    return gov.statement_edges(st, names)


def reads(spark, sql, *topics):
    return sorted(r["reads"] for r in statement(spark, sql, *topics).collect())


def test_topics_match_as_whole_names(spark):
    sql = "SELECT * FROM shop.public.orders o JOIN `orders-raw` r ON o.id = r.id"
    assert reads(spark, sql, "shop.public.orders", "orders", "orders-raw", "public.orders", "shop.public.orders2", "shop.public.order") == ["orders-raw", "shop.public.orders"]
    assert reads(spark, "SELECT * FROM orders_v2, xorders, `my orders`", "orders", "my") == []
    assert reads(spark, "SELECT orders.x FROM orders", "orders", "x") == ["orders"]
    assert reads(spark, "SELECT 1 FROM a.b-c.d", "a.b", "a.b-c", "a.b-c.d", "a", "c", "c.d", "b", "d") == ["a", "a.b", "a.b-c", "a.b-c.d", "c", "c.d"]
    assert reads(spark, "FROM orders`", "orders") == []


def test_statement_matches_brute_force_patterns(spark):
    """Against the definition: backquoted, or bare between characters that cannot extend the name."""
    import random
    import re
    rnd = random.Random(1)
    topics = ["a", "b", "a.b", "a-b", "b.a", "ab", "_a", "a_", "-a", "a-"]
    texts = ["".join(rnd.choice(["a", "b", ".", "-", "_", " ", "`", "`a`", ",", "é"]) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    pattern = {t: re.compile(rf"`{re.escape(t)}`|(?<![\w.`]){re.escape(t)}(?![\w`])", re.ASCII) for t in topics}
    st = spark.createDataFrame(list(enumerate(texts)), "name int, sql string")
    got = rows(gov.statement_edges(st, spark.createDataFrame([(t,) for t in topics], "topic string")), "name", "reads")
    assert got == sorted(((i, t) for i, sql in enumerate(texts) for t in topics if pattern[t].search(sql)), key=repr)


def test_written_table(spark):
    w = lambda sql: (statement(spark, sql, "t").first() or {"writes": "no read"})["writes"]
    assert w("INSERT INTO `cat`.`db`.`out.x` SELECT * FROM t") == "out.x"
    assert w(" create or replace table IF NOT EXISTS"[0:24] + " db.out WITH (1) AS SELECT * FROM t") == "out"
    assert w("CREATE TABLE IF NOT EXISTS out AS SELECT * FROM t") == "out"
    assert w("insert overwrite out\nSELECT * FROM t") == "out"
    assert w("SELECT * FROM t") is None
    assert w("INSERT INTO t SELECT * FROM t") == "no read"


def test_usage_and_blockers(spark):
    produced = spark.createDataFrame([("source", "shop", "orders"), ("view", "v", "v")], "kind string, name string, topic string")
    used = spark.createDataFrame([("view", "v", "orders"), ("serving", "v", "v"), ("lake", "orders", "orders"), ("lake", "orders", "orders"), ("view", "v", "v")], "kind string, name string, topic string")
    topics = spark.createDataFrame([("orders",), ("v",), ("_schemas",), ("connect-offsets",), ("idle",)], "topic string")
    assert rows(gov.topic_usage(topics, produced, used)) == [
        ("idle", "", ""), ("orders", "source shop", "lake orders, view v"), ("v", "view v", "serving v, view v")]
    blockers = [("source", "shop", "lake orders"), ("source", "shop", "view v"), ("view", "v", "serving v")]
    assert rows(gov.drop_blockers(produced, used)) == blockers
    sources = spark.createDataFrame([("shop", "pg"), ("crm", "pg")], "name string, connection string")
    assert rows(gov.drop_blockers(produced, used, sources)) == [("connection", "pg", "source crm"), ("connection", "pg", "source shop"), *blockers]
    assert rows(gov.usage_pairs(topics, produced, used)) == [("orders", "produced_by", "source shop"), ("orders", "used_by", "lake orders"), ("orders", "used_by", "view v"),
                                                             ("v", "produced_by", "view v"), ("v", "used_by", "serving v"), ("v", "used_by", "view v")]


def test_pages_of_a_hot_topic(spark):
    """A topic with most of the readers lies in many ranges; its pages are full, sorted and complete."""
    readers = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("topic"), F.format_string("r%05d", "id").alias("resource"))
    placed = gov.numbered(readers.repartition(8), ["topic"], "resource")
    want = {}
    for topic, resource in sorted(tuple(r) for r in readers.collect()):
        want.setdefault(topic, []).append(resource)
    assert {(r.topic, r.resource): r["rank"] for r in placed.collect()} == {(t, x): i + 1 for t, xs in want.items() for i, x in enumerate(xs)}
    got = {(r.topic, r.page): list(r["items"]) for r in gov.pages(readers, ["topic"], "resource", 100).collect()}
    assert got == {(t, i // 100 + 1): xs[i:i + 100] for t, xs in want.items() for i in range(0, len(xs), 100)}


def test_statement_edges_are_lineage(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    statements = statement(spark, "INSERT INTO out SELECT * FROM a JOIN `b.c` ON a.x = out.x", "a", "b.c", "out").unionByName(statement(spark, "SELECT * FROM a", "a"))
    got = gov.lineage_edges(none("name string, connection string, table string, topic string"), none("name string, topic string, input string"),
                            none("name string, namespace string, table string, topic string"), none("name string, topic string"), statements)
    assert rows(got) == [("kafka://a", "kafka://out", "STATEMENT", "s"), ("kafka://b.c", "kafka://out", "STATEMENT", "s")]
    assert rows(gov.lineage_closure(got, "kafka://a"), "target") == [("kafka://out",)]


def test_closure_reads_the_frontiers_part_only(spark, monkeypatch):
    """A chain beside many edges of others: each round reads a few folders; an index serves several closures and stays."""
    many = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("source"), F.concat(F.lit("y"), "id").alias("target"), F.lit("VIEW").alias("via_kind"), F.lit("v").alias("via_name"))
    chain = edges(spark, *[(f"c{i}", f"c{i + 1}") for i in range(4)])
    index = gov.EdgeIndex(many.unionByName(chain), buckets=32)
    read, touching = [], gov.EdgeIndex.touching

    def watched(self, nodes):
        out = touching(self, nodes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        read.append(nodes.count() + ("PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan))
        return out
    monkeypatch.setattr(gov.EdgeIndex, "touching", watched)
    assert gov.lineage_closure(index, "c0").count() == 4 and gov.lineage_closure(index, "c2").count() == 2
    assert read == [2] * (5 + 3)
    with pytest.raises(ValueError):
        gov.lineage_closure(index, "c0", upstream=True)
    index.drop()


def test_openlineage(spark):
    e = spark.createDataFrame([("kafka://a", "kafka://v", "VIEW", "v"), ("kafka://b", "kafka://v", "VIEW", "v"), ("kafka://a", "kafka://v", "VIEW", "v")], EDGE)
    parts = gov.openlineage_events(e, "ns", "me", "2026-01-01T00:00:00Z", most=1).orderBy("part").collect()
    assert [(r["part"], r["n_inputs"], r["n_outputs"]) for r in parts] == [(1, 1, 1), (2, 1, 0)] and json.loads(parts[1]["event"])["outputs"] == []
    assert len({json.loads(r["event"])["run"]["runId"] for r in parts}) == 1
    row = gov.openlineage_events(e, "ns", "me", "2026-01-01T00:00:00Z").first()
    event = json.loads(row["event"])
    assert (row["n_inputs"], row["n_outputs"]) == (2, 1)
    assert event["inputs"] == [{"namespace": "kafka", "name": "a"}, {"namespace": "kafka", "name": "b"}]
    assert event["outputs"] == [{"namespace": "kafka", "name": "v"}] and event["job"] == {"namespace": "ns", "name": "v"}
    assert event["eventType"] == "RUNNING" and len(event["run"]["runId"]) == 32


def test_dataset_split(spark):
    df = spark.createDataFrame([("iceberg://lake/ns.t",), ("kafka://orders",)], "u string")
    assert rows(df.select(*[c.alias(n) for c, n in zip(gov.dataset_split("u"), "ab")])) == [("iceberg", "lake/ns.t"), ("kafka", "orders")]


def test_outcomes(spark):
    df = spark.createDataFrame([(None,), ("NOT_FOUND",), ("INVALID",), ("TIMEOUT",), ("OTHER",)], "r string")
    assert [x[0] for x in df.select(gov.audit_outcome("r")).collect()] == ["OK", "DENIED", "INVALID", "ERROR", "ERROR"]


def test_grants_keep_after_table_is_gone(spark):
    g = gov.grant(spark.createDataFrame([("t", "r")], "topic string, role string"), spark.createDataFrame([("t", "r"), ("later", "r")], "topic string, role string"))
    assert rows(g) == [("later", "r"), ("t", "r")]
    assert rows(gov.visible_tables(spark.createDataFrame([("t",), ("u",)], "topic string"), g, ["r"]), "topic") == [("t",)]


def test_written_table_and_long_names(spark):
    long_name = "n" * 300
    sql = [("INSERT INTO a.`b c`.d SELECT 1", "d"), ("create or replace table if not exists `x` AS SELECT 1", "x"), ("CREATE TABLE t$1 AS SELECT 1", "t$1"),
           ("insert overwrite p . q SELECT", "q"), ("SELECT 1", None), ("CREATE VIEW v AS SELECT 1", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(sql)], "i int, sql string").select("i", gov.written_table("sql").alias("w"))
    assert dict(got.collect()) == {i: w for i, (_, w) in enumerate(sql)}
    statements = spark.createDataFrame([("s", f"INSERT INTO out SELECT * FROM {long_name} JOIN a$b")], "name string, sql string")
    topics = spark.createDataFrame([(long_name,), ("a$b",), ("a",), ("b",)], "topic string")
    assert {r.reads for r in gov.statement_edges(statements, topics).collect()} == {long_name, "a$b"}


def test_only_words_that_may_be_topics_are_joined(spark, monkeypatch):
    """Long texts between backquotes and common words that are no topic stay out of the join; common ones that are topics, and the words of later statements, do not."""
    monkeypatch.setattr(gov, "SEEN", 100)
    sql = F.concat(F.lit("INSERT INTO `out` SELECT a.x, b FROM shop.t"), F.col("id").cast("string"), F.lit(" AS a JOIN `every` ON a.x = b WHERE `every` IS NULL"))
    statements = spark.range(500).select(F.col("id").alias("name"), F.when(F.col("id") < 400, sql).otherwise(F.lit("SELECT * FROM late JOIN `a.x`")).alias("sql"))
    topics = spark.createDataFrame([(t,) for t in ["every", "shop", "late", "a.x", "out", *(f"shop.t{i}" for i in range(0, 500, 2))]], "topic string")
    lists, explode = [], F.explode_outer
    monkeypatch.setattr(F, "explode_outer", lambda c: lists.append(c) or explode(c))
    edges = gov.statement_edges(statements, topics)
    assert statements.select(F.sum(F.size(lists[-1]))).first()[0] <= 400 * 6 + 100 * 6       # some 20 words each
    want = {(i, t, "out") for i in range(400) for t in ("every", "shop", "a.x")} | {(i, f"shop.t{i}", "out") for i in range(0, 400, 2)} | {(i, t, None) for i in range(400, 500) for t in ("late", "a.x")}
    assert set(map(tuple, edges.collect())) == want
    assert gov.statement_edges(statements, topics.limit(0)).count() == 0 and gov.statement_edges(statements.limit(0), topics).count() == 0


def test_blockers_are_dealt_out_by_their_number(spark, monkeypatch):
    """The rows that a task compares are bounded, whatever the engine's number of partitions."""
    monkeypatch.setattr(gov, "TASK_ROWS", 100)
    reads = spark.range(6000).select(F.lit("statement").alias("kind"), F.concat(F.lit("s"), (F.col("id") % 4000).cast("string")).alias("name"), F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("topic"))
    produced = spark.range(20).select(F.lit("view").alias("kind"), F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("name"), F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("topic"))
    sources = spark.createDataFrame([("s", "pg"), ("s", "pg")], "name string, connection string")
    found = gov.drop_blockers(produced, reads, sources)
    sizes = [n for n in found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert found.count() == found.distinct().count() == 4001 and len(sizes) > 50 and max(sizes) < 200
    empty = reads.limit(0)
    assert gov.drop_blockers(produced, empty).count() == 0
