"""Grants, audit, freshness and lineage as DataFrame jobs.

Shapes: tables(topic, …), grants(topic, role), audit(at, principal, roles, channel, topic, query,
outcome, row_count, duration_ms, error), edges(source, target, via_kind, via_name),
resources(kind, name), produced(kind, name, topic), reads(kind, name, topic).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from livetables.session import discard, materialize, workdir

SUPER_ROLES = ("admin", "engineer")  # fixed values: roles that see every table

# The scheme of each kind of dataset.
SCHEMES = {"source": "postgres", "topic": "kafka", "lake": "iceberg", "serving": "context"}

EDGE_BUCKETS = 64
PAGE = 1000      # values of a list
TASK_ROWS = 1_000_000    # rows that a task compares
SEEN = 2000      # statements whose common words are looked up before the others,
STOP_WORDS = 1000    # at most so many

# ---- grants

def visible_tables(tables: DataFrame, grants: DataFrame, roles: Sequence[str], super_roles: Sequence[str] = SUPER_ROLES) -> DataFrame:
    """Super roles see all tables; others those granted to one of their roles."""
    if set(roles) & set(super_roles):
        return tables
    return granted_rows(tables, grants, roles)


def granted_rows(rows: DataFrame, grants: DataFrame, roles: Sequence[str]) -> DataFrame:
    return rows.join(grants.filter(F.col("role").isin(list(roles))), "topic", "left_semi")


def grant(grants: DataFrame, added: DataFrame) -> DataFrame:
    """Add grants; one that exists stays as it is. The table need not exist yet."""
    return grants.select("topic", "role").unionByName(added.select("topic", "role")).dropDuplicates()


def revoke(grants: DataFrame, removed: DataFrame) -> DataFrame:
    return grants.join(removed, ["topic", "role"], "left_anti")


def grants_by_topic(grants: DataFrame) -> DataFrame:
    """Topic with its sorted roles. Repeated grants go before the lists are built."""
    distinct = grants.select("topic", "role").dropDuplicates()
    return distinct.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("role")), ",").alias("roles"))


# ---- audit

def audit_outcome(reason: Column | str) -> Column:
    reason = F.col(reason) if isinstance(reason, str) else reason
    return (F.when(reason.isNull(), "OK").when(reason == "NOT_FOUND", "DENIED")
            .when(reason == "INVALID", "INVALID").otherwise("ERROR"))


def append_audit(rows: DataFrame, path: str) -> None:
    """One row per query, kept by day."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def audit_rollup(audit: DataFrame, start: str, end: str) -> DataFrame:
    at = F.col("at")
    inside = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    return audit.filter(inside).groupBy("principal", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- freshness

def freshness(progress: DataFrame, lag: DataFrame) -> DataFrame:
    """Per table: newest record time, last ingest time, records behind."""
    times = progress.groupBy("topic").agg(F.max("last_record_ts").alias("last_record_ts"),
                                          F.max("last_ingested_at").alias("last_ingested_at"))
    return times.join(lag, "topic", "left")


# ---- lineage

def dataset(kind: str, *parts: Column | str) -> Column:
    """``kafka://orders`` and the like; parts are joined by a slash."""
    pieces = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(f"{SCHEMES[kind]}://"), F.concat_ws("/", *pieces))


def dataset_split(uri: Column | str) -> tuple[Column, Column]:
    """Namespace and name of a dataset URI."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    separator = F.locate("://", uri)
    return F.substring(uri, F.lit(1), separator - 1), F.substring(uri, separator + 3, F.length(uri))


def lineage_edges(sources: DataFrame, views: DataFrame, lake: DataFrame, serving: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """All edges of the declared resources.

    sources(name, connection, table, topic); views(name, topic, input); lake(name, namespace, table, topic);
    serving(name, topic); statements(name, reads, writes) as ``statement_edges`` gives them: each topic a statement reads leads to the table it writes.
    """
    def edge(df, source, target, kind):
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("via_kind"), F.col("name").alias("via_name"))

    lake_name = F.concat_ws(".", "namespace", F.translate("table", ".", "_"))
    edges = (edge(sources, dataset("source", "connection", "table"), dataset("topic", "topic"), "SOURCE")
            .unionByName(edge(views, dataset("topic", "input"), dataset("topic", "topic"), "MATERIALIZED_VIEW"))
            .unionByName(edge(lake, dataset("topic", "topic"), dataset("lake", F.lit("lake"), lake_name), "ICEBERG_TABLE"))
            .unionByName(edge(serving, dataset("topic", "topic"), dataset("serving", "topic"), "CONTEXT_TABLE")))
    if statements is None:
        return edges
    return edges.unionByName(edge(statements.filter("writes IS NOT NULL").dropDuplicates(), dataset("topic", "reads"), dataset("topic", "writes"), "STATEMENT"))


class EdgeIndex:
    """Edges clustered by one end, so that the edges of some datasets are read without the others.

    The edges are written once into ``buckets`` folders by the hash of that end. Build it once for many closures over the same edges.
    """

    def __init__(self, edges: DataFrame, upstream: bool = False, buckets: int = EDGE_BUCKETS):
        self.near, self.far = ("target", "source") if upstream else ("source", "target")
        self.upstream, self.buckets, self.schema, self.spark = upstream, buckets, edges.schema, edges.sparkSession
        self.path = workdir(self.spark, "edges")
        edges.withColumn("_bucket", self._bucket(self.near)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.near).write.partitionBy("_bucket").parquet(self.path)
        self.rows = self.spark.read.schema(StructType([*self.schema, StructField("_bucket", IntegerType())])).parquet(self.path)

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def touching(self, nodes: DataFrame) -> DataFrame:
        """The edges whose near end is among the nodes (column ``node``)."""
        wanted = [r["b"] for r in nodes.select(self._bucket("node").alias("b")).distinct().collect()]
        return self.rows.filter(F.col("_bucket").isin(wanted)).drop("_bucket").join(nodes, F.col(self.near) == F.col("node"), "left_semi")

    def drop(self) -> None:
        discard(self.spark, self.path)


def lineage_closure(edges: DataFrame | EdgeIndex, start: str | DataFrame, upstream: bool = False) -> DataFrame:
    """Every edge reachable from some datasets, once.

    Semi-naive: each round follows the edges of the datasets found last, reading only the folders of an ``EdgeIndex`` that can hold them, and keeps the far ends not seen
    before, so a cycle ends. Rounds are written out: lineage stays short, a lost executor costs one round, and the size of the next frontier is
    known before Spark chooses the join. Lists of seen datasets, and an index made here, are deleted at the end; the rounds' edges are the result.
    """
    index = edges if isinstance(edges, EdgeIndex) else EdgeIndex(edges, upstream)
    if index.upstream != upstream:
        raise ValueError("the index is clustered by the other end")
    spark = index.spark
    frontier = spark.createDataFrame([(start,)], "node string") if isinstance(start, str) else start.toDF("node").distinct()
    root = workdir(spark, "closure")
    node_schema, rounds, nodes = frontier.schema, [], [f"{root}/nodes/0"]
    frontier.write.parquet(nodes[0])
    left = 1
    while left:
        k = len(rounds)
        frontier = spark.read.schema(node_schema).parquet(nodes[-1])
        rounds.append(f"{root}/edges/{k}")
        index.touching(frontier).dropDuplicates().write.parquet(rounds[-1])
        seen, counted = spark.read.schema(node_schema).parquet(*nodes), Observation()
        ends = spark.read.schema(index.schema).parquet(rounds[-1]).select(F.col(index.far).alias("node")).distinct()
        nodes.append(f"{root}/nodes/{k + 1}")
        ends.join(seen, "node", "left_anti").observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(nodes[-1])
        left = counted.get["n"]
    discard(spark, f"{root}/nodes")
    if index is not edges:
        index.drop()
    return spark.read.schema(index.schema).parquet(*rounds)


def written_table(sql: str) -> Column:
    """The last part of the name of the table a statement creates or inserts into; null for other statements.

    Only the statement's beginning is cut into tokens, up to the first sign that can stand neither in its keywords nor in a name.
    """
    beginning = F.regexp_extract(sql, r"^(?:\s+|`[^`]*`|[\w$]+|\.)*", 0)
    return _let(F.regexp_extract_all(beginning, F.lit(r"`[^`]*`|[\w$]+|\."), F.lit(0)), _written)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _written(tokens: Column) -> Column:
    def first(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
        create = lambda i: F.when((word(i) == "IF") & (word(i + 1) == "NOT") & (word(i + 2) == "EXISTS"), i + 3).otherwise(i)
        return F.when((word(0) == "INSERT") & word(1).isin("INTO", "OVERWRITE"), F.lit(2)) \
            .when((word(0) == "CREATE") & (word(1) == "TABLE"), create(2)) \
            .when((word(0) == "CREATE") & (word(1) == "OR") & (word(2) == "REPLACE") & (word(3) == "TABLE"), create(4))

    def parts(rest: Column) -> Column:
        """How many parts the name has: every second token is one while a dot stands before it."""
        named = lambda t: t.rlike(r"^(`[^`]+`|[\w$]+)$")
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(rest) / 2).cast("int")),
                            lambda i: named(F.coalesce(F.get(rest, 2 * i), F.lit(""))) & ((i == 0) | (F.get(rest, 2 * i - 1) == ".")))
        return _let(pairs, lambda p: F.coalesce(F.nullif(F.array_position(p, F.lit(False)), F.lit(0)) - 1, F.size(p)).cast("int"))

    last = lambda rest: _let(parts(rest), lambda n: F.when(n > 0, F.translate(F.get(rest, 2 * (n - 1)), "`", "")))
    head = F.transform(F.slice(tokens, 1, 7), F.upper)
    return _let(_let(head, first), lambda at: F.when(at.isNotNull(), _let(F.slice(tokens, at + 1, F.size(tokens) + 1), last)))


def spread(df: DataFrame) -> DataFrame:
    """Rows that each cost much work, dealt out to all cores if they come in fewer partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _named(sql: str, longest: int | None = None) -> Column:
    """All that a statement may name: what stands in backquotes, bare words, and the shorter names that words with a separator begin with (up to a length)."""
    quoted = F.regexp_extract_all(sql, F.lit(r"(?=`([^`]+)`)"), F.lit(1))
    runs = F.regexp_extract_all(sql, F.lit(r"(?<![\w.$`])(?=([\w.$-]+`?))"), F.lit(1))

    def shorter(run: Column) -> Column:
        """A name may end before each separator of a run."""
        pieces = F.split(run if longest is None else F.left(run, F.lit(longest + 1)), "(?=[.-])")
        names = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), ""))
        return F.when(F.contains(run, F.lit(".")) | F.contains(run, F.lit("-")), names).otherwise(F.array(run))

    # a run that ends in a backquote is no name, but what it begins with may be one
    bare = F.filter(F.flatten(F.transform(F.array_distinct(runs), shorter)), lambda n: ~F.endswith(n, F.lit("`")))
    return F.array_distinct(F.concat(quoted, bare))


def statement_edges(statements: DataFrame, topics: DataFrame) -> DataFrame:
    """Edges of SQL statements: the table each writes, and the known topics it names as a whole.

    A topic is named in backquotes, or bare: not after a word character, dot or backquote, and not
    before a word character or backquote. Names are of letters, digits, ``.``, ``_``, ``-``, ``$``. The words of all texts, and what
    stands in backquotes, are joined with the topics on equality, each once; only words that hold a separator are also cut into the shorter names they begin with.

    Two kinds of words stay out of the join, as no topic equals them: those longer than the longest topic, and common ones (``SELECT``, ``FROM``), of which each has been looked for
    among all topics. ``SEEN`` statements tell which are common; that choice decides how many words are joined, not what is found.
    """
    st = statements.select("name", "sql")
    common = st.limit(SEEN).select(F.explode(_named("sql")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN // 100)
    words = [r["word"] for r in common.orderBy(F.desc("n"), "word").limit(STOP_WORDS).collect()]
    known = topics.agg(F.max(F.length("topic")).alias("longest"), F.collect_set(F.when(F.col("topic").isin(words), F.col("topic"))).alias("topics")).first()
    stop = F.array(*[F.lit(w) for w in words if w not in known["topics"]]).cast("array<string>")
    fitting = F.filter(F.array_except(_named("sql", known["longest"]), stop), lambda n: F.length(n) <= F.lit(known["longest"]))
    names = spread(st).select("name", written_table("sql").alias("_written"), "sql")      # before the names multiply the rows
    # outer: else the engine adds a filter that works the array out a second time
    names = names.select("name", "_written", F.explode_outer(fitting).alias("topic"))
    reads = (names.filter(F.col("_written").isNull() | (F.col("topic") != F.col("_written")))
             .join(topics.select("topic").distinct(), "topic", "left_semi"))
    return reads.select("name", F.col("topic").alias("reads"), F.col("_written").alias("writes")).distinct()


def usage_pairs(topics: DataFrame, produced: DataFrame, reads: DataFrame) -> DataFrame:
    """One row for each topic, role (``produced_by`` or ``used_by``) and resource: what a topic with many readers is asked for."""
    label = F.concat_ws(" ", "kind", "name").alias("resource")
    sides = [df.select("topic", F.lit(role).alias("role"), label) for df, role in ((produced, "produced_by"), (reads, "used_by"))]
    internal = F.col("topic").startswith("_") | F.col("topic").startswith("connect-")
    return sides[0].unionByName(sides[1]).dropDuplicates().join(topics.select("topic").distinct().filter(~internal), "topic", "left_semi")


def numbered(rows: DataFrame, keys: Sequence[str], by: str, number: str = "rank") -> DataFrame:
    """Rows numbered from 1 within their keys in the order of ``by``, although one key may hold a third of them.

    Rows are dealt out by ranges of (keys, by), so a large key lies in many ranges; they are numbered within each range, and each range adds what the ranges before it hold
    of the key. The ranges are written out, as the second pass must see the same ones. Rows must be distinct in (keys, by).
    """
    order = [*keys, by]
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    held = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(by))
    ranked = dealt.withColumn("_local", local).join(held.withColumn("_before", before).drop("_n"), [*keys, "_range"])
    return ranked.withColumn(number, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def pages(rows: DataFrame, keys: Sequence[str], by: str, size: int = PAGE) -> DataFrame:
    """Sorted lists of at most ``size`` values of ``by`` per page: keys, ``page`` from 1, ``items``."""
    placed = numbered(rows.select(*keys, by), keys, by).withColumn("page", (F.floor((F.col("rank") - 1) / size) + 1).cast("int"))
    return placed.groupBy(*keys, "page").agg(F.sort_array(F.collect_list(by)).alias("items"))


def topic_usage(topics: DataFrame, produced: DataFrame, reads: DataFrame) -> DataFrame:
    """Topic, the resources that write it, and those that read it, as comma lists.

    A list is one value, so this view is for topics with few readers; ``usage_pairs`` and ``pages`` of it serve any.
    """
    label = F.concat_ws(" ", "kind", "name")
    producer = (produced.select("topic", label.alias("by")).dropDuplicates()
                .groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("by")), ", ").alias("produced_by")))
    users = (reads.select("topic", label.alias("user")).dropDuplicates()
             .groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("user")), ", ").alias("used_by")))
    internal = F.col("topic").startswith("_") | F.col("topic").startswith("connect-")
    return (topics.select("topic").distinct().filter(~internal)
            .join(producer, "topic", "left").join(users, "topic", "left")
            .select("topic", F.coalesce("produced_by", F.lit("")).alias("produced_by"), F.coalesce("used_by", F.lit("")).alias("used_by")))


def distinct_rows(df: DataFrame, rows: int) -> DataFrame:
    """The distinct rows of a frame of about so many, few of which are equal.

    They are dealt out by all columns before they are compared, some ``TASK_ROWS`` to a task: the tables of seen rows that a task holds do not grow with the input. Partial tables before
    the shuffle would save nothing here, and the engine sizes tasks by compressed bytes, of which such names have few.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *df.columns).dropDuplicates()


def drop_blockers(produced: DataFrame, reads: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """For every resource, the others that depend on it: those that read a topic it writes, and of a connection the sources(name, connection) that use it."""
    writer = produced.select("kind", "name", "topic").dropDuplicates()
    reader = distinct_rows(reads.select(F.concat_ws(" ", "kind", "name").alias("blocked_by"), "topic"), rows := reads.count())
    found = writer.join(reader, "topic").filter(F.col("blocked_by") != F.concat_ws(" ", "kind", "name")).select("kind", "name", "blocked_by")
    if sources is not None:
        found = found.unionByName(sources.select(F.lit("connection").alias("kind"), F.col("connection").alias("name"), F.concat(F.lit("source "), "name").alias("blocked_by")))
    return distinct_rows(found, rows)


def openlineage_events(edges: DataFrame, namespace: str, producer: str, event_time: str, most: int = PAGE) -> DataFrame:
    """RUNNING events of each job with its distinct inputs and outputs, at most ``most`` of either in an event.

    Events of a run add up, so a job with more datasets has several, numbered by ``part`` from 1, with the same run id.
    """
    def side(column):
        ns, name = dataset_split(column)
        return F.struct(ns.alias("namespace"), name.alias("name"))

    ends = F.array(F.struct(F.lit(0).alias("side"), side("source").alias("dataset")),
                   F.struct(F.lit(1).alias("side"), side("target").alias("dataset")))
    distinct = edges.select("via_name", F.explode(ends).alias("e")).select("via_name", "e.side", "e.dataset").dropDuplicates()
    paged = pages(distinct, ["via_name", "side"], "dataset", most)
    listed = lambda n: F.coalesce(F.first(F.when(F.col("side") == n, F.col("items")), ignorenulls=True), F.array().cast("array<struct<namespace:string,name:string>>"))
    jobs = paged.groupBy("via_name", F.col("page").alias("part")).agg(listed(0).alias("inputs"), listed(1).alias("outputs"))
    event = F.to_json(F.struct(
        F.lit("RUNNING").alias("eventType"), F.lit(event_time).alias("eventTime"),
        F.struct(F.substring(F.sha2("via_name", 256), 1, 32).alias("runId")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), F.col("via_name").alias("name")).alias("job"),
        "inputs", "outputs", F.lit(producer).alias("producer"),
        F.lit("https://openlineage.io/spec/2-0-2/OpenLineage.json#/definitions/RunEvent").alias("schemaURL")))
    return jobs.select("via_name", "part", F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"), event.alias("event"))

