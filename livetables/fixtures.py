"""Change logs and shop tables derived from the star-schema test tables, at any scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET_STEP = 1_000_000_000_000
ORDER_PARTITIONS = 6


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, plus some with negative ids that never order."""
    base = load(spark, sf_dir, "customer")
    idle = base.filter("c_custkey % 100 = 0").withColumn("c_custkey", -1 - F.col("c_custkey"))
    cid = F.col("c_custkey")
    tier = F.when(F.col("c_acctbal") > 8000, "platinum").when(F.col("c_acctbal") > 4000, "gold").otherwise("standard")
    return base.unionByName(idle).select(
        cid.alias("customer_id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.test")).alias("email"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.col("c_nationkey").cast("string").alias("country"),
        tier.alias("tier"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "shipped").otherwise("cancelled")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.col("o_orderdate").alias("created_at"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        pid.alias("product_id"),
        F.concat(F.lit("SKU-"), F.lpad(pid.cast("string"), 12, "0")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        pid.alias("product_id"),
        F.col("p_brand").alias("warehouse"),
        (F.col("p_size") * 3).cast("long").alias("on_hand"),
        (pid % 23).alias("reserved"),
        (F.make_timestamp_ntz(*map(F.lit, (2024, 3, 1, 0, 0, 0))) + F.make_dt_interval(F.lit(0), F.lit(0), (pid % 10000).cast("int"))).alias("updated_at"),
    )


def _record_columns(rec_no) -> dict:
    oid = F.col("order_id")
    return {
        "_partition": (oid % ORDER_PARTITIONS).cast("int"),
        "_offset": rec_no * F.lit(OFFSET_STEP) + oid,
        "_timestamp": F.col("created_at") + F.make_dt_interval(F.lit(0), rec_no.cast("int")),
    }


def orders_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three change records per order: created open, set to its real status, and every tenth deleted."""
    real = F.struct("order_id", "customer_id", "status", "total", "created_at")
    fresh = F.struct("order_id", "customer_id", F.lit("open").alias("status"), "total", "created_at")
    none = F.lit(None)
    record = lambda n, op, before, after: F.struct(
        F.lit(n).cast("long").alias("rec_no"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    records = F.array(record(0, "c", none.cast(_image_type(spark, sf_dir)), fresh),
                      record(1, "u", fresh, real),
                      record(2, "d", real, none.cast(_image_type(spark, sf_dir))))
    log = (orders(spark, sf_dir).select("order_id", "created_at", F.explode(records).alias("r"))
           .filter("r.rec_no < 2 OR order_id % 10 = 0"))
    return (log.withColumns(_record_columns(F.col("r.rec_no")))
            .select("order_id", "r.op", "r.before", "r.after", "_partition", "_offset", "_timestamp"))


def _image_type(spark: SparkSession, sf_dir: str):
    return orders(spark, sf_dir).select("order_id", "customer_id", "status", "total", "created_at").schema


def orders_cdc(spark: SparkSession, sf_dir: str, rounds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """The flat keyed log of ``orders_envelope``, or some rounds of it: a delete is a tombstone with null values."""
    log = (orders(spark, sf_dir).withColumn("rec_no", F.explode(F.array(*[F.lit(n).cast("long") for n in rounds])))
           .filter("rec_no < 2 OR order_id % 10 = 0")
           .withColumns(_record_columns(F.col("rec_no"))))
    gone = F.col("rec_no") == 2
    live = lambda value: F.when(~gone, value)
    return log.select(
        "order_id",
        live(F.col("customer_id")).alias("customer_id"),
        live(F.when(F.col("rec_no") == 0, "open").otherwise(F.col("status"))).alias("status"),
        live(F.col("total")).alias("total"),
        live(F.col("created_at")).alias("created_at"),
        F.element_at(F.array(F.lit("c"), F.lit("u"), F.lit("d")), (F.col("rec_no") + 1).cast("int")).alias("op"),
        "_partition", "_offset", "_timestamp",
        gone.alias("_deleted"),
    )


def orders_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later updates that move an order to the next customer, who may not exist."""
    moved = (orders(spark, sf_dir).filter("order_id % 50 = 1")
             .withColumn("customer_id", F.col("customer_id") + 1)
             .withColumns(_record_columns(F.lit(3).cast("long"))))
    return moved.select("order_id", "customer_id", "status", "total", "created_at", F.lit("u").alias("op"),
                        "_partition", "_offset", "_timestamp", F.lit(False).alias("_deleted"))


def customers_cdc(spark: SparkSession, sf_dir: str, rounds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Every customer created as standard, then set to the real tier; some deleted afterwards. ``rounds`` takes some of these three steps."""
    log = (customers(spark, sf_dir)
           .withColumn("rec_no", F.explode(F.array(*[F.lit(n).cast("long") for n in rounds])))
           .filter("rec_no < 2 OR customer_id % 37 = 5"))
    gone = F.col("rec_no") == 2
    live = lambda value: F.when(~gone, value)
    cid = F.col("customer_id")
    return log.select(
        "customer_id",
        *[live(F.col(c)).alias(c) for c in ("email", "first_name", "last_name", "country")],
        live(F.when(F.col("rec_no") == 0, "standard").otherwise(F.col("tier"))).alias("tier"),
        F.lit(0).alias("_partition"),
        # offsets are never negative, ids may be
        (F.col("rec_no") * F.lit(OFFSET_STEP) + F.when(cid >= 0, cid * 2).otherwise(-1 - cid * 2)).alias("_offset"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("rec_no") + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("_timestamp"),
        gone.alias("_deleted"),
    )


def products_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product at price zero, then at its price; some deleted."""
    log = (products(spark, sf_dir)
           .withColumn("rec_no", F.explode(F.array(*[F.lit(n).cast("long") for n in range(3)])))
           .filter("rec_no < 2 OR product_id % 17 = 3"))
    gone = F.col("rec_no") == 2
    live = lambda value: F.when(~gone, value)
    return log.select(
        "product_id",
        *[live(F.col(c)).alias(c) for c in ("sku", "name", "category")],
        live(F.when(F.col("rec_no") == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("price"))).alias("price"),
        F.lit(0).alias("_partition"),
        (F.col("rec_no") * F.lit(OFFSET_STEP) + F.col("product_id")).alias("_offset"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("rec_no") + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("_timestamp"),
        gone.alias("_deleted"),
    )


def inventory_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock received with nothing reserved, then reserved; some deleted."""
    log = (inventory(spark, sf_dir)
           .withColumn("rec_no", F.explode(F.array(*[F.lit(n).cast("long") for n in range(3)])))
           .filter("rec_no < 2 OR product_id % 19 = 4"))
    gone = F.col("rec_no") == 2
    live = lambda value: F.when(~gone, value)
    return log.select(
        "product_id",
        live(F.col("warehouse")).alias("warehouse"),
        live(F.col("on_hand")).alias("on_hand"),
        live(F.when(F.col("rec_no") == 0, F.lit(0).cast("long")).otherwise(F.col("reserved"))).alias("reserved"),
        live(F.when(F.col("rec_no") == 0, F.col("updated_at") - F.make_dt_interval(F.lit(1))).otherwise(F.col("updated_at"))).alias("updated_at"),
        F.lit(0).alias("_partition"),
        (F.col("rec_no") * F.lit(OFFSET_STEP) + F.col("product_id")).alias("_offset"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.col("rec_no") + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("_timestamp"),
        gone.alias("_deleted"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        (F.col("user_id") % 4).cast("int").alias("_partition"),
        F.col("event_id").alias("_offset"),
        F.col("ts").alias("_timestamp"),
    )


def clicks_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log with every tenth record delivered twice."""
    log = clicks(spark, sf_dir)
    return log.unionByName(log.filter("event_id % 10 = 0"))


def user_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks keyed by user; an error event is a tombstone."""
    gone = F.col("event_type") == "error"
    values = {c: F.when(~gone, F.col(c)) for c in ("event_id", "value", "props")}
    return (clicks(spark, sf_dir).withColumn("_deleted", gone).withColumns(values)
            .withColumn("event_type", F.when(~gone, F.col("event_type"))))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic per customer, granted to the roles of its orders; repeated grants included."""
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer."), F.col("o_custkey").cast("string")).alias("topic"),
        F.col("o_orderpriority").alias("role"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = (F.when(F.col("value") < 5, "NOT_FOUND").when(F.col("value") < 10, "INVALID")
              .when(F.col("value") < 12, "TIMEOUT").when(F.col("value") < 13, "FAILED"))
    return load(spark, sf_dir, "events").select(
        F.col("ts").alias("at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("principal"),
        F.lit("support_agent").alias("roles"),
        F.when(F.col("event_id") % 2 == 0, "REST").otherwise("MCP").alias("channel"),
        F.col("event_type").alias("topic"),
        F.concat(F.lit("lookup "), F.col("event_type")).alias("query"),
        reason.alias("reason"),
        F.get_json_object("props", "$.k").cast("long").alias("row_count"),
        (F.col("event_id") % 40).alias("duration_ms"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order, plus nation back to region, so that it has cycles."""
    def ref(kind, column):
        return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))

    def step(df, source, target, via):
        return df.select(source.alias("source"), target.alias("target"), F.lit("VIEW").alias("via_kind"), F.lit(via).alias("via_name"))

    nation = load(spark, sf_dir, "nation")
    return (step(nation, ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "nations")
            .unionByName(step(nation, ref("nation", "n_nationkey"), ref("region", "n_regionkey"), "regions"))
            .unionByName(step(load(spark, sf_dir, "customer"), ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "customers"))
            .unionByName(step(load(spark, sf_dir, "orders"), ref("customer", "o_custkey"), ref("order", "o_orderkey"), "orders")))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as framed payloads: a zero byte, a four-byte schema id, the JSON body. Keys are framed or plain text."""
    body = F.to_json(F.struct("event_id", "user_id", "event_type"))
    head = F.concat(F.lit("00"), F.lpad(F.hex(F.col("event_id") % 3 + 1), 8, "0"))
    framed_key = F.unhex(F.concat(head, F.hex(F.encode(F.col("user_id").cast("string"), "UTF-8"))))
    plain_key = F.encode(F.concat(F.lit("u"), F.col("user_id").cast("string")), "UTF-8")
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, framed_key).otherwise(plain_key).alias("key"),
        F.unhex(F.concat(head, F.hex(F.encode(body, "UTF-8")))).alias("value"),
    )


def framed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw records keyed by user: both sides framed, two versions of the key and three of the value; an error event is a tombstone."""
    head = lambda i: F.concat(F.lit("00"), F.lpad(F.hex(i), 8, "0"))
    frame = lambda i, body: F.unhex(F.concat(head(i), F.hex(F.encode(body, "UTF-8"))))
    value = frame(F.col("event_id") % 3 + 1, F.to_json(F.struct("event_id", "user_id", "event_type")))
    return clicks(spark, sf_dir).select(
        frame(F.col("event_id") % 2 + 11, F.to_json(F.struct("user_id"))).alias("key"),
        F.when(F.col("event_type") != "error", value).alias("value"), "_partition", "_offset", "_timestamp")
