"""The shop views and their building blocks as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"  # source money may arrive as double; sums of doubles depend on their order
LOW_STOCK = 5            # fixed value: five available units or fewer are low


def full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


def sold_total(row: str = "") -> Column:
    """The part of an order that counts as revenue; ``row`` names the struct that holds the order, with its dot."""
    return F.when(F.col(f"{row}status") != "cancelled", F.col(f"{row}total").cast(MONEY))


def is_open(row: str = "") -> Column:
    return F.when(F.col(f"{row}status") == "open", 1).otherwise(0)


def order_totals_by_customer(orders: DataFrame) -> DataFrame:
    """One row per ordering customer; a customer with a third of all orders shrinks before the shuffle."""
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("orders"),
        F.sum(sold_total()).alias("sold"),
        F.sum(is_open()).alias("open_orders"),
        F.max("created_at").alias("last_order_at"),
    )


def customer_360_rows(customers: DataFrame, totals: DataFrame) -> DataFrame:
    """Customers with their order totals; without orders 0, 0, 0 and no last order."""
    return customers.join(totals, "customer_id", "left").select(
        "customer_id",
        full_name().alias("name"),
        "email", "country", "tier",
        F.coalesce("orders", F.lit(0).cast("long")).alias("orders"),
        F.coalesce("sold", F.lit(0)).cast("double").alias("lifetime_value"),
        F.coalesce("open_orders", F.lit(0).cast("long")).alias("open_orders"),
        "last_order_at",
    )


def customer_360(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers LEFT JOIN orders, grouped per customer.

    The customer id is unique, so grouping before the join gives the same rows and shuffles
    one row per customer instead of every order.
    """
    return customer_360_rows(customers, order_totals_by_customer(orders))


def inventory_live(products: DataFrame, inventory: DataFrame) -> DataFrame:
    available = F.col("on_hand") - F.col("reserved")
    return products.join(inventory, "product_id", "inner").select(
        "product_id", "sku", "name", "category", F.col("price").cast("double").alias("price"),
        "on_hand", "reserved", available.alias("available"), (available <= LOW_STOCK).alias("low_stock"), "updated_at")


def keyed_by_text(view: DataFrame, key: str) -> DataFrame:
    """A view with its key also as text, for topics whose key is a string."""
    return view.select(F.col(key).cast("string").alias("key"), "*")


def order_items(orders: DataFrame, products: DataFrame, product_count: int, lines: int = 3) -> DataFrame:
    """Order lines: a per-row series, cut by a row condition, joined to products on an expression."""
    oid, line = F.col("order_id"), F.col("line_no")
    series = order_lines(orders, lines).withColumn("product_id", (oid * 5 + line * 3) % product_count)
    return series.join(products.select("product_id", "price"), "product_id").select(
        "order_id", "line_no", "product_id",
        (1 + (oid + line) % 3).alias("quantity"),
        F.col("price").alias("unit_price"))


def order_lines(orders: DataFrame, lines: int = 3) -> DataFrame:
    """CROSS JOIN with a series 1..n, as a generator: no pair of rows meets in a join."""
    return (orders.select("order_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(lines).cast("long"))).alias("line_no"))
            .filter(F.col("line_no") <= 1 + F.col("order_id") % lines))


def order_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("total"))


def update_from(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE … FROM: matched rows take the new value, the others keep theirs."""
    new = source.select(key, F.col(column).cast(target.schema[column].dataType).alias("_new"))
    return (target.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new"))


def open_orders_by_customer(orders: DataFrame) -> DataFrame:
    return (orders.filter(F.col("status") == "open")
            .groupBy(F.col("customer_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def status_join(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Declared resources with their observed phase; not yet observed is PENDING."""
    return (declared.join(observed, keys, "left")
            .withColumn("phase", F.coalesce("phase", F.lit("PENDING"))))
