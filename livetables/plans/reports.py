"""Reports on the shop views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def revenue_by_tier(customer_360: DataFrame) -> DataFrame:
    value = F.col("lifetime_value").cast("decimal(18,2)")
    return (customer_360.groupBy("tier")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"),
                 F.round(F.sum(value), 2).cast("double").alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_first()))


def top_customers(customer_360: DataFrame, n: int = 5) -> DataFrame:
    return (customer_360.orderBy(F.col("lifetime_value").desc_nulls_first(), "customer_id").limit(n)
            .select("customer_id", "name", "country", "orders", F.round("lifetime_value", 2).alias("lifetime_value")))


def restock_list(inventory_live: DataFrame) -> DataFrame:
    return (inventory_live.filter("low_stock").orderBy("available", "product_id")
            .select("product_id", "name", "category", "available"))
