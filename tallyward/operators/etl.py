"""The shop's five reporting queries. Facts are summed by key before they meet a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def customer_revenue(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue and order count of paid orders per customer."""
    paid = (
        orders.where(F.col("status") == "paid")
        .groupBy("customer_id")
        .agg(F.sum("total_amount").alias("revenue"), F.count("id").alias("order_count"))
    )
    return (
        customers.select(F.col("id").alias("customer_id"), "country")
        .join(paid, "customer_id")
        .groupBy("customer_id", "country")
        .agg(F.sum("revenue").alias("revenue"), F.sum("order_count").alias("order_count"))
    )


def daily_sales(orders: DataFrame) -> DataFrame:
    """Sales of paid and shipped orders per day."""
    return (
        orders.where(F.col("status").isin("paid", "shipped"))
        .groupBy("order_date")
        .agg(F.sum("total_amount").alias("total_revenue"), F.count(F.lit(1)).alias("num_orders"))
    )


def product_performance(items: DataFrame, products: DataFrame) -> DataFrame:
    """Units and gross sales per product."""
    sold = items.groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"), F.sum(F.col("quantity") * F.col("unit_price")).alias("gross_sales")
    )
    return (
        products.select(F.col("id").alias("product_id"), "name", "category")
        .join(sold, "product_id")
        .groupBy("product_id", "name", "category")
        .agg(F.sum("units_sold").alias("units_sold"), F.sum("gross_sales").alias("gross_sales"))
    )


def payment_summary(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Amount paid beside the total of each paid order."""
    paid = payments.groupBy("order_id").agg(F.sum("amount").alias("paid_total"))
    return (
        orders.select(F.col("id").alias("order_id"), F.col("total_amount").alias("order_total"))
        .join(paid, "order_id")
        .groupBy("order_id", "order_total")
        .agg(F.sum("paid_total").alias("paid_total"))
    )


def customer_360(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders and lifetime value of every customer, those without orders included."""
    placed = orders.groupBy("customer_id").agg(
        F.count("id").alias("orders"), F.sum("total_amount").alias("lifetime_value")
    )
    return (
        customers.select(F.col("id").alias("customer_id"), "email", "country")
        .join(placed, "customer_id", "left")
        .groupBy("customer_id", "email", "country")
        .agg(F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.sum("lifetime_value").alias("lifetime_value"))
    )
