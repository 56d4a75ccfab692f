"""The sample shop: five source tables with planted faults, rebuilt from series formulas."""

from pyspark.sql import functions as F


def _pick(values, g):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (g % len(values) + 1).cast("int"))


def shop_tables(spark):
    def series(n):
        return spark.range(1, n + 1).withColumnRenamed("id", "g")

    g = F.col("g")
    customers = series(200).select(
        g.cast("int").alias("id"),
        _pick(["John", "Mary", "David", "Sarah", "Michael", "Priya", "Wei", "Aisha", "Carlos", "Emma"], g).alias("first_name"),
        _pick(["Smith", "Johnson", "Lee", "Patel", "Garcia", "Khan", "Brown", "Nguyen", "Muller", "Rossi"], g).alias("last_name"),
        F.when(g % 17 == 0, None)
        .when(g.isin(3, 33, 63, 93), "dupe@example.com")
        .otherwise(F.concat(F.lit("user"), g, F.lit("@example.com")))
        .alias("email"),
        F.concat(F.lit("415-555-"), F.lpad((1000 + g % 9000).cast("string"), 4, "0")).alias("phone"),
        F.concat_ws(
            "-",
            F.lpad((100 + g % 800).cast("string"), 3, "0"),
            F.lpad((10 + g % 89).cast("string"), 2, "0"),
            F.lpad((1000 + g % 9000).cast("string"), 4, "0"),
        ).alias("ssn"),
        F.concat(F.lit("192.168."), g % 255, F.lit("."), (g * 7) % 255).alias("ip_address"),
        _pick(["UK", "India", "USA", "Germany", "Canada", "Singapore", "UAE", "Spain", "Australia", "Japan"], g).alias("country"),
    )
    products = series(50).select(
        g.cast("int").alias("id"),
        F.concat(F.lit("Product "), g).alias("name"),
        _pick(["Electronics", "Books", "Home", "Toys", "Apparel"], g).alias("category"),
        (10 + g % 490).cast("decimal(10,2)").alias("price"),
    )
    orders = series(600).select(
        g.cast("int").alias("id"),
        (1 + g % 200).cast("int").alias("customer_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (g % 400).cast("int")).alias("order_date"),
        F.when(g % 19 == 0, None)
        .otherwise(_pick(["paid", "pending", "shipped", "cancelled", "refunded"], g))
        .alias("status"),
        F.when(g % 23 == 0, -25).otherwise(20 + g % 980).cast("decimal(10,2)").alias("total_amount"),
    )
    order_items = series(1500).select(
        g.cast("int").alias("id"),
        (1 + g % 600).cast("int").alias("order_id"),
        (1 + g % 50).cast("int").alias("product_id"),
        (1 + g % 5).cast("int").alias("quantity"),
        (10 + g % 200).cast("decimal(10,2)").alias("unit_price"),
    )
    payments = series(400).select(
        g.cast("int").alias("id"),
        (1 + g % 600).cast("int").alias("order_id"),
        F.lit("4111111111111111").alias("card_number"),
        (20 + g % 980).cast("decimal(10,2)").alias("amount"),
    )
    return {
        "customers": customers,
        "products": products,
        "orders": orders,
        "order_items": order_items,
        "payments": payments,
    }
