"""The supply tables derived from the star-schema parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.operators.scorecard import scorecard

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Fixed values of the derivation.
IN_TRANSIT_FROM = "2001-10-20"
DELAYED_ABOVE_DISCOUNT = 0.085
BASE_DELIVERY_DAYS = 5.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"'{name}' is not an allowed table; allowed: {TABLES}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_orders(
    spark: SparkSession, sf_dir: str, with_priority: bool = False, only_completed: bool = False
) -> DataFrame:
    """One row per order line.

    The priority needs the large join with ``orders``; leave it out where it is
    not read. Every line has exactly one order, so the join adds and drops no row.
    ``only_completed`` leaves lines in transit unread where the files allow it.
    """
    line = read_table(spark, sf_dir, "lineitem")
    order_date = F.col("l_shipdate").cast("date")
    quantity = F.col("l_quantity").cast("int")
    in_transit = F.col("l_shipdate") >= F.lit(IN_TRANSIT_FROM).cast("timestamp_ntz")
    if only_completed:
        line = line.filter(~in_transit | F.col("l_shipdate").isNull())
    status = (
        F.when(in_transit, "In Transit")
        .when(F.col("l_discount") > DELAYED_ABOVE_DISCOUNT, "Delayed")
        .otherwise("On Time")
    )
    lead_days = F.col("l_linenumber") + 3
    rows = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"),
        F.col("l_orderkey"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_partkey").alias("product_id"),
        order_date.alias("order_date"),
        quantity.alias("quantity"),
        status.alias("status"),
        F.date_add(order_date, lead_days).alias("expected_delivery"),
        F.when(status == "Delayed", quantity % 13 + 1)
        .when(status == "On Time", 0)
        .alias("delivery_delay"),
    ).withColumn(
        "actual_delivery", F.expr("date_add(expected_delivery, delivery_delay)")
    )
    if with_priority:
        priority = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "Urgent")
            .when(F.col("o_orderpriority") == "2-HIGH", "High")
            .otherwise("Standard")
        )
        heads = read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), priority.alias("priority")
        )
        rows = rows.join(heads, "l_orderkey")
    return rows.drop("l_orderkey")


def base_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier attributes that do not depend on the orders."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    key = F.col("s_suppkey")
    return (
        read_table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.col("r_name").alias("category"),
            F.col("n_name").alias("location"),
            (key * 37 % 81 + 20).cast("double").alias("quality_score"),
            F.lit(BASE_DELIVERY_DAYS).alias("average_delivery_days"),
            (key * 53 % 101 + 60).cast("double").alias("cost_index"),
            (F.col("s_acctbal") >= 0).alias("active"),
        )
    )


def supply_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their order rollup, risk score and level."""
    orders = supply_orders(spark, sf_dir, only_completed=True)
    return scorecard(base_suppliers(spark, sf_dir), orders)


def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name")
    )


def supply_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product."""
    size = F.col("p_size")
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        (F.col("p_partkey") * 37 % (size * 40)).alias("current_stock"),
        (size * 10).alias("reorder_level"),
        (size * 40).alias("monthly_demand"),
        F.col("p_retailprice").alias("unit_cost"),
    )
