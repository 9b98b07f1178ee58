"""Dashboard numbers and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cargolens.functions.numbers import currency_text, percent_text, tenth_text
from cargolens.operators.filters import (
    ON_TIME, any_of, completed, is_delayed, is_low_stock, low_stock, stock_value,
)

# Fixed values ---------------------------------------------------------------
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH")
ALERT_ROWS = 10
ALERT_LOW_STOCK_ROWS = 5
RED_CIRCLE, YELLOW_CIRCLE = "\U0001F534", "\U0001F7E1"
# ----------------------------------------------------------------------------


def dashboard_kpis(suppliers: DataFrame, orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """The nine headline numbers in one row, with their display texts.

    Each table is reduced on its own; the one-row results of orders and inventory
    enter the row of the suppliers as scalar subqueries.
    """
    done = completed(orders).agg(
        F.avg(F.when(F.col("status") == ON_TIME, 1.0).otherwise(0.0)).alias("on_time"),
        F.coalesce(F.sum(is_delayed()), F.lit(0)).alias("delayed"),
    )
    stock = inventory.agg(
        F.count_if(is_low_stock()).alias("low"),
        F.coalesce(F.sum(stock_value()), F.lit(0.0)).alias("value"),
    )
    return suppliers.agg(
        F.count("*").alias("total_suppliers"),
        F.count_if("active").alias("active_suppliers"),
        F.avg("average_delivery_days").alias("avg_delivery_days"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_suppliers"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk_suppliers"),
    ).select(
        "*",
        done.select("on_time").scalar().alias("on_time_share"),
        done.select("delayed").scalar().alias("delayed_orders"),
        stock.select("low").scalar().alias("low_stock_products"),
        stock.select("value").scalar().alias("inventory_value"),
    ).withColumns(
        {
            "avg_delivery_text": F.concat(tenth_text(F.col("avg_delivery_days")), F.lit(" days")),
            "on_time_text": percent_text(F.col("on_time_share")),
            "inventory_value_text": currency_text(F.col("inventory_value")),
        }
    )


def risk_distribution(suppliers: DataFrame) -> DataFrame:
    """Suppliers per risk level; a level nobody has counts 0."""
    counts = suppliers.groupBy("risk_level").agg(F.count("*").alias("found"))
    levels = suppliers.sparkSession.createDataFrame(
        [(level,) for level in RISK_LEVELS], "risk_level string"
    )
    # Three rows on either side.
    return levels.join(F.broadcast(counts), "risk_level", "left").select(
        "risk_level", F.coalesce("found", F.lit(0)).alias("suppliers")
    )


def status_breakdown(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count("*").alias("orders"))


def monthly_delay_rate(orders: DataFrame) -> DataFrame:
    """Share of completed orders delayed, in percent, by calendar month."""
    return (
        completed(orders)
        .groupBy(F.trunc("order_date", "month").alias("first_day"))
        .agg((F.avg(is_delayed()) * 100.0).alias("delay_rate_pct"))
        .select(F.date_format("first_day", "yyyy-MM").alias("month"), "delay_rate_pct")
    )


def stock_by_category(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("category").agg(
        F.sum("current_stock").alias("current_stock"),
        F.sum("reorder_level").alias("reorder_level"),
    )


def inventory_value_by_category(
    inventory: DataFrame, categories: Sequence[str] = ()
) -> DataFrame:
    return (
        any_of(inventory, category=categories)
        .groupBy("category")
        .agg(F.sum(stock_value()).alias("value"))
    )


def recent_alerts(suppliers: DataFrame, inventory: DataFrame) -> DataFrame:
    """High-risk suppliers, then the first five low-stock products, ten alerts at most."""
    high = (
        suppliers.filter(F.col("risk_level") == "HIGH")
        .select(
            F.lit(0).alias("kind"),
            F.col("supplier_id").alias("id"),
            F.concat(
                F.lit(f"{RED_CIRCLE} **"), "supplier_name", F.lit("** is HIGH risk (score "),
                F.col("risk_score").cast("string"), F.lit(")"),
            ).alias("alert"),
        )
        .orderBy("id")
        .limit(ALERT_ROWS)
    )
    low = (
        low_stock(inventory)
        .orderBy("product_id")
        .limit(ALERT_LOW_STOCK_ROWS)
        .select(
            F.lit(1).alias("kind"),
            F.col("product_id").alias("id"),
            F.concat(
                F.lit(f"{YELLOW_CIRCLE} **"), "product_name", F.lit("** is below reorder level ("),
                F.col("current_stock").cast("string"), F.lit(" / "),
                F.col("reorder_level").cast("string"), F.lit(")"),
            ).alias("alert"),
        )
    )
    return high.unionByName(low).orderBy("kind", "id").limit(ALERT_ROWS)
