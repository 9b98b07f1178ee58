"""Delivery-delay spikes, unusual quantities and the anomaly report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargolens.functions.numbers import exact_round, scaled_round
from cargolens.operators.filters import completed, is_delayed, low_stock, lookup
from cargolens.operators.ordering import with_position
from cargolens.operators.order_statistics import quantiles

# Fixed values ---------------------------------------------------------------
MIN_MONTHS = 4
MIN_ORDERS_IN_MONTH = 3
MIN_HISTORY_MONTHS = 3
MIN_MEANINGFUL_DELAY = 2.0
SIGMA_FLOOR = 0.5
Z_THRESHOLD = 2.0
MIN_GROUP_ROWS = 10
IQR_MULTIPLIER = 3.0
SPIKE_TYPE = "Delivery Delay Spike"
QUANTITY_TYPE = "Unusual Order Quantity"
FOREST_TYPE = "Isolation Forest Flag (delay pattern)"
HEADLINE_ROWS = 15
# ----------------------------------------------------------------------------


def supplier_months(orders: DataFrame) -> DataFrame:
    """Mean delay, delayed orders and orders per supplier and calendar month."""
    delay = F.coalesce(F.col("delivery_delay").try_cast("double"), F.lit(0.0))
    return (
        completed(orders)
        .groupBy("supplier_id", F.trunc("order_date", "month").alias("first_day"))
        .agg(
            F.avg(delay).alias("avg_delay"),
            F.sum(is_delayed()).alias("delayed_count"),
            F.count("*").alias("order_count"),
        )
        .withColumn("month", F.date_format("first_day", "yyyy-MM"))
        .drop("first_day")
    )


def name_or_id() -> Column:
    return F.coalesce("supplier_name", F.col("supplier_id").cast("string"))


def with_names(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Add ``supplier_name``, falling back to the id."""
    names = suppliers.select("supplier_id", "supplier_name")
    return rows.join(names, "supplier_id", "left").withColumn("supplier_name", name_or_id())


def delay_spikes(
    orders: DataFrame, suppliers: DataFrame, z_threshold: float = Z_THRESHOLD
) -> DataFrame:
    """Supplier-months with a mean delay far above the supplier's other months.

    The mean and deviation of the other months follow from the window totals of all
    months less the month itself, so months are not joined with one another. The
    windows run over one row per calendar month, whatever the number of orders.
    """
    supplier = Window.partitionBy("supplier_id")
    months = (
        supplier_months(orders)
        .withColumn("months", F.count("*").over(supplier))
        .filter(
            (F.col("months") >= MIN_MONTHS) & (F.col("order_count") >= MIN_ORDERS_IN_MONTH)
        )
        .withColumn("others", F.count("*").over(supplier) - 1)
        .withColumn("mean", F.avg("avg_delay").over(supplier))
        .withColumn("off", F.col("avg_delay") - F.col("mean"))
        .withColumn("squares", F.sum(F.col("off") * F.col("off")).over(supplier))
        .filter(F.col("others") >= MIN_HISTORY_MONTHS)
    )
    off, others = F.col("off"), F.col("others")
    rest = F.greatest(F.lit(0.0), F.col("squares") - off * off - off * off / others)
    scored = months.withColumn("mu", F.col("mean") - off / others).withColumn(
        "sigma", F.greatest(F.sqrt(rest / (others - 1)), F.lit(SIGMA_FLOOR))
    )
    current = F.col("avg_delay")
    spikes = scored.withColumn("z", (current - F.col("mu")) / F.col("sigma")).filter(
        (current >= MIN_MEANINGFUL_DELAY) & (F.col("z") >= z_threshold) & (current > F.col("mu"))
    )
    # Nine decimals first: the two ways to the same mean differ in the last bits.
    return with_names(spikes, suppliers).select(
        "supplier_id",
        "supplier_name",
        "month",
        exact_round(scaled_round(F.col("mu"), 9), 1).alias("normal_avg_delay_days"),
        exact_round(scaled_round(current, 9), 1).alias("anomalous_avg_delay_days"),
        exact_round(scaled_round(F.col("z"), 9), 2).alias("z_score"),
        F.lit(SPIKE_TYPE).alias("type"),
    )


def spike_headlines(spikes: DataFrame, rows: int = HEADLINE_ROWS) -> DataFrame:
    """The strongest spikes."""
    return spikes.orderBy(F.desc("z_score"), "supplier_id", "month").limit(rows)


def upper_outliers(
    rows: DataFrame, group: str, value: str, deal_by: Sequence[str],
    multiplier: float = IQR_MULTIPLIER, **limits: int,
) -> DataFrame:
    """Rows above the third quartile by more than ``multiplier`` interquartile ranges.

    Groups below ten rows and groups without spread are left out. Adds ``upper_bound``.
    """
    quartiles = quantiles(rows, [group], value, {"q1": 0.25, "q3": 0.75}, deal_by, **limits)
    spread = F.col("q3") - F.col("q1")
    bounds = quartiles.filter((F.col("rows") >= MIN_GROUP_ROWS) & (spread != 0)).select(
        group, (F.col("q3") + F.lit(multiplier) * spread).alias("upper_bound")
    )
    return lookup(rows, bounds, group, deal_by=deal_by).filter(
        F.col(value) > F.col("upper_bound")
    )


def quantity_outliers(orders: DataFrame, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Orders of any status with an unusually large quantity for their product."""
    rows = orders.select("order_id", "product_id", "supplier_id", "quantity")
    return upper_outliers(rows, "product_id", "quantity", ["order_id"], multiplier).select(
        "order_id",
        "product_id",
        "supplier_id",
        F.col("quantity").cast("int").alias("quantity"),
        exact_round(F.col("upper_bound"), 1).alias("upper_bound_iqr"),
        F.lit(QUANTITY_TYPE).alias("type"),
    )


def agreement(spikes: DataFrame, flags: DataFrame) -> DataFrame:
    """Supplier-months found by the spike test, the forest or both."""
    left = spikes.select("supplier_id", "month", "z_score")
    right = flags.select("supplier_id", "month", "isolation_forest_score")
    return left.join(right, ["supplier_id", "month"], "full_outer").withColumn(
        "found_by",
        F.when(F.col("isolation_forest_score").isNull(), "z_score")
        .when(F.col("z_score").isNull(), "isolation_forest")
        .otherwise("both"),
    )


def report_sections(
    spikes: DataFrame, quantities: DataFrame, flags: DataFrame, inventory: DataFrame
) -> dict[str, DataFrame]:
    """The four lists of the anomaly report by name, each with the ``position`` of its rows.

    Spikes begin with the strongest, flags with the lowest score, quantities follow product
    and order, products their key; equal scores follow supplier and month.
    """
    by_month = ["supplier_id", "month"]
    low = low_stock(inventory)
    return {
        "delivery_delay_anomalies": with_position(spikes, [F.desc("z_score"), *by_month]),
        "order_quantity_anomalies": with_position(quantities, ["product_id", "order_id"]),
        "isolation_forest_anomalies": with_position(
            flags, [F.asc("isolation_forest_score"), *by_month]
        ),
        "low_stock_products": with_position(low, ["product_id"]),
    }


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """All lists as one table of JSON records, so no list is gathered in one place."""
    lines = None
    for name, frame in sections.items():
        fields = [c for c in frame.columns if c != "position"]
        part = frame.select(
            F.lit(name).alias("section"), "position",
            F.to_json(F.struct(*fields)).alias("record"),
        )
        lines = part if lines is None else lines.unionByName(part)
    return lines
