"""Row filters, derived flags and lookup joins over the supply tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Order and stock status words.
IN_TRANSIT, DELAYED, ON_TIME = "In Transit", "Delayed", "On Time"
LOW_STOCK, STOCK_OK = "LOW STOCK", "OK"


def completed(orders: DataFrame) -> DataFrame:
    """Orders that are not in transit; those without a status are among them."""
    return orders.filter(~F.col("status").eqNullSafe(IN_TRANSIT))


def is_delayed() -> Column:
    return F.when(F.col("status") == DELAYED, 1).otherwise(0)


def delivery_days() -> Column:
    """Days from order to delivery."""
    return F.datediff("actual_delivery", "order_date")


def is_low_stock() -> Column:
    return F.col("current_stock") < F.col("reorder_level")


def stock_value() -> Column:
    return F.col("current_stock") * F.col("unit_cost")


def stock_ratio() -> Column:
    """Stock over reorder level; a reorder level of 0 counts as 1."""
    level = F.when(F.col("reorder_level") == 0, 1).otherwise(F.col("reorder_level"))
    return F.col("current_stock") / level


def low_stock(inventory: DataFrame) -> DataFrame:
    return inventory.filter(is_low_stock()).select(
        "product_id", "product_name", "current_stock", "reorder_level"
    )


def inventory_status(inventory: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """The inventory with a status word per product."""
    return any_of(inventory, category=categories).withColumn(
        "status", F.when(is_low_stock(), LOW_STOCK).otherwise(STOCK_OK)
    )


def any_of(df: DataFrame, **choices: Sequence) -> DataFrame:
    """Keep rows whose columns hold one of the chosen values; no choice keeps all."""
    for column, values in choices.items():
        if values:
            df = df.filter(F.col(column).isin(list(values)))
    return df


def holds(text: Column, part: Column) -> Column:
    """Literal, case-insensitive substring test; null text holds nothing."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def supplier_list(
    suppliers: DataFrame,
    categories: Sequence[str] = (),
    risk_levels: Sequence[str] = (),
    name_part: str = "",
) -> DataFrame:
    """Suppliers by category, risk level and part of the name."""
    kept = any_of(suppliers, category=categories, risk_level=risk_levels)
    if name_part:
        kept = kept.filter(holds(F.col("supplier_name"), F.lit(name_part)))
    return kept.select(
        "supplier_id", "supplier_name", "category", "location", "on_time_rate",
        "average_delivery_days", "quality_score", "risk_level", "risk_score",
    )


def order_list(
    orders: DataFrame,
    suppliers: DataFrame,
    statuses: Sequence[str] = (),
    supplier_names: Sequence[str] = (),
    priorities: Sequence[str] = (),
) -> DataFrame:
    """Orders with the supplier's name, by status, supplier name and priority."""
    kept = any_of(orders, status=statuses, priority=priorities)
    names = any_of(
        suppliers.select("supplier_id", "supplier_name"), supplier_name=supplier_names
    )
    return lookup(kept, names, "supplier_id").select(
        "order_id", "supplier_name", "product_id", "order_date", "quantity", "priority",
        "expected_delivery", "actual_delivery", "delivery_delay", "status",
    )


def fits_broadcast(table: DataFrame) -> bool:
    """Whether Spark, by its own estimate in bytes, will broadcast the table anyway."""
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= most


def frequent_keys(facts: DataFrame, key: str, share: float) -> list:
    """The keys that hold at least ``share`` of the rows, by a mergeable sketch.

    The sketch keeps 1,000 keys per task and gives no key more rows than it has, less a
    thousandth of all rows. At most ``1 / share`` keys, so at most a few come back.
    """
    kind = facts.schema[key].dataType
    found = facts.agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(`{key}`, 100, 1000)").alias("keys"),
    ).first()
    least = max(share * found["n"], 2)
    return [F.lit(e["item"]).cast(kind) for e in found["keys"] or [] if e["item"] is not None and e["count"] >= least]


def lookup(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    deal_by: Sequence[str] = ("order_id",),
    spread: int = 16,
) -> DataFrame:
    """Join facts to a table with few rows per key, safe for keys that hold most facts.

    A table that Spark will broadcast by its size in bytes is joined as it is, and nothing is
    shuffled. Otherwise a sketch of the facts' keys finds those that would overfill a task: their
    facts are dealt over ``spread`` salts and only their rows of the table are copied. The
    salt is a hash of ``deal_by`` and of the partition a fact comes from: copies of one fact are
    dealt out too, and a task that runs again deals the same way.
    """
    if fits_broadcast(table):
        return facts.join(table, key, how)
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = frequent_keys(facts, key, max(1 / tasks, 0.005))
    if not hot:
        return facts.join(table, key, how)
    salt = "__salt"
    is_hot = F.col(key).isin(hot)
    place = F.xxhash64(*deal_by, F.spark_partition_id())
    dealt = facts.withColumn(
        salt, F.when(is_hot, F.pmod(place, F.lit(spread))).otherwise(0).cast("int")
    )
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn(salt, F.explode(salts)), [key, salt], how).drop(salt)
