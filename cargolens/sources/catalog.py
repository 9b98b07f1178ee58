"""Allow-listed tables with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

# The three tables and their columns.
SUPPLIERS = (
    "supplier_id string, supplier_name string, category string, location string, "
    "quality_score double, average_delivery_days double, on_time_rate double, cost_index double, "
    "active boolean, risk_score double, risk_level string, total_orders int, delayed_orders int"
)
ORDERS = (
    "order_id string, supplier_id string, product_id string, order_date string, quantity int, "
    "priority string, expected_delivery string, actual_delivery string, delivery_delay string, "
    "status string"
)
INVENTORY = (
    "product_id string, product_name string, category string, current_stock int, "
    "reorder_level int, monthly_demand int, unit_cost double"
)
SCHEMAS = {"suppliers": SUPPLIERS, "orders": ORDERS, "inventory": INVENTORY}

# Quotes inside of fields are doubled and fields may hold line ends, so a file is read by one
# task; large tables are folders of files, or Parquet.
CSV = {"header": True, "escape": '"'}


def load_table(spark: SparkSession, root: str, name: str, fmt: str = "csv") -> DataFrame:
    """Read one of the known tables from ``root``; any other name is refused."""
    if name not in SCHEMAS:
        raise ValueError(f"'{name}' is not an allowed table; allowed: {sorted(SCHEMAS)}")
    path = f"{root}/{name}.{fmt}"
    reader = spark.read
    if fmt == "csv":
        reader = reader.schema(SCHEMAS[name]).options(**CSV, multiLine=True)
    try:
        table = reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"table '{name}' not found at {path}") from error
        raise
    return typed_orders(table) if name == "orders" else table


def typed_orders(orders: DataFrame) -> DataFrame:
    """Parse order dates; what is no date or number in the optional fields becomes null."""
    return orders.withColumns(
        {
            "order_date": F.to_date("order_date"),
            "expected_delivery": F.to_date("expected_delivery"),
            "actual_delivery": F.try_to_date(F.col("actual_delivery")),
            "delivery_delay": F.col("delivery_delay").try_cast("double"),
        }
    )


def load_bundle(spark: SparkSession, root: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """All three tables by name."""
    return {name: load_table(spark, root, name, fmt) for name in SCHEMAS}


def write_table(table: DataFrame, root: str, name: str, fmt: str = "csv") -> str:
    """Write a table where ``load_table`` finds it."""
    if name not in SCHEMAS:
        raise ValueError(f"'{name}' is not an allowed table; allowed: {sorted(SCHEMAS)}")
    path = f"{root}/{name}.{fmt}"
    writer = table.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(
            **CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.format(fmt).save(path)
    return path
