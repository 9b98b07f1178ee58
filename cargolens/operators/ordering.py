"""Positions and running totals in a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargolens.session import materialize

RANGE_ROWS = 200_000  # rows of one range, which one task sorts


def _in_ranges(df: DataFrame, order: Sequence[Column | str], rows: int) -> DataFrame:
    """The rows in ranges of the order, numbered in ``__range``, written once."""
    stored = materialize(df)
    ranges = max(1, -(-stored.count() // rows))
    dealt = stored.repartitionByRange(ranges, *order)
    return materialize(dealt.withColumn("__range", F.spark_partition_id()))


def _with_offsets(ranged: DataFrame, total: Column) -> DataFrame:
    """Add ``__before``: the total over all earlier ranges. One short row per range is summed."""
    totals = ranged.groupBy("__range").agg(total.alias("__total"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before")
    )
    return ranged.join(F.broadcast(before), "__range")


def with_position(
    df: DataFrame, order: Sequence[Column | str], name: str = "position",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add the place of each row in the order, from 1.

    Rows are sorted in ranges; a row's place is that in its range, after the rows of all
    earlier ranges. Give an order that tells all rows apart: equal rows share a range.
    """
    ranged = _with_offsets(_in_ranges(df, order, range_rows), F.count("*"))
    here = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, F.col("__before") + here).drop("__range", "__before")


def running_total(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over all rows before each row in the order, itself left out."""
    ranged = _with_offsets(_in_ranges(df, order, range_rows), F.sum(value))
    here = Window.partitionBy("__range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum(value).over(here), F.lit(0))
    return ranged.withColumn(name, F.col("__before") + before).drop("__range", "__before")
