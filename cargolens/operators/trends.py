"""Performance trends: halves by order count and halves by calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargolens.functions.numbers import spread_key, tenth_text, whole_text
from cargolens.operators.filters import ON_TIME, completed, is_delayed, lookup
from cargolens.session import materialize

# Fixed values ---------------------------------------------------------------
INSIGHT_MIN_ORDERS = 10
INSIGHT_CONCERN_BELOW = -5.0
TREND_MIN_ORDERS = 20
TREND_IMPROVED_ABOVE, TREND_DECLINED_BELOW = 1.0, -1.0
DECLINE_ROWS = 10
CONCERN_TEXT = (
    "The primary concern is increasing delivery delay; the supplier should be "
    "reviewed for potential capacity or logistics issues."
)
STEADY_TEXT = "Performance has been stable or improving; continue standard monitoring."
NO_DECLINE_TEXT = "Not enough data to compute performance decline."
# ----------------------------------------------------------------------------

BUCKET_WIDTH = 1 << 20  # 4,096 buckets over the 32-bit order hash


def _before(order: list[str]) -> Column:
    """Rows counted in all earlier steps of the supplier."""
    earlier = (
        Window.partitionBy("supplier_id")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("n").over(earlier), F.lit(0))


def _cut(steps: DataFrame, step: str, *kept: str) -> DataFrame:
    """Fill each supplier's quota ``need`` with its counted steps in order.

    Gives the on-time orders of the steps that fit whole, and the step the quota ends
    in (null if it ends with a whole step) with what is left of the quota for it.
    """
    end = F.col("before") + F.col("n")
    inside = (F.col("before") < F.col("need")) & (end > F.col("need"))
    left = (F.col("need") - F.col("before")).alias("need")
    return (
        steps.withColumn("before", _before([step]))
        .groupBy("supplier_id")
        .agg(
            *[F.first(c).alias(c) for c in kept],
            F.sum(F.when(end <= F.col("need"), F.col("good")).otherwise(0)).alias("whole"),
            F.max(F.when(inside, F.struct(F.col(step).alias("step"), left))).alias("split"),
        )
    )


def halves_by_count(
    orders: DataFrame, min_orders: int, bucket_width: int = BUCKET_WIDTH
) -> DataFrame:
    """On-time counts of the earlier ⌊n/2⌋ completed orders of a supplier and of the rest.

    Orders of one day follow one another by a hash of the order id. A supplier may
    hold a third of all orders, so its orders are never ranked in one task: they are
    counted by day, then, for the day the half ends in, by hash bucket, then, for the
    bucket the half ends in, by hash. Every window runs over such counts only. Orders without
    a supplier are left out.
    """
    rows = completed(orders).filter("supplier_id IS NOT NULL").select(
        "supplier_id", "order_id", "order_date",
        F.when(F.col("status") == ON_TIME, 1).otherwise(0).alias("on_time"),
    )
    rows = rows.withColumn("place", spread_key(rows, "order_id"))

    per_supplier = Window.partitionBy("supplier_id")
    days = (
        rows.groupBy("supplier_id", "order_date")
        .agg(F.count("*").alias("n"), F.sum("on_time").alias("good"))
        .withColumn("total", F.sum("n").over(per_supplier))
        .withColumn("total_good", F.sum("good").over(per_supplier))
        .filter(F.col("total") >= min_orders)
        .withColumn("need", F.floor(F.col("total") / 2))
    )
    # One row per supplier, read for the split days and for the result.
    by_day = materialize(_cut(days, "order_date", "total", "total_good"))

    split_days = by_day.filter("split IS NOT NULL").select(
        "supplier_id", F.col("split.step").alias("day"), F.col("split.need").alias("need")
    )
    # One row per order id and outcome, so copies of an order collapse before any window.
    hashes = materialize(
        lookup(rows, split_days, "supplier_id")
        .filter(F.col("order_date") == F.col("day"))
        .groupBy("supplier_id", "need", "place", "order_id", "on_time")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", F.floor(F.col("place") / bucket_width))
    )
    by_bucket = _cut(
        hashes.groupBy("supplier_id", "need", "bucket").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("on_time")).alias("good")
        ),
        "bucket",
    )

    split_buckets = by_bucket.filter("split IS NOT NULL").select(
        "supplier_id", F.col("split.step").alias("bucket"), F.col("split.need").alias("need")
    )
    last = (
        hashes.drop("need")
        .join(split_buckets, ["supplier_id", "bucket"])
        .withColumn("before", _before(["place", "order_id", "on_time"]))
    )
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("need") - F.col("before")))
    tail = last.groupBy("supplier_id").agg(F.sum(taken * F.col("on_time")).alias("tail"))

    zero = F.lit(0)
    good = F.col("whole") + F.coalesce("bucket_whole", zero) + F.coalesce("tail", zero)
    return (
        by_day.join(
            by_bucket.select("supplier_id", F.col("whole").alias("bucket_whole")),
            "supplier_id", "left",
        )
        .join(tail, "supplier_id", "left")
        .select(
            "supplier_id",
            F.col("total").alias("completed_orders"),
            F.floor(F.col("total") / 2).alias("first_orders"),
            good.alias("first_on_time"),
            F.ceil(F.col("total") / 2).alias("second_orders"),
            (F.col("total_good") - good).alias("second_on_time"),
        )
    )


def supplier_trend(orders: DataFrame) -> DataFrame:
    """The insight text of each supplier with at least ten completed orders."""
    first, second, change = F.col("first_rate"), F.col("second_rate"), F.col("change")
    return (
        halves_by_count(orders, INSIGHT_MIN_ORDERS)
        .select(
            "supplier_id", "completed_orders",
            (F.col("first_on_time") / F.col("first_orders")).alias("first_rate"),
            (F.col("second_on_time") / F.col("second_orders")).alias("second_rate"),
        )
        .withColumn("change", (second - first) * 100.0)
        .withColumn("direction", F.when(change > 0, "increased").otherwise("decreased"))
        .withColumn("concern", change < INSIGHT_CONCERN_BELOW)
        .withColumn(
            "insight",
            F.concat(
                F.lit("The supplier's on-time delivery rate "), F.col("direction"),
                F.lit(" from "), whole_text(first * 100.0),
                F.lit("% to "), whole_text(second * 100.0),
                F.lit("% comparing the first and second half of its order history. "),
                F.when(F.col("concern"), CONCERN_TEXT).otherwise(STEADY_TEXT),
            ),
        )
    )


def supplier_trend_label(orders: DataFrame) -> DataFrame:
    """Improved, declined or stable, for suppliers with at least twenty completed orders."""

    def rate(half: str) -> Column:
        late = F.col(f"{half}_orders") - F.col(f"{half}_on_time")
        return F.lit(1.0) - late / F.col(f"{half}_orders")

    change = F.col("change")
    return (
        halves_by_count(orders, TREND_MIN_ORDERS)
        .select(
            "supplier_id", "completed_orders",
            rate("first").alias("first_rate"), rate("second").alias("second_rate"),
        )
        .withColumn("change", (F.col("second_rate") - F.col("first_rate")) * 100.0)
        .withColumn(
            "direction",
            F.when(change > TREND_IMPROVED_ABOVE, "improved")
            .when(change < TREND_DECLINED_BELOW, "declined")
            .otherwise("remained stable"),
        )
    )


def halves_by_calendar(orders: DataFrame) -> DataFrame:
    """Delay rates before and after the middle of the whole order period.

    The middle day belongs to the first half. Suppliers without completed orders in
    one of the halves are left out.
    """
    done = completed(orders).select("supplier_id", "order_date", is_delayed().alias("late"))
    span = done.agg(F.min("order_date").alias("low"), F.max("order_date").alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    first = 2 * F.datediff("order_date", low) <= F.datediff(high, low)
    return (
        done.withColumn("first", first)
        .groupBy("supplier_id")
        .agg(
            F.avg(F.when(F.col("first"), F.col("late"))).alias("delay_rate_first_half"),
            F.avg(F.when(~F.col("first"), F.col("late"))).alias("delay_rate_second_half"),
        )
        .dropna()
        .withColumn(
            "decline", F.col("delay_rate_second_half") - F.col("delay_rate_first_half")
        )
    )


def performance_decline(orders: DataFrame, rows: int = DECLINE_ROWS) -> DataFrame:
    """The suppliers whose delay rate rose most."""
    return halves_by_calendar(orders).orderBy(F.desc("decline"), "supplier_id").limit(rows)


def decline_text(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row: the supplier with the largest decline, in words."""
    worst = performance_decline(orders, 1).join(
        suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left"
    )
    code = F.col("supplier_id").cast("string")
    sentence = F.concat(
        F.coalesce("supplier_name", code), F.lit(" ("), code,
        F.lit(
            ") shows the largest decline in performance: its delay rate increased by "
        ),
        tenth_text(F.col("decline") * 100.0),
        F.lit(
            " percentage points from the first half to the second half of the available "
            "order history."
        ),
    )
    return worst.agg(
        F.coalesce(F.first(sentence), F.lit(NO_DECLINE_TEXT)).alias("text")
    )
