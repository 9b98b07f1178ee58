"""Supplier scorecards, risk scores and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cargolens.functions.numbers import exact_round, percent_text, scaled_round, whole_text
from cargolens.operators.filters import completed, delivery_days, is_delayed

# Fixed values ---------------------------------------------------------------
LATE_WEIGHT = 45.0
SLOW_ABOVE_DAYS, SLOW_WEIGHT = 5.0, 2.2
QUALITY_TARGET, QUALITY_WEIGHT = 85.0, 0.6
COST_ABOVE, COST_WEIGHT = 110.0, 0.15
MAX_SCORE = 100.0
HIGH_FROM, MEDIUM_FROM = 55.0, 30.0
REASON_RATE_BELOW, REASON_DAYS_ABOVE = 0.85, 7.0
REASON_QUALITY_BELOW, REASON_COST_ABOVE = 85.0, 115.0
NO_RISK_SENTENCE = (
    "No significant risk factors -- performance is within target on all dimensions."
)
NO_RISK_PHRASE = "consistently strong delivery and quality performance"
RECOMMENDATIONS = {
    "HIGH": (
        "1. Initiate a formal performance review.\n"
        "2. Contact the supplier regarding delivery and quality performance.\n"
        "3. Identify and qualify backup suppliers in the same category.\n"
        "4. Review contract performance clauses and penalty terms."
    ),
    "MEDIUM": (
        "1. Monitor the supplier's performance over the next quarter.\n"
        "2. Request a corrective action plan if delays continue.\n"
        "3. Compare cost and quality against category peers."
    ),
    "LOW": (
        "1. Continue standard quarterly evaluation.\n"
        "2. Consider increasing order volume given strong performance.\n"
        "3. No immediate corrective action required."
    ),
}
# ----------------------------------------------------------------------------


def order_rollup(orders: DataFrame) -> DataFrame:
    """Completed, delayed and mean delivery days per supplier."""
    return (
        completed(orders)
        .groupBy("supplier_id")
        .agg(
            F.count("*").alias("total_orders"),
            F.sum(is_delayed()).alias("delayed_orders"),
            F.avg(delivery_days()).alias("mean_days"),
        )
    )


def risk_score() -> Column:
    """Weighted shortfalls in lateness, speed, quality and cost, at most 100."""
    zero = F.lit(0.0)
    late = (F.lit(1.0) - F.col("on_time_rate")) * LATE_WEIGHT
    slow = F.greatest(zero, F.col("average_delivery_days") - SLOW_ABOVE_DAYS) * SLOW_WEIGHT
    poor = F.greatest(zero, F.lit(QUALITY_TARGET) - F.col("quality_score")) * QUALITY_WEIGHT
    dear = F.greatest(zero, F.col("cost_index") - COST_ABOVE) * COST_WEIGHT
    return exact_round(F.least(F.lit(MAX_SCORE), late + slow + poor + dear), 1)


def risk_level(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def scorecard(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    """Suppliers with order counts, on-time rate, delivery days, risk score and level.

    Rates, counts and scores the suppliers already have are computed anew. The orders shrink to one row per supplier before they meet the suppliers. A
    supplier without completed orders gets rate 0 and keeps its own delivery days.
    """
    base = suppliers.select(
        "supplier_id", "supplier_name", "category", "location", "quality_score",
        "average_delivery_days", "cost_index", "active",
    )
    total = F.coalesce("total_orders", F.lit(0))
    delayed = F.coalesce("delayed_orders", F.lit(0))
    rate = F.when(total > 0, exact_round(F.lit(1.0) - delayed / total, 3)).otherwise(0.0)
    days = scaled_round(F.coalesce("mean_days", "average_delivery_days"), 1)
    return (
        base.join(order_rollup(orders), "supplier_id", "left")
        .select(
            "supplier_id", "supplier_name", "category", "location", "quality_score",
            days.alias("average_delivery_days"),
            rate.alias("on_time_rate"),
            "cost_index", "active",
            total.alias("total_orders"),
            delayed.alias("delayed_orders"),
        )
        .withColumn("risk_score", risk_score())
        .withColumn("risk_level", risk_level(F.col("risk_score")))
    )


def _present(reasons: list[Column], otherwise: str) -> Column:
    found = F.filter(F.array(*reasons), lambda reason: reason.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(found)


def risk_sentences() -> Column:
    """Why a supplier has its risk level, one sentence per cause."""
    rate, days = F.col("on_time_rate"), F.col("average_delivery_days")
    quality, cost = F.col("quality_score"), F.col("cost_index")
    return _present(
        [
            F.when(
                rate < REASON_RATE_BELOW,
                F.concat(
                    F.lit("On-time delivery rate is "), percent_text(rate),
                    F.lit(", below the 85% target."),
                ),
            ),
            F.when(
                days > REASON_DAYS_ABOVE,
                F.concat(
                    F.lit("Average delivery time of "), days.cast("string"),
                    F.lit(" days exceeds the 7-day baseline."),
                ),
            ),
            F.when(
                quality < REASON_QUALITY_BELOW,
                F.concat(
                    F.lit("Quality score of "), quality.cast("string"),
                    F.lit(" is below the 85 target."),
                ),
            ),
            F.when(
                cost > REASON_COST_ABOVE,
                F.concat(
                    F.lit("Cost index of "), cost.cast("string"),
                    F.lit(" is above the category norm (110)."),
                ),
            ),
        ],
        NO_RISK_SENTENCE,
    )


def risk_phrases() -> Column:
    """The same causes worded for use inside a sentence."""
    rate, days = F.col("on_time_rate"), F.col("average_delivery_days")
    quality, cost = F.col("quality_score"), F.col("cost_index")
    return _present(
        [
            F.when(
                rate < REASON_RATE_BELOW,
                F.concat(
                    F.lit("an on-time delivery rate of only "), whole_text(rate * 100.0),
                    F.lit("%"),
                ),
            ),
            F.when(
                days > REASON_DAYS_ABOVE,
                F.concat(
                    F.lit("a longer-than-average delivery time of "), days.cast("string"),
                    F.lit(" days"),
                ),
            ),
            F.when(
                quality < REASON_QUALITY_BELOW,
                F.concat(F.lit("a below-target quality score of "), quality.cast("string")),
            ),
            F.when(
                cost > REASON_COST_ABOVE,
                F.concat(F.lit("an above-average cost index of "), cost.cast("string")),
            ),
        ],
        NO_RISK_PHRASE,
    )


def recommendation(level: Column) -> Column:
    """Numbered next steps for a risk level; an unknown level counts as LOW."""
    return (
        F.when(level == "HIGH", RECOMMENDATIONS["HIGH"])
        .when(level == "MEDIUM", RECOMMENDATIONS["MEDIUM"])
        .otherwise(RECOMMENDATIONS["LOW"])
    )


def supplier_profile(suppliers: DataFrame) -> DataFrame:
    """What the profile card of each supplier shows."""
    return suppliers.select(
        "supplier_id", "supplier_name", "category", "location",
        percent_text(F.col("on_time_rate")).alias("on_time_percent"),
        "average_delivery_days", "quality_score", "total_orders", "delayed_orders",
        "cost_index", "risk_level", "risk_score",
    )
