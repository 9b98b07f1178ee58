"""Batch answers to the canned analytic questions.

A table of questions is classified by column expressions. Each kind of question is
answered once for all questions of that kind, so no question starts its own scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cargolens.functions.numbers import hundredth_text, percent_text, tenth_text
from cargolens.operators.ordering import running_total
from cargolens.operators.filters import (
    completed, delivery_days, holds, lookup, stock_ratio,
)
from cargolens.operators.trends import decline_text
from cargolens.session import materialize

# Fixed values ---------------------------------------------------------------
# Intents and their patterns, tried in this order on the lower-case question.
INTENT_PATTERNS = [
    ("most_delayed_supplier",
     r"highest number of delay|most delay|which supplier.*most.*delay"),
    ("lowest_inventory_category",
     r"lowest inventory|lowest stock|running low|least stock"),
    ("suppliers_above_delay_threshold",
     r"more than \d+ delayed|delayed orders? (greater|above|more than)"),
    ("average_delivery_time_period",
     r"average delivery time|average delay|delivery time (last|past)"),
    ("supplier_performance_decline",
     r"decline|declined|performance drop|got worse|deteriorat"),
    ("supplier_lookup",
     r"tell me about|show me supplier|profile of|information (on|about)"),
]
NUMBER_PATTERN = r"\b(\d+)\b"
NAME_PATTERN = r"(?:about|for|of)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)"
# A supplier code after the same words; the name pattern would cut it at its digits.
CODE_PATTERN = r"(?:about|for|of)\s+([A-Z][a-zA-Z]*#?[0-9]+)"
DEFAULT_THRESHOLD = 20
TOP_DELAYED_ROWS = 5
RECENT_DAYS = 30
UNROUTED_TEXT = (
    "I couldn't confidently map this question to one of the supported analysis types. Try "
    "asking about: most-delayed suppliers, low inventory categories, suppliers above a delay "
    "threshold, average delivery time, performance decline, or a specific supplier."
)
NO_NAME_TEXT = "Please specify a supplier name or ID."
# ----------------------------------------------------------------------------

MOST = 1 << 62  # larger numbers count as this one, which no count reaches
GRAM_SIZES = (1, 2, 4, 8)  # runs of letters that lead from a search text to suppliers


def _first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _bounded_number(digits: Column) -> Column:
    """Digits as a number of at most ``MOST``; null for none."""
    return F.when(
        digits.isNotNull(),
        F.least(F.coalesce(digits.try_cast("bigint"), F.lit(MOST)), F.lit(MOST)),
    )


def route_questions(questions: DataFrame) -> DataFrame:
    """Add ``intent`` (null if none fits), ``number`` and ``name`` to each question."""
    text = F.lower("question")
    intent = F.lit(None).cast("string")
    for name, pattern in reversed(INTENT_PATTERNS):
        intent = F.when(text.rlike(pattern), name).otherwise(intent)
    return questions.withColumns(
        {
            "intent": intent,
            "number": _bounded_number(_first_match(F.col("question"), NUMBER_PATTERN)),
            "name": F.coalesce(
                _first_match(F.col("question"), CODE_PATTERN),
                _first_match(F.col("question"), NAME_PATTERN),
            ),
        }
    )


def most_delayed(suppliers: DataFrame, rows: int = TOP_DELAYED_ROWS) -> DataFrame:
    """The suppliers with most delayed orders."""
    return (
        suppliers.select(
            "supplier_id", "supplier_name", "delayed_orders", "total_orders", "on_time_rate"
        )
        .orderBy(F.desc("delayed_orders"), "supplier_id")
        .limit(rows)
    )


def category_stock_ratio(inventory: DataFrame) -> DataFrame:
    """Mean ratio of stock to reorder level per category."""
    return inventory.groupBy("category").agg(
        F.avg(stock_ratio()).alias("avg_stock_to_reorder_ratio")
    )


def lowest_inventory_category(inventory: DataFrame) -> DataFrame:
    """The categories by stock ratio, the one closest to running low first."""
    return category_stock_ratio(inventory).orderBy("avg_stock_to_reorder_ratio", "category")


def above_delay_threshold(
    suppliers: DataFrame, threshold: int | None = DEFAULT_THRESHOLD
) -> DataFrame:
    """Suppliers with more delayed orders than ``threshold``; without one, more than 20."""
    least = DEFAULT_THRESHOLD if threshold is None else threshold
    return (
        suppliers.filter(F.col("delayed_orders") > least)
        .select("supplier_id", "supplier_name", "delayed_orders", "total_orders", "on_time_rate")
        .orderBy(F.desc("delayed_orders"), "supplier_id")
    )


def recent_delivery_time(orders: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """Mean delivery days over the last days of order data, and how many orders that is."""
    done = completed(orders).select("order_date", "actual_delivery")
    last = done.agg(F.max("order_date")).scalar()
    return (
        done.filter(F.col("order_date") >= F.date_sub(last, days))
        .agg(
            F.max("order_date").alias("last_date"),
            F.avg(delivery_days()).alias("avg_days"),
            F.count("*").alias("orders"),
        )
    )


def _supplier_sentence() -> Column:
    code = F.col("supplier_id").cast("string")
    return F.concat(
        F.coalesce("supplier_name", code), F.lit(" ("), code,
        F.lit("): on-time rate "), percent_text(F.col("on_time_rate")),
        F.lit(", avg delivery "), F.col("average_delivery_days").cast("string"),
        F.lit(" days, quality score "), F.col("quality_score").cast("string"),
        F.lit(", risk level "), F.col("risk_level"),
        F.lit(" (score "), F.col("risk_score").cast("string"), F.lit(")."),
    )


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def matching_suppliers(names: DataFrame, suppliers: DataFrame) -> DataFrame:
    """All (name, supplier) pairs where the supplier's name or id holds ``name``.

    A pair must share every run of letters of ``name``, so the join goes over the run
    the fewest suppliers hold, and only its suppliers are tested. Runs are of eight
    letters or, for shorter names, of the largest indexed size that fits.
    """
    wanted = names.select("name").distinct().withColumn("needle", F.lower("name"))
    sides = F.array(
        F.lower(F.coalesce("supplier_name", F.lit(""))),
        F.lower(F.col("supplier_id").cast("string")),
    )

    def all_grams(text: Column) -> Column:
        return F.flatten(F.array(*[_grams(text, size) for size in GRAM_SIZES]))

    index = suppliers.select(
        "supplier_id",
        F.explode(F.array_distinct(F.flatten(F.transform(sides, all_grams)))).alias("gram"),
    )
    needle = F.col("needle")
    runs = F.array(needle)
    for size in GRAM_SIZES:
        runs = F.when(F.length(needle) >= size, _grams(needle, size)).otherwise(runs)
    keys = wanted.withColumn("gram", F.explode(runs))
    holders = index.groupBy("gram").agg(F.count("*").alias("holders"))
    rarest = (
        lookup(keys, holders, "gram", "left", deal_by=["name"])
        .groupBy("name", "needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("holders", F.lit(0)), "gram")).alias("gram"))
    )
    candidates = lookup(index, rarest, "gram", deal_by=["supplier_id"]).drop("gram")
    return (
        lookup(candidates, suppliers, "supplier_id", deal_by=["name"])
        .filter(
            holds(F.col("supplier_name"), F.col("name"))
            | holds(F.col("supplier_id").cast("string"), F.col("name"))
        )
        .drop("needle")
    )


def supplier_search(names: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Per name: the first supplier that matches, how many do, and the answer text."""
    return _search(names, materialize(suppliers))  # read by the index and by the test


def _search(names: DataFrame, suppliers: DataFrame) -> DataFrame:
    found = (
        matching_suppliers(names, suppliers)
        .groupBy("name")
        .agg(
            F.min("supplier_id").alias("first_match"),
            F.count("*").alias("matches"),
            F.min_by(_supplier_sentence(), "supplier_id").alias("sentence"),
        )
    )
    missing = F.concat(F.lit("No supplier found matching '"), F.col("name"), F.lit("'."))
    return (
        names.select("name").distinct()
        .join(found, "name", "left")
        .select(
            "name",
            "first_match",
            F.coalesce("matches", F.lit(0)).alias("matches"),
            F.coalesce("sentence", missing).alias("text"),
        )
    )


def counts_above(thresholds: DataFrame, suppliers: DataFrame, **limits: int) -> DataFrame:
    """How many suppliers have more delayed orders than each threshold.

    Thresholds and the histogram of delayed orders are merged by value instead of being
    paired; the suppliers above a value are a running total from the largest value down.
    """
    steps = suppliers.groupBy(F.col("delayed_orders").alias("value")).agg(
        F.count("*").alias("suppliers")
    )
    asked = thresholds.filter(F.col("threshold").isNotNull()).select(
        F.col("threshold").alias("value"), F.lit(0).cast("bigint").alias("suppliers"),
        F.lit(True).alias("asked"),
    )
    merged = (
        steps.filter(F.col("value").isNotNull()).withColumn("asked", F.lit(False))
        .unionByName(asked).groupBy("value")
        .agg(F.sum("suppliers").alias("suppliers"), F.max("asked").alias("asked"))
    )
    totals = running_total(merged, [F.desc("value")], "suppliers", "above", **limits)
    return totals.filter("asked").select(F.col("value").alias("threshold"), "above")


def _general_answers(
    suppliers: DataFrame, orders: DataFrame, inventory: DataFrame
) -> DataFrame:
    """The four answers that do not depend on the wording: one row per intent."""

    def row(intent: str, frame: DataFrame, text: Column) -> DataFrame:
        return frame.select(F.lit(intent).alias("intent"), text.alias("text"))

    delayed = row(
        "most_delayed_supplier",
        most_delayed(suppliers, 1),
        F.concat(
            F.col("supplier_name"), F.lit(" ("), F.col("supplier_id").cast("string"),
            F.lit(") has the highest number of delayed orders: "),
            F.col("delayed_orders").cast("string"), F.lit(" delayed out of "),
            F.col("total_orders").cast("string"), F.lit(" total orders ("),
            percent_text(F.col("on_time_rate")), F.lit(" on-time rate)."),
        ),
    )
    lowest = row(
        "lowest_inventory_category",
        lowest_inventory_category(inventory).limit(1),
        F.concat(
            F.lit("The '"), F.col("category"),
            F.lit("' category has the lowest average stock-to-reorder-level ratio ("),
            hundredth_text(F.col("avg_stock_to_reorder_ratio")),
            F.lit("x), meaning it is closest to running low on average across its products."),
        ),
    )
    recent = row(
        "average_delivery_time_period",
        recent_delivery_time(orders),
        F.concat(
            F.lit("The average delivery time over the last 30 days of order data (ending "),
            F.col("last_date").cast("string"), F.lit(") was "), tenth_text(F.col("avg_days")),
            F.lit(" days, based on "), F.col("orders").cast("string"),
            F.lit(" completed orders."),
        ),
    )
    decline = row(
        "supplier_performance_decline", decline_text(orders, suppliers), F.col("text")
    )
    return delayed.unionByName(lowest).unionByName(recent).unionByName(decline)


def answer_questions(
    questions: DataFrame, suppliers: DataFrame, orders: DataFrame, inventory: DataFrame
) -> DataFrame:
    """Intent and answer text for each question (``qid``, ``question``)."""
    suppliers = materialize(suppliers)  # one row per supplier, read by most answers
    is_count = F.col("intent") == "suppliers_above_delay_threshold"
    is_lookup = F.col("intent") == "supplier_lookup"
    number = F.coalesce("number", F.lit(DEFAULT_THRESHOLD).cast("bigint"))
    routed = route_questions(questions).withColumns(
        {"threshold": F.when(is_count, number), "name": F.when(is_lookup, F.col("name"))}
    )

    counts = counts_above(routed.filter(is_count), suppliers)
    looked_up = _search(
        routed.filter(F.col("name").isNotNull()), suppliers
    ).select("name", F.col("text").alias("lookup_text"))
    general = _general_answers(suppliers, orders, inventory)

    digits = F.ltrim(_first_match(F.col("question"), NUMBER_PATTERN), F.lit("0"))
    asked = F.when(F.col("threshold") < MOST, F.col("threshold").cast("string")).otherwise(digits)
    count_text = F.concat(
        F.lit("Found "), F.col("above").cast("string"), F.lit(" supplier(s) with more than "),
        asked, F.lit(" delayed orders."),
    )
    answered = routed.join(F.broadcast(general), "intent", "left")  # four rows
    # Many questions may ask for the same threshold or name, or for none.
    answered = lookup(answered, counts, "threshold", "left", deal_by=["qid"])
    answered = lookup(answered, looked_up, "name", "left", deal_by=["qid"])
    return answered.select(
        "qid",
        "intent",
        F.when(F.col("intent").isNull(), UNROUTED_TEXT)
        .when(is_count, count_text)
        .when(is_lookup, F.coalesce("lookup_text", F.lit(NO_NAME_TEXT)))
        .otherwise(F.col("text"))
        .alias("text"),
    )
