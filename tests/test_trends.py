"""Halves of the order history against a plain sort, with hot suppliers, days and ids."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from cargolens.operators import trends

SCHEMA = "order_id bigint, supplier_id bigint, order_date date, status string"
DAY = dt.date(2024, 1, 1)


def _orders(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _place(order_id):
    return order_id % 2147483648 * 2654435761 % 4294967296


def _brute(rows, least):
    per = defaultdict(list)
    for order_id, supplier, date, status in rows:
        if status != "In Transit":
            per[supplier].append((date, _place(order_id), order_id, status == "On Time"))
    result = {}
    for supplier, orders in per.items():
        if len(orders) >= least:
            orders.sort()
            half = len(orders) // 2
            result[supplier] = (
                len(orders), sum(o[3] for o in orders[:half]), sum(o[3] for o in orders[half:])
            )
    return result


@pytest.mark.parametrize("width", [1 << 20, 1 << 31, 1 << 33])
def test_halves_by_count(spark, width):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        supplier = 1 if i % 3 == 0 else rng.randint(2, 40)
        # Supplier 1 has nearly all of its orders on one day.
        day = 5 if supplier == 1 and i % 10 else rng.randint(0, 30)
        status = rng.choice(["On Time", "On Time", "Delayed", "In Transit"])
        rows.append((i, supplier, DAY + dt.timedelta(days=day), status))
    # Copies of one order id, and a supplier with just enough and one with too few orders.
    rows += [(77, 50, DAY, rng.choice(["On Time", "Delayed"])) for _ in range(301)]
    rows += [(i, 51, DAY, "On Time") for i in range(10)] + [(i, 52, DAY, "Delayed") for i in range(9)]
    found = trends.halves_by_count(_orders(spark, rows), 10, bucket_width=width)
    got = {
        r.supplier_id: (r.completed_orders, r.first_on_time, r.second_on_time)
        for r in found.collect()
    }
    assert got == _brute(rows, 10)
    assert 51 in got and 52 not in got


def test_trend_words(spark):
    def history(supplier, first, second):
        return [
            (supplier * 1000 + i, supplier, DAY + dt.timedelta(days=i), s)
            for i, s in enumerate(first + second)
        ]

    on, late = ["On Time"], ["Delayed"]
    rows = history(1, on * 10, on * 5 + late * 5) + history(2, late * 5 + on * 5, on * 10)
    rows += history(3, on * 10, on * 10) + history(4, on * 5, late * 5)
    labels = {r.supplier_id: r for r in trends.supplier_trend_label(_orders(spark, rows)).collect()}
    assert {k: r.direction for k, r in labels.items()} == {
        1: "declined", 2: "improved", 3: "remained stable"
    }
    insights = {r.supplier_id: r for r in trends.supplier_trend(_orders(spark, rows)).collect()}
    assert insights[4].concern and insights[4].direction == "decreased"
    assert insights[2].direction == "increased" and not insights[2].concern
    assert "from 100% to 0%" in insights[4].insight


def test_decline_needs_both_halves(spark):
    rows = [(1, 1, DAY, "On Time"), (2, 1, DAY + dt.timedelta(days=10), "Delayed")]
    rows += [(3, 2, DAY + dt.timedelta(days=5), "Delayed"), (4, 2, DAY + dt.timedelta(days=6), "On Time")]
    rows += [(5, 3, DAY + dt.timedelta(days=9), "Delayed")]
    found = trends.performance_decline(_orders(spark, rows)).collect()
    # Day 5 is the middle and belongs to the first half; supplier 3 has only a second half.
    assert [(r.supplier_id, r.decline) for r in found] == [(1, 1.0), (2, -1.0)]
    names = spark.createDataFrame([(1, "Acme")], "supplier_id bigint, supplier_name string")
    text = trends.decline_text(_orders(spark, rows), names).first().text
    assert text.startswith("Acme (1) shows") and "100.0 percentage points" in text
    nothing = trends.decline_text(_orders(spark, rows[:1]), names).first().text
    assert nothing == trends.NO_DECLINE_TEXT
