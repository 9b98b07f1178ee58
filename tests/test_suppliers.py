"""Scorecards, KPIs, filters, analytic questions and instruction records on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolens.operators import filters, instructions, kpis, questions, scorecard

BASE = (
    "supplier_id string, supplier_name string, category string, location string, "
    "quality_score double, average_delivery_days double, cost_index double, active boolean"
)
ORDERS = (
    "order_id string, supplier_id string, product_id string, order_date date, quantity int, "
    "priority string, actual_delivery date, delivery_delay int, status string"
)
STOCK = (
    "product_id string, product_name string, category string, current_stock int, "
    "reorder_level int, monthly_demand int, unit_cost double"
)
DAY = dt.date(2024, 3, 1)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(
        [
            ("SUP1", "Atlas Group", "Metals", "Oslo", 95.0, 4.0, 90.0, True),
            ("SUP2", "Beacon Trading", "Textiles", "Pune", 60.0, 4.0, 150.0, True),
            ("SUP3", "Crest Group", "Metals", "Oslo", 80.0, 6.5, 100.0, False),
        ],
        BASE,
    )


@pytest.fixture(scope="module")
def orders(spark):
    rows = []
    for i in range(40):
        late = i % 5 == 0
        rows.append((f"A{i:03}", "SUP1", "P1", DAY + dt.timedelta(days=i), 10, "High",
                     DAY + dt.timedelta(days=i + 4), 0, "On Time"))
        rows.append((f"B{i:03}", "SUP2", "P2", DAY + dt.timedelta(days=i), 10, "Standard",
                     DAY + dt.timedelta(days=i + 20), 5 if late else 0,
                     "On Time" if i % 4 else "Delayed"))
    rows.append(("C001", "SUP3", "P1", DAY, 5, "Urgent", None, None, "In Transit"))
    return spark.createDataFrame(rows, ORDERS)


@pytest.fixture(scope="module")
def suppliers(base, orders):
    return scorecard.scorecard(base, orders)


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame(
        [("P1", "bolt", "Metals", 5, 10, 20, 2.0), ("P2", "silk", "Textiles", 50, 10, 20, 3.0),
         ("P3", "wool", "Textiles", 4, 0, 20, 1.0)],
        STOCK,
    )


def test_scorecard(suppliers):
    rows = {r.supplier_id: r for r in suppliers.collect()}
    assert (rows["SUP1"].total_orders, rows["SUP1"].on_time_rate) == (40, 1.0)
    assert rows["SUP1"].average_delivery_days == 4.0 and rows["SUP1"].risk_level == "LOW"
    assert (rows["SUP2"].delayed_orders, rows["SUP2"].on_time_rate) == (10, 0.75)
    # 0.25*45 + 15*2.2 + 25*0.6 + 40*0.15
    assert rows["SUP2"].risk_score == 65.2 and rows["SUP2"].risk_level == "HIGH"
    # No completed order: rate 0, own delivery days kept.
    assert (rows["SUP3"].total_orders, rows["SUP3"].on_time_rate) == (0, 0.0)
    assert rows["SUP3"].average_delivery_days == 6.5


def test_reasons_and_steps(suppliers):
    rows = {
        r.supplier_id: r
        for r in suppliers.select(
            "supplier_id", scorecard.risk_sentences().alias("s"),
            scorecard.risk_phrases().alias("p"),
            scorecard.recommendation(F.col("risk_level")).alias("r"),
        ).collect()
    }
    assert rows["SUP1"].s == [scorecard.NO_RISK_SENTENCE]
    assert rows["SUP1"].p == [scorecard.NO_RISK_PHRASE]
    assert rows["SUP2"].s[0] == "On-time delivery rate is 75.0%, below the 85% target."
    assert len(rows["SUP2"].s) == 4
    assert rows["SUP2"].p[1] == "a longer-than-average delivery time of 20.0 days"
    assert rows["SUP2"].r.startswith("1. Initiate a formal")


def test_kpis(suppliers, orders, stock):
    row = kpis.dashboard_kpis(suppliers, orders, stock).first()
    assert (row.total_suppliers, row.active_suppliers, row.high_risk_suppliers) == (3, 2, 1)
    assert (row.delayed_orders, row.low_stock_products) == (10, 1)
    assert row.on_time_text == "87.5%" and row.inventory_value_text == "$164"
    levels = {r.risk_level: r.suppliers for r in kpis.risk_distribution(suppliers).collect()}
    assert levels == {"LOW": 1, "MEDIUM": 1, "HIGH": 1}
    alerts = [r.alert for r in kpis.recent_alerts(suppliers, stock).orderBy("kind").collect()]
    assert "**Beacon Trading** is HIGH risk (score 65.2)" in alerts[0]
    assert "**bolt** is below reorder level (5 / 10)" in alerts[1]


def test_level_nobody_has_counts_zero(suppliers):
    low = suppliers.filter("risk_level = 'LOW'")
    assert {r.risk_level: r.suppliers for r in kpis.risk_distribution(low).collect()} == {
        "LOW": 1, "MEDIUM": 0, "HIGH": 0
    }


def test_filters(suppliers, orders, stock):
    def ids(**choice):
        return {r.supplier_id for r in filters.supplier_list(suppliers, **choice).collect()}

    assert ids() == {"SUP1", "SUP2", "SUP3"}
    assert ids(categories=["Metals"], risk_levels=["LOW"]) == {"SUP1"}
    assert ids(name_part="gROUP") == {"SUP1", "SUP3"}
    assert ids(name_part=".*") == set()  # taken literally
    listed = filters.order_list(
        orders.withColumn("expected_delivery", F.col("order_date")), suppliers,
        supplier_names=["Atlas Group"],
    )
    assert listed.count() == 40
    status = {r.product_id: r.status for r in filters.inventory_status(stock).collect()}
    assert status == {"P1": "LOW STOCK", "P2": "OK", "P3": "OK"}
    ratio = {r.category: r[1] for r in questions.category_stock_ratio(stock).collect()}
    assert ratio == {"Metals": 0.5, "Textiles": 4.5}


ASKED = {
    1: ("Which supplier had the highest number of delays?", "most_delayed_supplier"),
    2: ("Which product category has the lowest inventory?", "lowest_inventory_category"),
    3: ("Show me suppliers with more than 9 delayed orders.", "suppliers_above_delay_threshold"),
    4: ("Are delayed orders above what we like?", "suppliers_above_delay_threshold"),
    5: ("What was the average delivery time last month?", "average_delivery_time_period"),
    6: ("Which supplier's performance declined the most?", "supplier_performance_decline"),
    7: ("Tell me about Crest Group", "supplier_lookup"),
    8: ("Give me the profile of SUP2", "supplier_lookup"),
    9: ("Tell me about Group", "supplier_lookup"),
    10: ("Tell me about Zebra", "supplier_lookup"),
    11: ("tell me about it", "supplier_lookup"),
    12: ("What's the weather today?", None),
    13: ("Show me suppliers with more than 10 delayed orders.", "suppliers_above_delay_threshold"),
    14: (f"Who has more than 0{10**20} delayed orders?", "suppliers_above_delay_threshold"),
    15: (f"Who has more than {2**63 - 1} delayed orders?", "suppliers_above_delay_threshold"),
}


def test_questions(spark, suppliers, orders, stock):
    asked = spark.createDataFrame(
        [(i, text) for i, (text, _) in ASKED.items()], "qid int, question string"
    )
    rows = {
        r.qid: r for r in questions.answer_questions(asked, suppliers, orders, stock).collect()
    }
    assert {i: r.intent for i, r in rows.items()} == {i: intent for i, (_, intent) in ASKED.items()}
    assert rows[1].text == (
        "Beacon Trading (SUP2) has the highest number of delayed orders: 10 delayed out of 40 "
        "total orders (75.0% on-time rate)."
    )
    assert "'Metals' category" in rows[2].text and "(0.50x)" in rows[2].text
    assert rows[3].text == "Found 1 supplier(s) with more than 9 delayed orders."
    assert rows[4].text == "Found 0 supplier(s) with more than 20 delayed orders."
    assert rows[13].text == "Found 0 supplier(s) with more than 10 delayed orders."
    assert rows[14].text == f"Found 0 supplier(s) with more than {10**20} delayed orders."
    assert rows[15].text == f"Found 0 supplier(s) with more than {2**63 - 1} delayed orders."
    # Days 9 to 39 of the history, both suppliers: 31 orders of 4 and 31 of 20 days.
    assert "was 12.0 days, based on 62 completed orders" in rows[5].text
    assert "performance: its delay rate increased by" in rows[6].text
    assert rows[7].text.startswith("Crest Group (SUP3): on-time rate 0.0%, avg delivery 6.5 days")
    assert rows[8].text.startswith("Beacon Trading (SUP2)")
    assert rows[9].text.startswith("Atlas Group (SUP1)")  # the first of two
    assert rows[10].text == "No supplier found matching 'Zebra'."
    assert rows[11].text == questions.NO_NAME_TEXT
    assert rows[12].text == questions.UNROUTED_TEXT


def test_counts_above_many_thresholds(spark):
    values = [0, 0, 5, 1023, 1024, 1024, 1025, 4096, 70_000]
    asked = [-1, 0, 4, 5, 1022, 1023, 1024, 1024, 4095, 4096, 69_999, 70_000, 10**9, None]
    found = questions.counts_above(
        spark.createDataFrame([(v,) for v in asked], "threshold bigint"),
        spark.createDataFrame([(v,) for v in values], "delayed_orders bigint"),
    )
    assert {r.threshold: r.above for r in found.collect()} == {
        t: sum(v > t for v in values) for t in asked if t is not None
    }


def test_counts_above_millions_of_thresholds(spark):
    thresholds = spark.range(2_000_000).select(F.col("id").alias("threshold"))
    suppliers = spark.range(1000).select((F.col("id") * 2000).alias("delayed_orders"))
    found = questions.counts_above(thresholds, suppliers, range_rows=100_000)
    wrong = F.col("above") != 999 - F.floor(F.col("threshold") / 2000)
    assert found.agg(F.count("*"), F.count_if(wrong)).first() == (2_000_000, 0)


def test_search_of_short_and_missing_names(spark, suppliers):
    unnamed = suppliers.withColumn(
        "supplier_name", F.when(F.col("supplier_id") != "SUP3", F.col("supplier_name"))
    )
    asked = ["g", "gr", "GROUP", "sup", "p2", "p3", "qqq", "s g", "atlas group", "Beacon Trading",
             "Beacon Trading Inc", "beacon trbding"]
    names = spark.createDataFrame([(name,) for name in asked], "name string")
    for table in (suppliers, unnamed):
        rows = table.select("supplier_id", "supplier_name").collect()
        wanted = {}
        for name in asked:
            ids = [
                r.supplier_id for r in rows
                if name.lower() in (r.supplier_name or "").lower()
                or name.lower() in r.supplier_id.lower()
            ]
            wanted[name] = (min(ids, default=None), len(ids))
        found = questions.supplier_search(names, table).collect()
        assert {r.name: (r.first_match, r.matches) for r in found} == wanted


def test_records(suppliers, orders):
    records = instructions.train_split(instructions.all_records(suppliers, orders))
    rows = records.collect()
    assert len(rows) == 3 * 3 + 2  # two suppliers have a trend
    assert sum(r.split == "train" for r in rows) == 9
    by_key = {(r.family, r.supplier_id): r for r in rows}
    assert by_key["summary", "SUP2"].input == (
        "Supplier: Beacon Trading (SUP2)\nOn-time delivery: 75%\n"
        "Average delivery time: 20.0 days\nQuality score: 60.0\n"
        "Total orders: 40, Delayed orders: 10\nRisk level: HIGH"
    )
    assert by_key["risk", "SUP1"].output == (
        "Atlas Group is classified as LOW risk primarily due to consistently strong delivery and "
        "quality performance. These factors indicate a reliable, low-risk supplier relationship."
    )
    assert by_key["trend", "SUP1"].output.startswith(
        "Atlas Group's on-time delivery rate remained stable from 100% to 100% (+0.0 percentage"
    )
    chat = instructions.chat_records(records).first().messages
    assert [m.role for m in chat] == ["system", "user", "assistant"]
    assert chat[1].content.count("\n\n") >= 1
