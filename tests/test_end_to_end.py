"""All operators on one small company read from CSV files with text keys."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cargolens.operators import (
    anomalies, delay_model, filters, instructions, isolation_forest, kpis, questions, scorecard,
    trends,
)
from cargolens.sources import artifacts, catalog

SUPPLIERS, PRODUCTS, ORDERS = 25, 12, 3000


@pytest.fixture(scope="module")
def company(spark, tmp_path_factory):
    rng = random.Random(9)
    root = str(tmp_path_factory.mktemp("company"))
    lateness = {s: 0.5 if s % 8 == 0 else 0.08 for s in range(SUPPLIERS)}
    suppliers = [
        (f"SUP{s:04}", rng.choice(["Atlas Group", "Beacon Trading", "Crest, Ltd"]),
         rng.choice(["Metals", "Paper"]), "Oslo, NO", round(rng.uniform(60, 99), 1), 5.0, 0.9,
         round(rng.uniform(80, 130), 1), True, 0.0, "LOW", 0, 0)
        for s in range(SUPPLIERS)
    ]
    stock = [
        (f"PRD{p:03}", f"ITEM-{p}", rng.choice(["Metals", "Paper", "Wood"]), rng.randint(0, 50), 20,
         100, 9.5)
        for p in range(PRODUCTS)
    ]
    orders = []
    for i in range(ORDERS):
        s = rng.randrange(SUPPLIERS)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(540))
        spike = s == 3 and day.strftime("%Y-%m") == "2024-06"
        late = rng.random() < (0.95 if spike else lateness[s])
        delay = (rng.randint(15, 25) if spike else rng.randint(1, 5)) if late else 0
        due = day + dt.timedelta(days=5)
        open_order = day > dt.date(2025, 6, 15)
        orders.append(
            (f"ORD{i:06}", f"SUP{s:04}", f"PRD{rng.randrange(PRODUCTS):03}", str(day),
             5000 if i == 77 else rng.randint(10, 500),
             rng.choice(["Standard", "High", "Urgent"]), str(due),
             None if open_order else str(due + dt.timedelta(days=delay)),
             None if open_order else str(delay),
             "In Transit" if open_order else "Delayed" if late else "On Time")
        )
    for name, rows in [("suppliers", suppliers), ("orders", orders), ("inventory", stock)]:
        catalog.write_table(spark.createDataFrame(rows, catalog.SCHEMAS[name]), root, name)
    return {**catalog.load_bundle(spark, root), "raw": orders, "root": root}


@pytest.fixture(scope="module")
def suppliers(company):
    return scorecard.scorecard(company["suppliers"], company["orders"])


def test_scorecard_of_text_keys(company, suppliers):
    found = {r.supplier_id: r for r in suppliers.collect()}
    assert len(found) == SUPPLIERS
    for code, row in found.items():
        done = [o for o in company["raw"] if o[1] == code and o[9] != "In Transit"]
        late = [o for o in done if o[9] == "Delayed"]
        days = [(dt.date.fromisoformat(o[7]) - dt.date.fromisoformat(o[3])).days for o in done]
        assert (row.total_orders, row.delayed_orders) == (len(done), len(late))
        assert row.on_time_rate == round(1 - len(late) / len(done), 3)
        assert row.average_delivery_days == pytest.approx(sum(days) / len(days), abs=0.0501)


def test_halves_of_text_keys(company):
    found = {r.supplier_id: r for r in trends.halves_by_count(company["orders"], 10).collect()}
    for code, row in found.items():
        done = [o for o in company["raw"] if o[1] == code and o[9] != "In Transit"]
        on_time = sum(o[9] == "On Time" for o in done)
        assert row.first_orders == len(done) // 2
        assert row.first_on_time + row.second_on_time == on_time


def test_anomalies(company, suppliers):
    orders = company["orders"]
    spikes = anomalies.delay_spikes(orders, suppliers)
    top = anomalies.spike_headlines(spikes, 1).first()
    assert (top.supplier_id, top.month) == ("SUP0003", "2024-06")
    odd = anomalies.quantity_outliers(orders).collect()
    assert [(r.order_id, r.quantity) for r in odd] == [("ORD000077", 5000)]
    flags = isolation_forest.isolation_forest(orders, suppliers, trees=40)
    both = anomalies.agreement(spikes, flags).filter("found_by = 'both'")
    assert ("SUP0003", "2024-06") in {(r.supplier_id, r.month) for r in both.collect()}
    sections = anomalies.report_sections(
        spikes, anomalies.quantity_outliers(orders), flags, company["inventory"]
    )
    artifacts.write_report(sections, company["root"] + "/report")
    low = artifacts.read_report(orders.sparkSession, company["root"] + "/report", "low_stock_products")
    assert low.count() == filters.low_stock(company["inventory"]).count()


def test_model(company, suppliers):
    features = delay_model.delay_features(company["orders"], suppliers, company["inventory"])
    trained = delay_model.train(features, trees=20)
    predictions = delay_model.score(trained.model, trained.test)
    metrics = delay_model.delay_metrics(predictions, F.lit(trained.n_train)).first()
    assert metrics.recall > 0.3 and metrics.n_train > 0
    waiting = company["orders"].filter("status = 'In Transit'")
    scored = delay_model.score_new_orders(
        trained.model, trained.medians, waiting, suppliers, company["inventory"]
    )
    assert scored.count() == waiting.count() > 0
    assert {r.prediction for r in scored.collect()} <= {"Delayed", "On Time"}


def test_dashboard_and_records(company, suppliers):
    row = kpis.dashboard_kpis(suppliers, company["orders"], company["inventory"]).first()
    assert row.total_suppliers == SUPPLIERS
    assert row.delayed_orders == sum(o[9] == "Delayed" for o in company["raw"])
    records = instructions.train_split(instructions.all_records(suppliers, company["orders"]))
    sizes = {r.split: r["count"] for r in records.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 4 * SUPPLIERS and sizes["train"] == int(4 * SUPPLIERS * 0.9)
    asked = suppliers.sparkSession.createDataFrame(
        [(1, "Tell me about SUP0003"), (2, "Any decline lately?")], "qid int, question string"
    )
    texts = {
        r.qid: r.text
        for r in questions.answer_questions(
            asked, suppliers, company["orders"], company["inventory"]
        ).collect()
    }
    assert "(SUP0003): on-time rate" in texts[1] and "largest decline" in texts[2]
