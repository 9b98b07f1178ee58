"""The delay model and everything that is written and read back."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cargolens.operators import anomalies, answers, delay_model, instructions, search, tfidf
from cargolens.sources import artifacts, catalog, documents
from cargolens.sources.star_schema import read_table

FEATURES = (
    "order_id bigint, supplier_id bigint, product_id bigint, on_time_rate double, "
    "average_delivery_days double, quality_score double, risk_score double, quantity int, "
    "order_month int, category string, priority string, is_delayed int"
)


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(4)
    rows = []
    for i in range(800):
        rate = rng.random()
        late = int(rng.random() > rate)
        rows.append((i, i % 20, i % 50, rate if i % 40 else None, rng.uniform(2, 12), rng.uniform(50, 99),
                     rng.uniform(0, 70), rng.randint(1, 500), rng.randint(1, 12),
                     rng.choice(["Metals", "Textiles", "Paper"]), rng.choice(["High", "Urgent"]), late))
    return spark.createDataFrame(rows, FEATURES)


@pytest.fixture(scope="module")
def trained(features):
    return delay_model.train(features, trees=15)


def test_split_and_medians(features, trained):
    split = delay_model.stratified_split(features).collect()
    for label in (0, 1):
        part = [r.split for r in split if r.is_delayed == label]
        assert part.count("train") == int(len(part) * 0.8 + 1e-9)
    rates = sorted(r.on_time_rate for r in features.collect() if r.on_time_rate is not None)
    assert trained.medians["on_time_rate"] == pytest.approx((rates[389] + rates[390]) / 2)
    filled = delay_model.impute(features, trained.medians)
    assert filled.filter("on_time_rate IS NULL").count() == 0


def test_model_learns_and_reports(trained):
    predictions = delay_model.score(trained.model, trained.test)
    metrics = delay_model.delay_metrics(predictions, F.lit(trained.n_train)).first()
    assert metrics.accuracy > 0.6
    assert metrics.n_train + metrics.n_test == 800
    cells = {(r.actual, r.predicted): r.orders for r in delay_model.confusion_matrix(predictions).collect()}
    assert sum(cells.values()) == metrics.n_test and len(cells) == 4
    names = delay_model.feature_names(trained.model)
    assert names[6:] == ["category_Metals", "category_Paper", "category_Textiles", "priority_High", "priority_Urgent"]
    importance = delay_model.feature_importance(trained.model, predictions).collect()
    assert importance[0].feature == "on_time_rate"
    assert sum(r.importance for r in importance) == pytest.approx(1.0, abs=0.01)


def test_same_model_however_rows_are_dealt(features, monkeypatch):
    monkeypatch.setattr(delay_model, "ROWS_PER_PART", 100)

    def scores(parts):
        found = delay_model.train(features.repartition(parts), trees=10, fit_rows=400)
        rows = delay_model.score(found.model, found.test).select("order_id", "probability_delayed")
        return found.n_train, sorted(rows.collect())

    first = scores(2)
    assert first == scores(11) and first[0] + len(first[1]) == 800


def test_report_arithmetic(spark):
    """Counts and averages of a published evaluation."""
    cells = {(0, 0): 525, (0, 1): 147, (1, 0): 58, (1, 1): 60}
    rows = [cell for cell, n in cells.items() for _ in range(n)]
    frame = spark.createDataFrame(rows, "is_delayed int, prediction int")
    metrics = delay_model.delay_metrics(frame, F.lit(3160)).first()
    assert (metrics.accuracy, metrics.precision, metrics.recall) == (0.7405, 0.2899, 0.5085)
    assert (metrics.f1_score, metrics.positive_rate_test) == (0.3692, 0.1494)
    report = {r["row"]: r for r in delay_model.classification_report(frame).collect()}
    assert report["macro avg"].f1_score == pytest.approx(0.6029, abs=1e-4)
    assert report["weighted avg"].f1_score == pytest.approx(0.7668, abs=1e-4)
    assert report["0"].support == 672
    nothing = delay_model.delay_metrics(frame.filter("is_delayed = 0 AND prediction = 0"), F.lit(0)).first()
    assert (nothing.precision, nothing.recall, nothing.f1_score) == (0.0, 0.0, 0.0)


def test_unknown_words_and_saved_model(spark, tmp_path, features, trained):
    metrics = delay_model.delay_metrics(delay_model.score(trained.model, trained.test), F.lit(1))
    artifacts.write_model(trained, metrics, str(tmp_path))
    model, medians = artifacts.read_model(spark, str(tmp_path))
    assert medians == trained.medians
    odd = delay_model.impute(features.withColumn("category", F.lit("Unseen")), medians)
    left = delay_model.score(model, odd).select("order_id", "probability_delayed").collect()
    right = delay_model.score(trained.model, odd).select("order_id", "probability_delayed").collect()
    assert sorted(left) == sorted(right)
    assert artifacts.read_metrics(spark, str(tmp_path)).first().accuracy == metrics.first().accuracy


def test_rates_from_training_orders_only(spark):
    orders = spark.createDataFrame(
        [(i, i % 4, i % 3, dt.date(2024, 1, 1 + i % 28), 5, "High", "Delayed" if i % 3 else "On Time",
          dt.date(2024, 3, 1)) for i in range(200)],
        "order_id bigint, supplier_id bigint, product_id bigint, order_date date, quantity int, "
        "priority string, status string, actual_delivery date",
    )
    base = spark.createDataFrame(
        [(i, "n", "c", "l", 90.0, 5.0, 100.0, True) for i in range(4)],
        "supplier_id bigint, supplier_name string, category string, location string, "
        "quality_score double, average_delivery_days double, cost_index double, active boolean",
    )
    stock = spark.createDataFrame([(i, "c") for i in range(3)], "product_id bigint, category string")
    rows = delay_model.train_only_features(orders, base, stock).collect()
    assert len(rows) == 200
    for supplier in range(4):
        train = [r.is_delayed for r in rows if r.supplier_id == supplier and r.split == "train"]
        rate = {r.on_time_rate for r in rows if r.supplier_id == supplier}
        assert rate == {round(1 - sum(train) / len(train), 3)}


def test_table_files(spark, tmp_path):
    root = str(tmp_path)
    stock = spark.createDataFrame(
        [("P1", ' bolt, 2"\nlong', "Metals", 5, 10, 20, 2.5)], catalog.INVENTORY
    )
    orders = spark.createDataFrame(
        [("O1", "S1", "P1", "2024-01-05", 3, "High", "2024-01-09", "2024-01-10", "1", "Delayed"),
         ("O2", "S1", "P1", "2024-01-06", 3, "High", "2024-01-09", None, None, "In Transit"),
         ("O3", "S1", "P1", "2024-01-06", 3, "High", "2024-01-09", "soon", "x", "On Time")],
        catalog.ORDERS,
    )
    for fmt in ("csv", "parquet"):
        catalog.write_table(stock, root, "inventory", fmt)
        catalog.write_table(orders, root, "orders", fmt)
        assert catalog.load_table(spark, root, "inventory", fmt).collect() == stock.collect()
        rows = {r.order_id: r for r in catalog.load_table(spark, root, "orders", fmt).collect()}
        assert rows["O1"].actual_delivery == dt.date(2024, 1, 10) and rows["O1"].delivery_delay == 1
        assert rows["O2"].actual_delivery is None and rows["O2"].delivery_delay is None
        assert rows["O3"].actual_delivery is None and rows["O3"].delivery_delay is None
    with pytest.raises(ValueError):
        catalog.load_table(spark, root, "../secrets")
    with pytest.raises(FileNotFoundError):
        catalog.load_table(spark, root, "suppliers")
    with pytest.raises(ValueError):
        read_table(spark, root, "passwd")


def test_documents_and_questions(spark, tmp_path):
    (tmp_path / "late_policy.md").write_text("# Late\n\n## One\nbody é\n")
    (tmp_path / "notes.txt").write_text("ignored")
    (tmp_path / "asked.json").write_text(
        '[{"question": "Why?", "expected_doc": "Late Policy", "answerable": true},'
        ' {"question": "plumless", "expected_doc": null, "answerable": false},'
        ' {"question": "buckeroo", "expected_doc": null, "answerable": false}]'
    )
    found = documents.load_documents(spark, str(tmp_path)).collect()
    assert [(r.doc, r.text) for r in found] == [("Late Policy", "# Late\n\n## One\nbody é\n")]
    asked = documents.load_questions(spark, str(tmp_path / "asked.json")).collect()
    assert {(r.question, r.expected_doc, r.answerable) for r in asked} == {
        ("Why?", "Late Policy", True), ("plumless", None, False), ("buckeroo", None, False)
    }
    assert len({r.qid for r in asked}) == 3  # two of them share a 32-bit checksum


def test_report_and_records(spark, tmp_path):
    section = spark.createDataFrame(
        [(k, f"n{k}", 50 - k) for k in range(50)], "id bigint, name string, position bigint"
    ).repartition(5)
    artifacts.write_report({"first": section, "second": section}, str(tmp_path / "report"))
    read = artifacts.read_report(spark, str(tmp_path / "report"), "second").collect()
    assert [r.name for r in read] == [f"n{49 - k}" for k in range(50)]
    lines = anomalies.report_lines({"first": section, "second": section.limit(0)}).collect()
    assert {(r.section, r.position, r.record) for r in lines} == {
        ("first", 50 - k, f'{{"id":{k},"name":"n{k}"}}') for k in range(50)
    }
    records = instructions.train_split(
        spark.createDataFrame(
            [("summary", i, "do", f"in\n{i}", "out") for i in range(10)],
            "family string, supplier_id bigint, instruction string, input string, output string",
        )
    )
    artifacts.write_records(records, str(tmp_path / "records"))
    sizes = {p: artifacts.read_records(spark, str(tmp_path / "records"), p).count()
             for p in ("all", "train", "validation")}
    assert sizes == {"all": 10, "train": 9, "validation": 1}


def test_evaluation_with_detail(spark, tmp_path):
    asked = spark.createDataFrame(
        [(2, "late?", "A", True), (1, "stock?", "B", True), (3, "zebra?", None, False)],
        "qid bigint, question string, expected_doc string, answerable boolean",
    )
    hits = spark.createDataFrame(
        [(1, 1, "A", "s", "stock text", 0.5), (2, 1, "A", "s", "late text", 0.4)],
        "qid bigint, rank int, doc string, section string, text string, score double",
    )
    artifacts.write_evaluation(*answers.evaluate(asked, hits), str(tmp_path))
    summary, detail = artifacts.read_evaluation(spark, str(tmp_path))
    row = summary.first()
    assert (row.retrieval_recall_at_k, row.correct_refusal_rate, row.top_k) == (0.5, 1.0, 3)
    assert [(r.question, r.expected_doc, r.retrieved_docs, r.hit) for r in detail.collect()] == [
        ("stock?", "B", ["A"], False), ("late?", "A", ["A"], True),
    ]


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    passages = spark.createDataFrame(
        [(1, "A", "s", "late delivery penalty"), (2, "B", "s", "safety stock level"),
         (3, "C", "s", "delivery of stock")],
        "passage bigint, doc string, section string, text string",
    )
    asked = spark.createDataFrame([(7, "penalty for late delivery")], "question bigint, text string")
    vocabulary = tfidf.fit_vocabulary(passages, "passage")
    vectors = tfidf.vectors(passages, "passage", vocabulary)
    artifacts.write_index(passages, vectors, vocabulary, str(tmp_path))

    def hits(chunks, vecs, vocab):
        found = search.top_matches(
            tfidf.vectors(asked, "question", vocab), vecs
        )
        return sorted(answers.cite(found, chunks).collect())

    fresh = hits(passages, vectors, vocabulary)
    assert [r.doc for r in fresh][0] == "A"
    assert hits(*artifacts.read_index(spark, str(tmp_path))) == fresh


def test_batches_walk_the_trees_as_spark_does(trained):
    """Whole batches go down each tree, with the probabilities of Spark's row-by-row model."""
    rows = delay_model.score(trained.model, trained.test)
    assert "ArrowEvalPython" in rows._jdf.queryExecution().optimizedPlan().toString()
    found = {r.order_id: r.probability_delayed for r in rows.collect()}
    share = vector_to_array("probability")[1].alias("share")
    asked = trained.model.transform(trained.test).select("order_id", share).collect()
    assert found == {r.order_id: pytest.approx(r.share, abs=5.1e-4) for r in asked}
    assert len(set(found.values())) > 5
