"""The delay model's forest takes its cuts, counts and trees from every training row."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import delay_forest, delay_model

ROWS = 70_000  # more than trees once grew on


@pytest.fixture(scope="module")
def many(spark):
    """Orders of which three are of the only quantity, 900, that is always delayed."""
    i = F.col("id")
    rare = i.isin(7, 30_011, 65_003)
    return spark.range(ROWS).select(
        i.alias("order_id"), (i % 20).alias("supplier_id"), (i % 50).alias("product_id"),
        ((i % 20) / 20).alias("on_time_rate"), F.lit(4.0).alias("average_delivery_days"),
        F.lit(80.0).alias("quality_score"), (i % 7).cast("double").alias("risk_score"),
        F.when(rare, 900).otherwise(5).alias("quantity"),
        (i % 12 + 1).cast("int").alias("order_month"), F.lit("Paper").alias("category"),
        F.lit("High").alias("priority"),
        (rare | (i % 20 < 6)).cast("int").alias("is_delayed"),
    )


@pytest.fixture(scope="module")
def trained(many):
    return delay_model.train(many, trees=3)


@pytest.fixture(scope="module")
def whole(many, trained):
    """The model of all training rows, asked for without ``train``."""
    rows = delay_model.impute(delay_model.stratified_split(many), trained.medians)
    return delay_model.fit(rows.filter("split = 'train'"), trees=3)


def test_trees_grow_on_all_training_rows(spark, trained, tmp_path):
    """a root counts as many rows as there are to train on, but for the draw of copies."""
    trained.model.stages[-1].save(f"file://{tmp_path}/model")
    nodes = spark.read.parquet(f"file://{tmp_path}/model/data").select("treeID", "nodeData.*")
    roots = nodes.filter("id = 0").collect()
    assert trained.n_train > 50_000 and len(roots) == 3
    for root in roots:
        assert abs(root.rawCount - trained.n_train) < 6 * math.sqrt(trained.n_train)


def test_rare_values_of_all_rows_are_cut_off(many, spark):
    """three rows of 70,000 have the value 900; a sample of 10,000 rows often lacks it."""
    cuts = dict(zip(delay_model.NUMERIC, delay_forest.cut_points(many, delay_model.NUMERIC)))
    assert list(cuts["quantity"]) == [452.5]
    assert list(cuts["order_month"]) == [k + 0.5 for k in range(1, 12)]
    assert list(cuts["quality_score"]) == []


def test_cuts_are_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=5_000), 3)
    heavy = np.where(rng.random(5_000) < 0.7, 0.0, values)
    frame = spark.createDataFrame(list(zip(values.tolist(), heavy.tolist())), "a double, b double")
    a, b = delay_forest.cut_points(frame.repartition(7), ["a", "b"])
    shares = [(values <= cut).mean() for cut in a]
    assert shares == pytest.approx([k / 32 for k in range(1, 32)], abs=2e-3)
    assert len(b) > 15  # a value of seven tenths of the rows leaves cuts for the others
    assert not set(a) & set(values) or all(np.diff(a) > 0)
    again = delay_forest.cut_points(frame.repartition(3), ["a", "b"])
    assert [list(x) for x in again] == [list(a), list(b)]
    with pytest.raises(ValueError):
        delay_forest.cut_points(frame.withColumn("a", F.lit(None).cast("double")), ["a"])


def test_best_cut_equals_brute_force():
    rng = np.random.default_rng(5)
    counts = np.zeros((6, 3, delay_forest.CELLS, 2), int)
    sizes = np.array([31, 7, 1]) * np.ones((6, 1), int)
    rows = [(cell, int(rng.random() < 0.2 + 0.02 * cell[0])) for cell in
            (tuple(rng.integers(0, n + 1) for n in (31, 7, 1)) for _ in range(600))]
    for k, (cell, label) in enumerate(rows):
        for j in range(3):
            counts[k % 6, j, cell[j], label] += 1
    weights = np.array([0.7, 1.9])

    def gini(part):
        weighted = np.array([sum(1 for _, y in part if y == c) for c in (0, 1)]) * weights
        return weighted.sum(), 1 - (weighted ** 2).sum() / weighted.sum() ** 2

    gain, tried, cut, left, right = delay_forest.best_cuts(counts, sizes, weights, 5)
    for slot in range(6):
        part = rows[slot::6]
        n, impurity = gini(part)
        best = 0.0
        for j, most in enumerate((31, 7, 1)):
            for c in range(most):
                low, high = ([r for r in part if (r[0][j] <= c) == side] for side in (True, False))
                if min(len(low), len(high)) >= 5:
                    (nl, gl), (nr, gr) = gini(low), gini(high)
                    best = max(best, impurity - nl / n * gl - nr / n * gr)
        assert gain[slot] == pytest.approx(best)
        below = [y for cell, y in part if cell[tried[slot]] <= cut[slot]]
        assert list(left[slot]) == [below.count(0), below.count(1)]
        assert left[slot].sum() + right[slot].sum() == len(part)


def test_blocks_hold_every_row_once(many):
    cuts = delay_forest.cut_points(many, delay_model.NUMERIC)
    rows = many.withColumns({"a": F.lit(1.0), "b": F.lit(0.0)})

    def packed(parts):
        blocks = delay_forest.pack(
            rows.repartition(parts), cuts, delay_model.NUMERIC, ["a", "b"], "is_delayed", ROWS, 9_000
        )
        return sorted((r.part, r.block, bytes(r.numbers), bytes(r.words)) for r in blocks.collect())

    first = packed(2)
    assert first == packed(9)
    assert sum(len(numbers) for *_, numbers, _ in first) == 8 * ROWS
    late = sum(np.frombuffer(numbers, np.uint8).reshape(-1, 8)[:, 7].sum() for *_, numbers, _ in first)
    assert late == many.agg(F.sum("is_delayed")).first()[0]


def test_turns_and_slices_change_no_tree(many, monkeypatch):
    """Trees counted in several turns, and rows expanded in slices, are the same."""
    few = many.filter("order_id < 3000")

    def importances():
        return list(delay_model.fit(few, trees=4).stages[-1].featureImportances.toArray())

    first = importances()
    monkeypatch.setattr(delay_forest, "COUNT_BYTES", 1)
    monkeypatch.setattr(delay_forest, "VALUE_BYTES", 8_000)
    assert importances() == first


def test_importance_is_of_all_rows(many, trained, whole):
    """the importances are those of the model of all training rows."""
    found, asked = (
        {r.feature: r.importance for r in delay_model.feature_importance(model, many).collect()}
        for model in (trained.model, whole)
    )
    assert found == asked and sum(found.values()) == pytest.approx(1.0, abs=0.01)
    assert found["on_time_rate"] > 0.5 and found["average_delivery_days"] == 0


def test_new_orders_are_scored_by_all_rows(many, spark, trained, whole):
    """new orders get the probabilities of the model of all training rows."""
    suppliers = many.select("supplier_id", "on_time_rate", "average_delivery_days",
                            "quality_score", "risk_score").dropDuplicates(["supplier_id"])
    stock = many.select("product_id", "category").distinct()
    orders = many.filter("order_id < 200").select(
        "order_id", "supplier_id", "product_id", "quantity", "priority",
        F.lit("2024-06-01").cast("date").alias("order_date"),
    )
    found, asked = (
        sorted(delay_model.score_new_orders(model, trained.medians, orders, suppliers, stock).collect())
        for model in (trained.model, whole)
    )
    assert found == asked and len(found) == 200
    assert {r.prediction for r in found} == {"Delayed", "On Time"}
