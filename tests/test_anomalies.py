from __future__ import annotations

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cargolens.operators import anomalies, isolation_forest

SCHEMA = "order_id bigint, supplier_id bigint, order_date date, status string, delivery_delay int"
NAMES = "supplier_id bigint, supplier_name string"


def _history(rng):
    rows, number = [], 0
    for supplier in range(1, 13):
        for month in range(1, 2 + supplier):
            for _ in range(rng.randint(1, 8)):
                late = rng.random() < (0.9 if month == 3 and supplier % 2 else 0.2)
                status = "Delayed" if late else rng.choice(["On Time", "On Time", "In Transit"])
                delay = rng.randint(1, 12) if late else (0 if status == "On Time" else None)
                rows.append((number, supplier, dt.date(2024 + month // 13, month % 12 + 1, 1), status, delay))
                number += 1
    return rows


def _literal_spikes(rows):
    cells = defaultdict(list)
    for _, supplier, date, status, delay in rows:
        if status != "In Transit":
            cells[supplier, f"{date:%Y-%m}"].append(delay or 0)
    found = set()
    for (supplier, month), delays in cells.items():
        months = [m for s, m in cells if s == supplier]
        others = [
            statistics.fmean(cells[supplier, m])
            for m in months if m != month and len(cells[supplier, m]) >= 3
        ]
        if len(months) < 4 or len(delays) < 3 or len(others) < 3:
            continue
        current, mu = statistics.fmean(delays), statistics.fmean(others)
        z = (current - mu) / max(statistics.stdev(others), 0.5)
        if current >= 2 and z >= 2 and current > mu:
            found.add((supplier, month, round(z, 2)))
    return found


def test_spikes_match_the_literal_definition(spark):
    rows = _history(random.Random(11))
    names = spark.createDataFrame([(i, f"Name {i}") for i in range(1, 12)], NAMES)
    found = anomalies.delay_spikes(spark.createDataFrame(rows, SCHEMA), names).collect()
    assert {(r.supplier_id, r.month, r.z_score) for r in found} == _literal_spikes(rows)
    assert found
    assert all(r.supplier_name == (f"Name {r.supplier_id}" if r.supplier_id < 12 else "12") for r in found)


def test_mean_path():
    assert isolation_forest.mean_path(1) == 0.0
    assert isolation_forest.mean_path(2) == 1.0
    assert isolation_forest.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def _grown(spark, trees, sample):
    rows = [(t, *p) for t, points in trees.items() for p in points]
    frame = spark.createDataFrame(rows, "tree int, x0 double, x1 double, x2 double")
    nodes: dict = {}
    for r in isolation_forest.grow_forest(frame, sample).collect():
        nodes.setdefault(r.tree, {})[r.node] = r
    return nodes


def test_tree_separates_points(spark):
    points = [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (10.0, 5.0, 5.0)]
    nodes = _grown(spark, {0: points, 1: points[:1], 2: points[:2]}, 3)
    root = nodes[0][1]
    assert set(nodes[0]) == {1, 2, 3} and root.feature >= 0 and 0 <= root.split < 10
    assert (nodes[0][2].units, nodes[0][3].units) == (2_000_000, 1_000_000)  # two rows and one
    assert [(n.feature, n.units) for n in nodes[1].values()] == [(-1, 0)]
    assert [(n.feature, n.units) for n in nodes[2].values()] == [(-1, 1_000_000)]


def test_levels_part_every_row_once(spark):
    rng = random.Random(8)
    trees = {t: [tuple(float(rng.randrange(6)) for _ in range(3)) for _ in range(40)] for t in range(5)}
    for t, nodes in _grown(spark, trees, 40).items():
        parts: dict = {1: trees[t]}
        for number in sorted(nodes):
            node, rows = nodes[number], parts.pop(number)
            depth = number.bit_length() - 1
            if node.feature < 0:
                assert len(set(rows)) == 1 or depth == 6
                assert node.units == round((depth + isolation_forest.mean_path(len(rows))) * 1e6)
                continue
            left = [r for r in rows if r[node.feature] <= node.split]
            right = [r for r in rows if r[node.feature] > node.split]
            assert left and right
            parts |= {2 * number: left, 2 * number + 1: right}
        assert not parts


def test_samples_follow_the_starts_of_their_trees(spark):
    rng = random.Random(9)
    rows = [(k, float(k), 0, 1, rng.choice([7, rng.randrange(1 << 32)])) for k in range(3000)]
    frame = spark.createDataFrame(rows, "id int, avg_delay double, delayed_count int, order_count int, u bigint")
    drawn = isolation_forest.draw_samples(frame, F.col("u"), 3000, ["id"], 12, 50, 42).collect()
    for tree in range(12):
        start = isolation_forest.tree_start(tree, 42)
        nearest = sorted(rows, key=lambda r: ((r[4] - start) % (1 << 32), r[0]))[:50]
        assert {r.x0 for r in drawn if r.tree == tree} == {r[1] for r in nearest}


def _months(spark, n, odd):
    rows = []
    rng = random.Random(5)
    for s in range(n):
        strange = s in odd
        for i in range(40 if strange else 5):
            late = strange or rng.random() < 0.1
            rows.append((s * 100 + i, s, dt.date(2024, 1, 2), "Delayed" if late else "On Time", 30 if strange else int(late)))
    return spark.createDataFrame(rows, SCHEMA)


def test_forest_finds_the_odd_ones_and_repeats(spark):
    orders = _months(spark, 400, {17, 300})
    names = spark.createDataFrame([(i, f"Name {i}") for i in range(400)], NAMES)
    first = isolation_forest.isolation_forest(orders, names, trees=50).collect()
    again = isolation_forest.isolation_forest(orders.repartition(5), names, trees=50).collect()
    assert sorted(first) == sorted(again)
    assert len(first) <= 20 and all(r.isolation_forest_score <= 0 for r in first)
    strangest = sorted(first, key=lambda r: r.isolation_forest_score)[:2]
    assert {r.supplier_id for r in strangest} == {17, 300}


def test_forest_needs_ten_rows(spark):
    names = spark.createDataFrame([(0, "x")], NAMES)
    assert isolation_forest.isolation_forest(_months(spark, 9, set()), names).count() == 0


def test_agreement(spark):
    left = spark.createDataFrame([(1, "2024-01", 3.0), (2, "2024-01", 2.5)], "supplier_id int, month string, z_score double")
    right = spark.createDataFrame([(1, "2024-01", -0.1), (3, "2024-02", -0.2)], "supplier_id int, month string, isolation_forest_score double")
    found = anomalies.agreement(left, right).collect()
    assert {(r.supplier_id, r.found_by) for r in found} == {(1, "both"), (2, "z_score"), (3, "isolation_forest")}
