"""Exact quantiles: every group size, ties, nulls and the bracketed search of large groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import order_statistics
from cargolens.operators.anomalies import upper_outliers
from cargolens.operators.filters import fits_broadcast, lookup
from cargolens.operators.order_statistics import (
    column_medians, pair_cuts, quantiles, rank_cut, up_to,
)
from cargolens.operators.ordering import running_total, with_position
from cargolens.session import materialize

LARGE = {"accuracy": 300, "small_group": 40}  # brackets come into play from 41 rows


def _rows(spark, groups):
    rows = [(i, g, float(v) if v is not None else None)
            for i, (g, v) in enumerate((g, v) for g, values in groups.items() for v in values)]
    return spark.createDataFrame(rows, "id bigint, g string, v double")


@pytest.mark.parametrize("limits", [{}, LARGE])
def test_quantiles_are_exact(spark, limits):
    rng = np.random.default_rng(3)
    groups = {
        "hot": list(rng.normal(size=6000)),
        "ties": [1.0] * 2500 + [2.0] * 2500 + [9.0],
        "steep": list(np.exp(rng.normal(size=3000) * 8)),
        "one": [4.0],
        "two": [1.0, 2.0],
        "few": list(rng.integers(0, 5, 41)),
    }
    found = quantiles(
        _rows(spark, groups).repartition(7), ["g"], "v", {"a": 0.25, "b": 0.75}, ["id"], **limits
    )
    for row in found.collect():
        assert row.n == len(groups[row.g])
        assert row.a == pytest.approx(np.quantile(groups[row.g], 0.25), rel=1e-12)
        assert row.b == pytest.approx(np.quantile(groups[row.g], 0.75), rel=1e-12)
    assert found.count() == len(groups)


@pytest.mark.parametrize("limits", [{}, LARGE])
def test_global_quantile_and_nulls(spark, limits):
    values = list(range(500)) + [None] * 20
    found = quantiles(_rows(spark, {"x": values}), [], "v", {"m": 0.5}, ["id"], **limits).first()
    assert (found.rows, found.n, found.m) == (520, 500, 249.5)


@pytest.mark.parametrize("limits", [{}, LARGE])
def test_rank_cut_takes_the_floor(spark, limits):
    groups = {"a": list(range(1001)), "b": [5.0], "c": list(range(10))}
    cuts = rank_cut(_rows(spark, groups), ["g"], "v", 0.9, ["id"], **limits)
    assert {r.g: r.cut for r in cuts.collect()} == {"a": 899.0, "b": 5.0, "c": 8.0}


@pytest.mark.parametrize("limits", [{}, LARGE])
def test_outliers_by_group(spark, limits):
    groups = {
        "plain": list(range(100)),
        "spiky": list(range(100)) + [1000, 2000],
        "short": [1, 1, 1, 2, 2, 2, 3, 3, 900],
        "flat": [7] * 50 + [800],
    }
    found = upper_outliers(_rows(spark, groups), "g", "v", ["id"], **limits)
    assert sorted((r.g, r.v) for r in found.collect()) == [("spiky", 1000.0), ("spiky", 2000.0)]


@pytest.fixture
def shuffling(spark):
    """A session without broadcasts and run-time changes, so that the dealing shows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("copies", [False, True])
def test_hot_key_fills_many_tasks(shuffling, copies):
    """A key with most facts, different ones or copies of one, when it meets its table row."""
    number = F.lit(7) if copies else F.col("id")
    facts = shuffling.range(20_000, numPartitions=40).select(
        F.when(F.col("id") % 3 > 0, number).otherwise(F.col("id")).alias("order_id"),
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") + 2).alias("k"),
    )
    table = facts.select("k").distinct().withColumn("name", F.col("k") * 10)
    joined = lookup(facts, table, "k")
    assert joined.count() == 20_000
    assert joined.filter("name <> k * 10").count() == 0
    per_task = joined.filter("k = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 8
    assert max(r["count"] for r in per_task) < 20_000 / 4


def test_unskewed_facts_are_not_copied(shuffling):
    facts = shuffling.range(20_000, numPartitions=8).select(
        F.col("id").alias("order_id"), (F.col("id") % 5000).alias("k")
    )
    table = facts.select("k").distinct().withColumn("name", F.col("k") * 10)
    joined = lookup(facts, table, "k")
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.filter("name = k * 10").count() == 20_000


def test_only_hot_keys_are_copied(shuffling):
    facts = shuffling.range(30_000, numPartitions=8).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
    )
    table = facts.select("k").distinct().withColumn("size", F.length("k"))
    left = facts.withColumn("k", F.when(F.col("order_id") > 5, F.col("k")))  # some null keys
    assert lookup(facts, table, "k").filter("size = length(k)").count() == 30_000
    assert lookup(left, table, "k", "left").count() == 30_000
    assert lookup(left, table, "k").count() == 29_994


def test_bytes_decide_broadcasts(spark):
    """A few wide rows are not broadcast, many narrow ones are."""
    facts = spark.range(5000).select(F.col("id").alias("order_id"), (F.col("id") % 50).alias("k"))
    narrow = spark.range(60_000).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    wide = materialize(spark.range(50).select(
        F.col("id").alias("k"), F.expr("concat_ws('', transform(sequence(1, 20000), i -> uuid()))").alias("x")
    ))
    assert fits_broadcast(narrow) and not fits_broadcast(wide)
    assert "BroadcastHashJoin" in lookup(facts, narrow, "k")._jdf.queryExecution().executedPlan().toString()
    assert lookup(facts, wide, "k").count() == 5000


def test_brackets_are_narrowed_and_widened(spark):
    """Coarse sketches, many ties and a rank that the first bracket misses."""
    rng = np.random.default_rng(4)
    groups = {
        "wide": list(rng.normal(size=20_000) * 1e6),
        "tied": [3.0] * 9000 + list(rng.normal(size=6000)),
        "edges": [0.0] * 4000 + [1.0] * 4001,
    }
    frame = _rows(spark, groups).repartition(6)
    found = quantiles(frame, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 1.0}, ["id"], accuracy=60, small_group=25)
    for row in found.collect():
        for share, value in ((0.01, row.a), (0.5, row.b), (1.0, row.c)):
            assert value == pytest.approx(np.quantile(groups[row.g], share), rel=1e-12)


def test_ten_million_distinct_values(spark):
    rows = spark.range(10_000_000).select(
        F.col("id"), F.lit("g").alias("g"), F.pmod(F.col("id") * 7919, F.lit(10_000_000)).alias("v")
    )
    found = quantiles(rows, ["g"], "v", {"q": 0.25}, ["id"], few_groups=True).first()
    assert (found.n, found.q) == (10_000_000, 2499999.75)


@pytest.mark.parametrize("limits", [{}, {"accuracy": 100, "small": 30}])
def test_medians_of_columns(spark, limits):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=4000), rng.integers(0, 3, 4000)
    rows = [(float(x), int(y), float(x) if k < 1001 else None, None) for k, (x, y) in enumerate(zip(a, b))]
    frame = spark.createDataFrame(rows, "a double, b int, c double, d double")
    found = column_medians(frame, ["a", "b", "c", "d"], **limits)
    assert found == {"a": pytest.approx(np.median(a)), "b": np.median(b), "c": pytest.approx(np.median(a[:1001])), "d": None}
    assert column_medians(frame.limit(0), ["a"]) == {"a": None}


def test_splits_are_exact_where_hashes_collide(spark):
    rows = [(k, k % 2, float(min(k, 700))) for k in range(1000)]  # 300 keys on one hash
    frame = spark.createDataFrame(rows, "id int, g int, place double").repartition(5)
    cuts = pair_cuts(frame, "g", "place", "id", 0.8, **LARGE)
    taken = frame.filter(
        F.when(F.col("g") == 0, up_to(cuts[0], F.col("place"), F.col("id")))
        .otherwise(up_to(cuts[1], F.col("place"), F.col("id")))
    )
    assert {r.g: (r["count"], r.last) for r in taken.groupBy("g").agg(F.count("*").alias("count"), F.max("id").alias("last")).collect()} == {0: (400, 798), 1: (400, 799)}
    assert pair_cuts(frame, None, "place", "id", 0.8) == {None: (700.0, 799)}
    assert pair_cuts(frame.limit(1), None, "place", "id", 0.8) == {}


@pytest.mark.parametrize("rows_per_range", [7, 1000])
def test_positions_and_running_totals(spark, rows_per_range):
    rows = [((k * 37) % 101, k, k % 5) for k in range(300)]
    frame = spark.createDataFrame(rows, "a int, id int, n int").repartition(6)
    placed = with_position(frame, [F.desc("a"), "id"], range_rows=rows_per_range)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.id) for r in sorted(placed.collect(), key=lambda r: r.position)] == [r[:2] for r in ordered]
    sums = running_total(frame, [F.desc("a"), "id"], "n", "before", range_rows=rows_per_range)
    before = {r.id: r.before for r in sums.collect()}
    assert before == {r[1]: sum(x[2] for x in ordered[:k]) for k, r in enumerate(ordered)}
    assert with_position(frame.limit(0), ["id"]).count() == 0


def test_only_large_groups_are_sketched(spark, monkeypatch):
    """Groups of few values are counted, not sketched; the quantiles are those of all values."""
    rows = [(g, float(v), g * 1000 + v) for g in range(6) for v in range(7 + 40 * (g == 0))]
    frame = spark.createDataFrame(rows, "g bigint, v double, id bigint").repartition(4)
    sketched = []
    joined = order_statistics._joined
    monkeypatch.setattr(
        order_statistics, "_joined",
        lambda values, brackets, *rest: sketched.append(brackets.count())
        or joined(values, brackets, *rest),
    )
    found = order_statistics.quantiles(frame, ["g"], "v", {"q": 0.5}, ["id"], small_group=10)
    assert {r.g: r.q for r in found.collect()} == {0: 23.0} | {g: 3.0 for g in range(1, 6)}
    assert sketched[0] == 1


def test_medians_of_ties_are_not_ranked(spark, monkeypatch):
    """Where a bracket holds one value, it is the median; no scan is spent on it."""
    frame = spark.createDataFrame([(float(v % 3),) for v in range(300)], "v double")
    monkeypatch.setattr(order_statistics, "Window", None)
    assert order_statistics.column_medians(frame, ["v"], small=10) == {"v": 1.0}
