"""Isolation forest over supplier-months (Liu, Ting and Zhou, ICDM 2008)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from cargolens.functions.numbers import (
    HASH_MULTIPLIER, HASH_RANGE, exact_round, spread, spread_key,
)
from cargolens.operators.anomalies import FOREST_TYPE, supplier_months, with_names
from cargolens.operators.order_statistics import quantiles
from cargolens.session import materialize, use_all_cores

# Fixed values ---------------------------------------------------------------
TREES = 200
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
MIN_ROWS = 10
FEATURES = ["avg_delay", "delayed_count", "order_count"]
EULER_GAMMA = 0.5772156649015329
# ----------------------------------------------------------------------------

NODE_ARRAY = "array<struct<node: bigint, feature: int, split: double, units: bigint>>"
HALF_STEP = 40503  # parts of a key are this far apart on the circle of hashes
LENGTH_UNITS = 1_000_000  # path lengths are whole millionths, so sums do not depend on their order
CIRCLE = HASH_RANGE
ARC_CELLS = 1024


def mean_path(size: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of ``size`` keys."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + EULER_GAMMA) - 2.0 * (size - 1.0) / size


def tree_start(tree: int, seed: int) -> int:
    """Where on the circle of hashes the arc of a tree begins."""
    return (tree * HASH_MULTIPLIER + seed) % CIRCLE


def draw_samples(
    features: DataFrame, place: Column, rows: int, row_keys: list[str], trees: int = TREES,
    sample: int = SAMPLE, seed: int = SEED,
) -> DataFrame:
    """``tree`` and the features of the ``sample`` rows that follow each tree's start.

    One hash per row puts it on a circle (``place``); a tree takes the first rows from its start
    on, ties by key. Only rows within arcs of about twice the length needed are told
    which trees they may serve; arcs are doubled until each holds enough rows.
    """
    spark = features.sparkSession
    values = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(FEATURES)]
    placed = features.select(place.alias("place"), *row_keys, *values)
    cell_size = CIRCLE // ARC_CELLS
    arc = min(CIRCLE, max(2 * sample * CIRCLE // max(rows, 1), 1))
    while True:
        cells = [
            ((start // cell_size + step) % ARC_CELLS, tree, start)
            for tree in range(trees) for start in [tree_start(tree, seed)]
            for step in range(min(arc // cell_size + 2, ARC_CELLS))
        ]
        arcs = F.broadcast(spark.createDataFrame(cells, "cell int, tree int, start bigint"))
        near = (
            placed.withColumn("cell", F.floor(F.col("place") / cell_size).cast("int"))
            .join(arcs, "cell")
            .withColumn("away", F.pmod(F.col("place") - F.col("start"), F.lit(CIRCLE)))
            .filter(F.col("away") < arc)
        )
        near = materialize(near.drop("cell", "start", "place"))
        enough = near.groupBy("tree").count().filter(F.col("count") >= min(sample, rows)).count()
        if enough == trees or arc == CIRCLE:
            break
        arc = min(2 * arc, CIRCLE)
    order = Window.partitionBy("tree").orderBy("away", *row_keys)
    return near.withColumn("drawn", F.row_number().over(order)).filter(
        F.col("drawn") <= sample
    ).select("tree", "x0", "x1", "x2")


def grow_forest(samples: DataFrame, sample: int, seed: int = SEED) -> DataFrame:
    """``tree, node, feature, split, units``: all nodes of all trees, level by level.

    Node 1 is a root, 2n and 2n + 1 are the children of node n. At each level one aggregate
    over (tree, node) finds the spans of the features; hashes of tree and node choose one of
    those that vary and the place of the cut. Nodes of one row, of equal rows and of the last
    level are leaves (``feature`` -1) with their path length in millionths. Rows stay with
    their tree, so after the first level nothing is shuffled.
    """
    last = math.ceil(math.log2(max(sample, 2)))
    rows = samples.withColumns(
        {"node": F.lit(1).cast("bigint"), "nodes": F.array().cast(NODE_ARRAY)}
    ).repartition("tree")
    for depth in range(last + 1):
        here = Window.partitionBy("tree", "node")
        for k in range(len(FEATURES)):
            rows = rows.withColumns(
                {f"low{k}": F.min(f"x{k}").over(here), f"high{k}": F.max(f"x{k}").over(here)}
            )
        rows = rows.withColumn("n", F.count("*").over(here))
        hashed = F.pmod(
            (F.col("tree") * 1024 + F.col("node")) * F.lit(HASH_MULTIPLIER) + F.lit(seed * HALF_STEP),
            F.lit(CIRCLE),
        )
        varying = F.filter(
            F.array(*[
                F.struct(
                    F.lit(k).alias("k"), F.col(f"low{k}").alias("low"),
                    F.col(f"high{k}").alias("high"), F.col(f"x{k}").alias("x"),
                ) for k in range(len(FEATURES))
            ]),
            lambda f: f["high"] > f["low"],
        )
        rows = rows.withColumns({"hash": hashed, "varying": varying})
        choice = F.floor(F.col("hash") * F.size("varying") / float(CIRCLE)).cast("int")
        rows = rows.withColumn("cut", F.get("varying", choice))
        share = spread(F.col("hash")) / float(CIRCLE)
        split = F.col("cut.low") + (F.col("cut.high") - F.col("cut.low")) * share
        rows = rows.withColumn("split", split)
        inner = (F.col("split") < F.col("cut.high")) if depth < last else F.lit(False)
        n = F.col("n")
        beyond = F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(
            2.0 * (F.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n
        )
        units = F.rint((depth + beyond) * LENGTH_UNITS).cast("bigint")
        inner = F.coalesce(inner, F.lit(False))
        node = F.struct(
            F.col("node").alias("node"),
            F.when(inner, F.col("cut.k")).otherwise(-1).alias("feature"),
            F.when(inner, F.col("split")).otherwise(0.0).alias("split"),
            F.when(inner, 0).otherwise(units).cast("bigint").alias("units"),
        )
        open_ = F.col("node").isNotNull()
        rows = rows.withColumn(
            "nodes", F.when(open_, F.concat("nodes", F.array(node))).otherwise(F.col("nodes"))
        )
        right = (F.col("cut.x") > F.col("split")).cast("bigint")
        rows = rows.select(
            "tree", "x0", "x1", "x2", "nodes", F.when(inner, F.col("node") * 2 + right).alias("node")
        )
    return rows.select("tree", F.inline("nodes")).dropDuplicates(["tree", "node"])


def anomaly_scores(
    features: DataFrame, place: Column, row_keys: list[str], trees: int = TREES,
    sample: int = SAMPLE, seed: int = SEED,
) -> DataFrame:
    """Add ``iso_raw``: minus the anomaly score of the paper, lower is stranger."""
    total = features.count()
    if total < MIN_ROWS:
        return features.withColumn("iso_raw", F.lit(None).cast("double")).filter(F.lit(False))
    sample = min(sample, total)
    drawn = draw_samples(features, place, total, row_keys, trees, sample, seed)
    # At most trees * (2 * sample - 1) short rows, whatever the size of the table.
    nodes = grow_forest(drawn, sample, seed).toPandas()
    size = 2 ** (math.ceil(math.log2(max(sample, 2))) + 1)
    forest = []
    for _, part in nodes.groupby("tree", sort=True):
        feature, split, units = np.full(size, -1), np.zeros(size), np.zeros(size, dtype=np.int64)
        at = part["node"].to_numpy()
        feature[at], split[at], units[at] = part["feature"], part["split"], part["units"]
        forest.append((feature, split, units))
    shared = features.sparkSession.sparkContext.broadcast(forest)
    scale = float(trees * LENGTH_UNITS)
    norm = mean_path(sample)

    @pandas_udf("bigint")
    def path_units(delay: pd.Series, delayed: pd.Series, orders: pd.Series) -> pd.Series:
        points = np.column_stack([delay, delayed, orders]).astype(float)
        total = np.zeros(len(points), dtype=np.int64)
        for feature, split, units in shared.value:
            at = np.ones(len(points), dtype=np.int64)
            moving = np.flatnonzero(feature[at] >= 0)
            while len(moving):
                here = at[moving]
                at[moving] = 2 * here + (points[moving, feature[here]] > split[here])
                moving = moving[feature[at[moving]] >= 0]
            total += units[at]
        return pd.Series(total)

    scored = use_all_cores(features).withColumn("units", path_units(*FEATURES))
    raw = -F.pow(F.lit(2.0), -(F.col("units") / scale) / F.lit(norm))
    return scored.withColumn("iso_raw", raw).drop("units")


def isolation_forest(
    orders: DataFrame, suppliers: DataFrame, trees: int = TREES,
    contamination: float = CONTAMINATION, seed: int = SEED,
) -> DataFrame:
    """Supplier-months the forest sets apart, with their score below the cut."""
    keys = ["supplier_id", "month"]
    # Read by the sampling, the count, the quantile and the result.
    months = use_all_cores(materialize(supplier_months(orders)))
    month_no = F.substring("month", 1, 4).cast("bigint") * 12 + F.substring("month", 6, 2).cast("bigint")
    place = spread(spread_key(months, "supplier_id") + month_no * HALF_STEP)
    scored = materialize(anomaly_scores(months, place, keys, trees, seed=seed))
    cut = quantiles(scored, [], "iso_raw", {"cut": contamination}, keys).select("cut").scalar()
    flagged = scored.withColumn("score", F.col("iso_raw") - cut).filter(F.col("score") < 0)
    return with_names(flagged, suppliers).select(
        "supplier_id",
        "supplier_name",
        "month",
        exact_round(F.col("avg_delay"), 1).alias("avg_delay"),
        exact_round(F.col("score"), 3).alias("isolation_forest_score"),
        F.lit(FOREST_TYPE).alias("type"),
    )
