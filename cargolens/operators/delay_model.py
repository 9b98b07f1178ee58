"""Delay-risk model: features, training, evaluation and batch scoring."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cargolens.functions.numbers import exact_round, spread_key
from cargolens.operators import delay_forest
from cargolens.operators.filters import completed, is_delayed, lookup
from cargolens.operators.order_statistics import column_medians, pair_cuts, quantiles, up_to
from cargolens.operators.scorecard import scorecard
from cargolens.session import materialize, shared_folder

# Fixed values ---------------------------------------------------------------
NUMERIC = [
    "on_time_rate", "average_delivery_days", "quality_score", "risk_score", "quantity",
    "order_month",
]
CATEGORICAL = ["category", "priority"]
TREES = 300
MAX_DEPTH = 8
MIN_LEAF = 5
SEED = 42
TRAIN_SHARE = 0.8
DELAYED_FROM = 0.5
# ----------------------------------------------------------------------------

ROWS_PER_PART = delay_forest.BLOCK_ROWS  # training rows of a block, in which copies are drawn
DRAWS = 1 << 20  # steps of the share that is drawn if a caller asks for fewer rows


def _with_dimensions(orders: DataFrame, suppliers: DataFrame, inventory: DataFrame) -> DataFrame:
    rates = suppliers.select(
        "supplier_id", "on_time_rate", "average_delivery_days", "quality_score", "risk_score"
    )
    categories = inventory.select("product_id", "category")
    rows = orders.withColumn("order_month", F.month("order_date"))
    rows = lookup(rows, rates, "supplier_id", "left")
    return lookup(rows, categories, "product_id", "left")


def delay_features(orders: DataFrame, suppliers: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per completed order with the features and the label ``is_delayed``."""
    rows = completed(orders).select(
        "order_id", "supplier_id", "product_id", "order_date", "quantity", "priority",
        is_delayed().alias("is_delayed"),
    )
    return _with_dimensions(rows, suppliers, inventory).select(
        "order_id", "supplier_id", "product_id", *NUMERIC, *CATEGORICAL, "is_delayed"
    )


def train_only_features(
    orders: DataFrame, base_suppliers: DataFrame, inventory: DataFrame
) -> DataFrame:
    """As ``delay_features`` after the split, with supplier rates from training orders only."""
    rows = completed(orders).select(
        "order_id", "supplier_id", "product_id", "order_date", "actual_delivery", "quantity",
        "priority", "status", is_delayed().alias("is_delayed"),
    )
    rows = stratified_split(materialize(rows))  # read by the split, the rates and the result
    rates = scorecard(base_suppliers, rows.filter("split = 'train'"))
    return _with_dimensions(rows, rates, inventory).select(
        "order_id", "supplier_id", "product_id", *NUMERIC, *CATEGORICAL, "is_delayed", "split"
    )


def feature_medians(features: DataFrame) -> dict[str, float]:
    """The median of each numeric column; six numbers, all found in the same scans.

    Reads the features three times; hand it a materialized frame.
    """
    return column_medians(features, NUMERIC)


def impute(features: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Put the median in place of missing numbers."""
    return features.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double"))
            for c in NUMERIC
        }
    )


def stratified_split(features: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``split``: in each class, the ⌊train_share · n⌋ rows of the lowest order hash.

    Equal hashes are ordered by order id. The cut per class is an exact order statistic, so no
    class is sorted in one task. Rows of one order id fall on one side.
    """
    hashed = features.withColumn("__place", spread_key(features, "order_id"))
    in_train = F.lit(False)
    for label, cut in pair_cuts(hashed, "is_delayed", "__place", "order_id", train_share).items():
        below = up_to(cut, F.col("__place"), F.col("order_id"))
        in_train = in_train | (F.col("is_delayed").eqNullSafe(F.lit(label)) & below)
    return hashed.withColumn("split", F.when(in_train, "train").otherwise("test")).drop("__place")


def class_weights(train: DataFrame) -> tuple[int, np.ndarray]:
    """The rows, and n / (classes present * rows of the class) for classes 0 and 1."""
    sizes = {row.is_delayed: row.n for row in train.groupBy("is_delayed").agg(
        F.count("*").alias("n")
    ).collect()}
    if not sizes or not sizes.keys() <= {0, 1}:
        raise ValueError("no rows to train on, or a label other than 0 and 1")
    total = sum(sizes.values())
    weights = [total / (len(sizes) * sizes[label]) if label in sizes else 1.0 for label in (0, 1)]
    return total, np.array(weights)


def fit(train: DataFrame, trees: int = TREES, seed: int = SEED) -> PipelineModel:
    """One-hot encoding (unknown words give zeros) and a balanced random forest on all rows.

    Words, cuts of the numbers, class weights and trees come from every row of ``train``. A
    tree takes each row as often as a draw by its place in its block says (bagging). Reads the
    frame a few times; trees are grown on packed rows.
    """
    indices = [f"{c}_index" for c in CATEGORICAL]
    flags = [f"{c}_flags" for c in CATEGORICAL]
    n_rows, weights = class_weights(train)
    encoder = Pipeline(stages=[
        StringIndexer(
            inputCols=CATEGORICAL, outputCols=indices, handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indices, outputCols=flags, dropLast=True),
        VectorAssembler(inputCols=NUMERIC + flags, outputCol="features"),
    ]).fit(train)
    n_words = [len(words) for words in encoder.stages[0].labelsArray]
    cuts = delay_forest.cut_points(train, NUMERIC)
    blocks = delay_forest.pack(
        encoder.stages[0].transform(train), cuts, NUMERIC, indices, "is_delayed", n_rows,
        ROWS_PER_PART,
    )
    forest = delay_forest.grow(blocks, cuts, n_words, weights, trees, MAX_DEPTH, MIN_LEAF, seed)
    settings = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees,
        maxDepth=MAX_DEPTH, minInstancesPerNode=MIN_LEAF, featureSubsetStrategy="sqrt", seed=seed,
    )
    model = delay_forest.as_model(
        train.sparkSession, delay_forest.node_rows(forest, cuts, weights),
        len(NUMERIC) + sum(n_words), settings,
    )
    return PipelineModel(stages=[*encoder.stages, model])


def _forest_nodes(model: PipelineModel) -> pd.DataFrame:
    """The nodes of all trees in order, as the forest writes them when saved.

    ``column`` is the place of the tested column among ``NUMERIC`` and ``CATEGORICAL``. A numeric
    test leads left up to ``cut``; a flag's compares the word's number with ``cut`` and leads left
    if they are ``equal`` (or differ). Leaves lead to themselves. At most ``2 ** (depth + 1)``
    nodes per tree come to the driver.
    """
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    model.stages[-1].save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.impurityStats", "nodeData.split.*",
    ).toPandas().sort_values(["tree", "id"], ignore_index=True)
    first = nodes.groupby("tree")["id"].transform("size").groupby(nodes["tree"]).first()
    first = nodes["tree"].map(first.cumsum() - first).to_numpy()
    leaf = nodes["leftChild"].to_numpy() < 0
    own = np.arange(len(nodes))
    stats = np.array(nodes["impurityStats"].to_list())
    total = stats.sum(axis=1)
    shares = np.divide(stats, total[:, None], where=total[:, None] != 0, out=np.zeros_like(stats))
    sides = nodes["leftCategoriesOrThreshold"].map(lambda v: list(v) if v is not None else [])
    # Flags of the words, by their place in the features.
    flags = [(len(NUMERIC) + c, word) for c, row in enumerate(model.stages[0].labelsArray)
             for word in range(len(row))]
    column, cut, equal = np.zeros(len(nodes), int), np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    flag = np.zeros(len(nodes), bool)
    for i in np.flatnonzero(~leaf):
        feature, side = int(nodes["featureIndex"][i]), sides[i]
        if feature < len(NUMERIC):
            column[i], cut[i] = feature, side[0]
        else:
            column[i], cut[i] = flags[feature - len(NUMERIC)]
            flag[i] = True
            equal[i] = nodes["numCategories"][i] >= 0 and 1.0 in side
    return pd.DataFrame({
        "tree": nodes["tree"], "column": column, "cut": cut, "flag": flag, "equal": equal,
        "left": np.where(leaf, own, nodes["leftChild"] + first),
        "right": np.where(leaf, own, nodes["rightChild"] + first),
        "share0": shares[:, 0], "share1": shares[:, 1],
    })


def _delayed_share(model: PipelineModel) -> Callable[..., Column]:
    """The forest's probability of class 1, with all rows of a batch going down a tree at once."""
    nodes = _forest_nodes(model)
    roots = np.flatnonzero(~nodes["tree"].duplicated())
    depth = model.stages[-1].getMaxDepth()
    shared = SparkSession.active().sparkContext.broadcast(
        (roots, {name: nodes[name].to_numpy() for name in nodes.columns})
    )

    @F.pandas_udf("double")
    def share(*columns: pd.Series) -> pd.Series:
        roots, node = shared.value
        values = np.column_stack([c.to_numpy(float) for c in columns])
        if np.isnan(values).any():
            raise ValueError("features hold missing numbers")
        row, votes = np.arange(len(values)), np.zeros((2, len(values)))
        for root in roots:
            at = np.full(len(values), root)
            for _ in range(depth):
                value, cut = values[row, node["column"][at]], node["cut"][at]
                go_left = np.where(
                    node["flag"][at], (value == cut) == node["equal"][at], value <= cut
                )
                at = np.where(go_left, node["left"][at], node["right"][at])
            votes[0] += node["share0"][at]
            votes[1] += node["share1"][at]
        total = votes.sum(axis=0)
        return pd.Series(np.divide(votes[1], total, where=total != 0, out=votes[1].copy()))

    return share


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``probability_delayed`` and ``prediction`` (1 = delayed) to feature rows."""
    words = [f"{c}_index" for c in CATEGORICAL]
    share = _delayed_share(model)(*[F.col(c).cast("double") for c in NUMERIC + words])
    scored = model.stages[0].transform(rows).withColumn("__share", share)
    return scored.select(
        *rows.columns,
        exact_round(F.col("__share"), 3).alias("probability_delayed"),
        (F.col("__share") > DELAYED_FROM).cast("int").alias("prediction"),
        (F.col("__share") >= DELAYED_FROM).alias("at_risk"),
    )


def score_new_orders(
    model: PipelineModel, medians: dict[str, float], orders: DataFrame, suppliers: DataFrame,
    inventory: DataFrame,
) -> DataFrame:
    """Delay probability and verdict for orders whose outcome is not known yet."""
    rows = orders.select(
        "order_id", "supplier_id", "product_id", "order_date", "quantity", "priority"
    )
    ready = impute(_with_dimensions(rows, suppliers, inventory), medians)
    return score(model, ready).select(
        "order_id", "supplier_id", "product_id", "probability_delayed",
        F.when(F.col("at_risk"), "Delayed").otherwise("On Time").alias("prediction"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _counts(predictions: DataFrame) -> DataFrame:
    """True and false positives and negatives in one row."""

    def cell(actual: int, predicted: int) -> Column:
        return F.count_if((F.col("is_delayed") == actual) & (F.col("prediction") == predicted))

    return predictions.agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
    )


def delay_metrics(predictions: DataFrame, n_train: Column) -> DataFrame:
    """Accuracy, precision, recall, F1 and sizes."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    return _counts(predictions).select(
        exact_round(_ratio(tp + tn, total), 4).alias("accuracy"),
        exact_round(_ratio(tp, tp + fp), 4).alias("precision"),
        exact_round(_ratio(tp, tp + fn), 4).alias("recall"),
        exact_round(_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1_score"),
        n_train.alias("n_train"),
        total.alias("n_test"),
        exact_round(_ratio(tp + fn, total), 4).alias("positive_rate_test"),
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Rows for all four pairs of actual and predicted class, empty ones included."""
    cells = F.array(
        *[
            F.struct(
                F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"),
                F.col(name).alias("orders"),
            )
            for actual, predicted, name in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
        ]
    )
    return _counts(predictions).select(F.inline(cells))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, their averages and the accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("row"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.alias("support"),
        )

    zero = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp), tn + fp)
    one = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    total = tp + fp + fn + tn
    macro = [(a + b) / 2.0 for a, b in zip(zero[:3], one[:3])]
    weighted = [
        _ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])
    ]
    none = F.lit(None).cast("double")
    lines = F.array(
        line("0", *zero),
        line("1", *one),
        line("accuracy", none, none, _ratio(tp + tn, total), total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )
    return _counts(predictions).select(F.inline(lines))


def feature_names(model: PipelineModel) -> list[str]:
    """Numeric columns, then one name per category word and per priority word."""
    words = model.stages[0].labelsArray
    return NUMERIC + [f"{c}_{word}" for c, row in zip(CATEGORICAL, words) for word in row]


def feature_importance(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Importance per feature; one row per column of the model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, round(float(w), 4)) for n, w in zip(feature_names(model), weights)]
    return features.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def rule_predictions(features: DataFrame) -> DataFrame:
    """A rule in place of the model: delayed if the supplier's on-time rate is below the median."""
    features = materialize(features.select("order_id", "on_time_rate", "is_delayed"))
    median = quantiles(features, [], "on_time_rate", {"median": 0.5}, ["order_id"])
    cut = median.select("median").scalar()
    return features.select(
        "order_id", "is_delayed", (F.col("on_time_rate") < cut).cast("int").alias("prediction")
    )


@dataclass
class TrainedDelayModel:
    """What training leaves behind."""

    model: PipelineModel
    medians: dict[str, float]
    n_train: int
    test: DataFrame


def train(
    features: DataFrame, trees: int = TREES, seed: int = SEED, fit_rows: int | None = None
) -> TrainedDelayModel:
    """Split, impute and fit. Frames with a ``split`` column keep their split.

    Trees grow on all training rows. Only a caller that names ``fit_rows`` gets trees of about
    that many, drawn by a hash of the row; medians, split and evaluation are over all rows.
    """
    # Read by the split, the medians, the fit and the evaluation.
    ready = materialize(features)
    if "split" not in ready.columns:
        ready = stratified_split(ready)
    medians = feature_medians(ready)
    imputed = impute(ready, medians)
    chosen = imputed.filter("split = 'train'")
    n_train = chosen.count()
    if fit_rows is not None and n_train > fit_rows:
        row = F.xxhash64(F.lit(seed), "order_id", "supplier_id", "product_id", "quantity")
        chosen = chosen.filter(F.pmod(row, F.lit(DRAWS)) < DRAWS * fit_rows // n_train)
    model = fit(chosen, trees, seed)
    return TrainedDelayModel(model, medians, n_train, imputed.filter("split = 'test'"))
