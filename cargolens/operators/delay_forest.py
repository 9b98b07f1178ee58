"""A balanced random forest of two classes, grown on all rows, level by level.

Numbers are cut at quantiles of all rows, and rows are packed into blocks of bytes once. At each level
every task counts, for all trees at once, the classes of its rows per node, tried feature and cell;
one group per tree adds the counts and picks the cuts. Counts are whole, so neither the order
nor the dealing of rows changes a tree. The forest is handed over in Spark ML's own file format.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.operators.ordering import running_total
from cargolens.session import materialize, shared_folder

CELLS = 32  # of a number, so at most CELLS - 1 cuts
BLOCK_ROWS = 16_384  # that a task looks at together
PARTS = 256  # of the packed rows, and more where a part would have over PART_ROWS rows
PART_ROWS = 1 << 20
COUNT_BYTES = 256 << 20  # of counters that a task keeps; more trees take several turns
VALUE_BYTES = 16 << 20  # of expanded features that a task looks at together
DRAWS = 1 << 16  # steps of the share by which a row's copies in a tree are drawn

_reached = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]) * DRAWS
#: Copies of a row in a tree, Poisson distributed with mean 1, by a number below ``DRAWS``.
COPIES = np.searchsorted(_reached, np.arange(DRAWS) + 0.5).astype(np.uint8)


def cut_points(rows: DataFrame, columns: Sequence[str], cells: int = CELLS) -> list[np.ndarray]:
    """Where each column is cut: between all its values, or between quantiles of all rows.

    Columns of more than ``cells`` values are cut where the rows up to a value come closest to a
    multiple of a ``cells``-th; a value of more rows than that counts as so many, so
    that it leaves cuts for the others. A cut lies half-way to the next value.
    """
    each = F.array(*[
        F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("value"))
        for k, c in enumerate(columns)
    ])
    counts = materialize(rows.select(F.inline(each)).groupBy("column", "value").count())
    if not counts.filter("value IS NULL OR isnan(value)").isEmpty():
        raise ValueError("features hold missing numbers")
    total = counts.filter("column = 0").agg(F.sum("count")).first()[0] or 0
    mass = counts.withColumn("mass", F.least(F.col("count") * cells, F.lit(total)))
    sizes = {
        row["column"]: row for row in mass.groupBy("column").agg(
            F.count("*").alias("values"), F.sum("mass").alias("mass"), F.max("value").alias("last")
        ).collect()
    }
    few = [k for k, row in sizes.items() if row["values"] <= cells]
    lower = {k: [] for k in sizes}
    for row in counts.filter(F.col("column").isin(few)).collect():
        lower[row["column"]].append(row["value"])
    many = [k for k in sizes if k not in few]
    if many:
        placed = running_total(
            mass.filter(F.col("column").isin(many)), ["column", "value"], "mass", "before"
        )
        own, earlier, start = F.lit(None), F.lit(None), 0
        for k in sorted(many):
            own = F.when(F.col("column") == k, F.lit(float(sizes[k]["mass"]))).otherwise(own)
            earlier = F.when(F.col("column") == k, F.lit(start)).otherwise(earlier)
            start += sizes[k]["mass"]
        middle = (F.col("before") - earlier) + F.col("mass") / 2
        found = placed.groupBy("column", F.ceil(middle * cells / own).alias("cell")).agg(
            F.max("value").alias("value")
        )
        for row in found.collect():
            if row["cell"] < cells:
                lower[row["column"]].append(row["value"])
    ends = [sorted(v for v in lower.get(k, []) if v < sizes[k]["last"]) for k in range(len(columns))]
    # The next value after each end is the least one of the cell that begins there.
    cell = F.lit(0)
    for k, values in enumerate(ends):
        if values:
            known = F.array(*map(F.lit, values))
            above = F.size(F.filter(known, lambda end: end < F.col("value")))
            cell = F.when(F.col("column") == k, above).otherwise(cell)
    after = {
        (row["column"], row["cell"]): row["value"]
        for row in counts.groupBy("column", cell.alias("cell")).agg(
            F.min("value").alias("value")
        ).collect()
    }
    return [
        np.array([_between(v, after[k, i + 1]) for i, v in enumerate(values)], float)
        for k, values in enumerate(ends)
    ]


def _between(low: float, high: float) -> float:
    middle = low + (high - low) / 2
    return middle if low <= middle < high else low


def pack(
    rows: DataFrame, cuts: list[np.ndarray], columns: Sequence[str], words: Sequence[str],
    label: str, n_rows: int, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``part, block, numbers, words``: all rows as bytes, in blocks, written once.

    A row is eight bytes of cell numbers, the last one its class, and 32 bits per word.
    Rows are dealt by a hash of all they hold and sorted in their part, so blocks follow
    from the rows alone.
    """
    parts = -(-n_rows // block_rows)
    parts = max(1, parts if parts <= PARTS else max(PARTS, -(-n_rows // PART_ROWS)))
    dealt = rows.select(
        F.xxhash64(*rows.columns).alias("place"),
        *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)],
        *[F.col(c).cast("int").alias(f"w{k}") for k, c in enumerate(words)],
        F.col(label).cast("int").alias("label"),
    )

    def in_cells(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, 8), np.uint8)
            for k, cut in enumerate(cuts):
                cells[:, k] = np.searchsorted(cut, batch.column(f"x{k}").to_numpy(zero_copy_only=False))
            cells[:, 7] = batch.column("label").to_numpy(zero_copy_only=False)
            codes = np.zeros((batch.num_rows, 2), np.uint32)
            for k in range(len(words)):
                codes[:, k] = batch.column(f"w{k}").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), pa.array(cells.view(np.int64).ravel()),
                 pa.array(codes.view(np.int64).ravel())], ["place", "numbers", "words"],
            )

    def in_blocks(batches):
        found = [(b.column("numbers").to_numpy(), b.column("words").to_numpy()) for b in batches]
        if not found:
            return
        numbers, codes = map(np.concatenate, zip(*found))
        order, part = np.lexsort((codes, numbers)), TaskContext.get().partitionId()
        for block, start in enumerate(range(0, len(order), block_rows)):
            here = order[start : start + block_rows]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "numbers": [numbers[here].tobytes()], "words": [codes[here].tobytes()],
            })

    small = dealt.mapInArrow(in_cells, "place bigint, numbers bigint, words bigint")
    return materialize(
        small.repartition(parts, "place").mapInArrow(
            in_blocks, "part int, block int, numbers binary, words binary"
        )
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield (
                row["part"], row["block"],
                np.frombuffer(row["numbers"], np.uint8).reshape(-1, 8),
                np.frombuffer(row["words"], np.uint32).reshape(-1, 2),
            )


def _expanded(
    cells: np.ndarray, codes: np.ndarray, n_numbers: int, n_words: Sequence[int]
) -> np.ndarray:
    """A byte per row and feature: twice its cell (a word's flag) and the class."""
    label = cells[:, 7]
    values = np.empty((len(cells), n_numbers + sum(n_words)), np.uint8)
    values[:, :n_numbers] = 2 * cells[:, :n_numbers] + label[:, None]
    at = n_numbers
    for k, n in enumerate(n_words):
        flags = codes[:, k, None] == np.arange(n, dtype=np.uint32)
        values[:, at : at + n] = 2 * flags + label[:, None]
        at += n
    return values


def _counts(state, seed: int, depth: int, n_numbers: int, n_words: Sequence[int]):
    """For ``mapInArrow``: each tree's counts by slot, tried feature, cell and class, as bytes."""
    width = n_numbers + sum(n_words)
    at_once = max(1, VALUE_BYTES // width)

    def run(batches):
        grown, found = state.value, {}
        for part, block, cells, codes in _blocks(batches):
            n = len(cells)
            for start in range(0, n, at_once):
                here = slice(start, start + at_once)
                flat = _expanded(cells[here], codes[here], n_numbers, n_words).ravel()
                for tree, (column, cut, slot, tried) in grown.items():
                    rng = np.random.Generator(np.random.SFC64([seed, tree, part, block]))
                    copies = COPIES[rng.integers(0, DRAWS, n, np.uint16)][here]
                    rows = np.flatnonzero(copies)
                    copies, base = copies[rows].astype(float), rows * width
                    at = np.zeros(len(rows), np.int64)
                    for _ in range(depth):
                        right = flat.take(base + column.take(at)) > cut.take(at)
                        at = 2 * at + 1 + right
                    at = slot.take(at - ((1 << depth) - 1))
                    if (at < 0).any():
                        inside = np.flatnonzero(at >= 0)
                        copies, base, at = copies[inside], base[inside], at[inside]
                    slots, tries = tried.shape[1], len(tried)
                    where = flat.take(tried.take(at, axis=1) + base)
                    where = where + (at * (tries * 2 * CELLS) + np.arange(tries)[:, None] * 2 * CELLS)
                    counted = np.bincount(
                        where.ravel(), np.broadcast_to(copies, where.shape).ravel(),
                        slots * tries * 2 * CELLS,
                    )
                    if tree not in found:
                        found[tree] = np.zeros(slots * tries * 2 * CELLS)
                    found[tree] += counted
        for tree, counted in found.items():
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree], pa.int32()),
                "counts": [counted.astype(np.int64).tobytes()],
            })

    return run


def best_cuts(
    counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, least: int
) -> tuple[np.ndarray, ...]:
    """``gain, tried, cut, left, right`` of the best cut of each slot; gain 0 where none helps.

    ``counts`` are by slot, tried feature, cell and class, ``sizes`` the cuts of tried
    features. Cuts leave ``least`` rows on each side and lessen the weighted Gini impurity.
    """
    left = counts.cumsum(axis=2)[:, :, :-1]
    whole = counts.sum(axis=2, keepdims=True)
    right = whole - left
    known = np.arange(CELLS - 1) < sizes[:, :, None]
    valid = known & (left.sum(-1) >= least) & (right.sum(-1) >= least)

    def size_and_purity(side):
        weighted = side * weights
        size = weighted.sum(-1)
        squares = (weighted ** 2).sum(-1)
        return size, np.divide(squares, size, out=np.zeros_like(size), where=size > 0)

    n, pure = size_and_purity(whole)
    (_, pure_left), (_, pure_right) = size_and_purity(left), size_and_purity(right)
    gain = np.divide(pure_left + pure_right - pure, n, out=np.zeros_like(pure_left), where=n > 0)
    gain = np.where(valid & (gain > 1e-12), gain, 0.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    slot = np.arange(len(counts))
    tried, cut = np.divmod(best, CELLS - 1)
    return gain[slot, best], tried, cut, left[slot, tried, cut], right[slot, tried, cut]


CHOICES = "tree int, slot int, gain double, tried int, cut int, l0 bigint, l1 bigint, r0 bigint, r1 bigint"


def _choices(state, sizes: np.ndarray, weights: np.ndarray, least: int):
    """For ``applyInPandas``: the sums of a tree's counts, and the best cut of each slot."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        tree = int(parts["tree"].iloc[0])
        tried = state.value[tree][3]
        counts = sum(np.frombuffer(c, np.int64) for c in parts["counts"])
        counts = counts.reshape(tried.shape[1], len(tried), CELLS, 2)
        gain, pick, cut, left, right = best_cuts(counts, sizes[tried.T], weights, least)
        # A slot without a cut returns its counts as its left side.
        left = np.where(gain[:, None] > 0, left, counts[:, 0].sum(axis=1))
        right = np.where(gain[:, None] > 0, right, 0)
        return pd.DataFrame({
            "tree": tree, "slot": np.arange(len(gain)), "gain": gain, "tried": pick, "cut": cut,
            "l0": left[:, 0], "l1": left[:, 1], "r0": right[:, 0], "r1": right[:, 1],
        })

    return run


def grow(
    blocks: DataFrame, cuts: list[np.ndarray], n_words: Sequence[int], weights: np.ndarray,
    trees: int, depth: int, least: int, seed: int,
) -> dict[str, np.ndarray]:
    """``feature`` (-1 for leaves), ``cut``, ``gain`` and class ``counts`` by tree and node.

    Node 0 is a root, 2n + 1 and 2n + 2 are the children of node n. A node tries the square
    root of the number of features, drawn by tree and node.
    """
    spark = blocks.sparkSession
    sizes = np.array([*map(len, cuts), *[1] * sum(n_words)])
    width, tries = len(sizes), math.ceil(math.sqrt(len(sizes)))
    nodes = (1 << (depth + 1)) - 1
    feature, cut = np.full((trees, nodes), -1), np.zeros((trees, nodes), int)
    gain, counts = np.zeros((trees, nodes)), np.zeros((trees, nodes, 2), np.int64)
    open_nodes = {tree: np.array([0]) for tree in range(trees)}
    for level in range(depth):
        first, state = (1 << level) - 1, {}
        for tree, here in open_nodes.items():
            slot = np.full(1 << level, -1)
            slot[here - first] = np.arange(len(here))
            draws = np.random.default_rng([seed, tree, level]).random((len(here), width))
            tried = np.sort(np.argsort(draws, axis=1)[:, :tries], axis=1).T.copy()
            inner = feature[tree, :first]
            # Nodes below a leaf are in no slot, wherever its rows go.
            ends = np.where(inner < 0, 255, 2 * cut[tree, :first] + 1).astype(np.uint8)
            state[tree] = (np.maximum(inner, 0), ends, slot, tried)
        each = max((s[3].size for s in state.values()), default=0) * 2 * CELLS * 8
        found = []
        for some in batched(state, max(1, COUNT_BYTES // max(each, 1))):
            shared = spark.sparkContext.broadcast({tree: state[tree] for tree in some})
            partial = blocks.mapInArrow(
                _counts(shared, seed, level, len(cuts), n_words), "tree int, counts binary"
            )
            found.append(
                partial.groupBy("tree")
                .applyInPandas(_choices(shared, sizes, weights, least), CHOICES).toPandas()
            )
            shared.destroy()
        if not found:
            break
        open_next = {}
        for tree, best in pd.concat(found).groupby("tree"):
            best, here = best.sort_values("slot"), open_nodes[tree]
            left, right = best[["l0", "l1"]].to_numpy(), best[["r0", "r1"]].to_numpy()
            counts[tree, here] = left + right
            grown = np.flatnonzero(best["gain"] > 0)
            left, right, here = left[grown], right[grown], here[grown]
            feature[tree, here] = state[tree][3][best["tried"].to_numpy()[grown], grown]
            cut[tree, here] = best["cut"].to_numpy()[grown]
            gain[tree, here] = best["gain"].to_numpy()[grown]
            counts[tree, 2 * here + 1], counts[tree, 2 * here + 2] = left, right
            children = np.sort(np.concatenate([2 * here + 1, 2 * here + 2]))
            mixed = counts[tree, children].min(axis=1) > 0
            if level + 1 < depth and mixed.any():
                open_next[tree] = children[mixed]
        open_nodes = open_next
    return {"feature": feature, "cut": cut, "gain": gain, "counts": counts}


def node_rows(forest: dict[str, np.ndarray], cuts: list[np.ndarray], weights: np.ndarray) -> pa.Table:
    """The nodes as Spark ML stores them. Leaves of one parent that say the same become one."""
    feature, gain = forest["feature"].copy(), forest["gain"]
    stats = forest["counts"] * weights
    says = (stats[:, :, 1] > stats[:, :, 0]).astype(float)
    for node in reversed(range((feature.shape[1] - 1) // 2)):
        left, right = 2 * node + 1, 2 * node + 2
        same = (feature[:, left] < 0) & (feature[:, right] < 0) & (says[:, left] == says[:, right])
        feature[same, node] = -1
    there = np.zeros(feature.shape, bool)
    there[:, 0] = True
    for node in range((feature.shape[1] - 1) // 2):
        inner = there[:, node] & (feature[:, node] >= 0)
        there[:, 2 * node + 1] = there[:, 2 * node + 2] = inner
    number = there.cumsum(axis=1) - 1
    tree, node = np.nonzero(there)
    split = feature[tree, node]
    inner = split >= 0
    cut = forest["cut"][tree, node]
    child = np.where(inner, 2 * node + 1, 0)
    size = stats[tree, node].sum(axis=1)
    shares = np.divide(stats[tree, node], size[:, None], where=size[:, None] > 0,
                       out=np.zeros((len(node), 2)))
    ends = [cuts[f][c] if 0 <= f < len(cuts) else 0.5 for f, c in zip(split, cut)]
    return pa.table({
        "treeID": tree.astype(np.int32), "id": number[tree, node].astype(np.int32),
        "prediction": says[tree, node],
        "impurity": np.where(size > 0, 1.0 - (shares ** 2).sum(axis=1), 0.0),
        "stats0": stats[tree, node, 0], "stats1": stats[tree, node, 1],
        "rawCount": forest["counts"][tree, node].sum(axis=1),
        "gain": np.where(inner, gain[tree, node], -1.0),
        "leftChild": np.where(inner, number[tree, child], -1).astype(np.int32),
        "rightChild": np.where(inner, number[tree, child + inner], -1).astype(np.int32),
        "featureIndex": split.astype(np.int32), "end": np.array(ends, float),
    })


def as_model(
    spark: SparkSession, nodes: pa.Table, n_features: int, settings: RandomForestClassifier
) -> RandomForestClassificationModel:
    """The nodes as a fitted forest, through a folder as Spark ML writes and reads it."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    trees = settings.getNumTrees()
    of_trees = ("featuresCol", "labelCol", "weightCol", "maxDepth", "minInstancesPerNode", "seed")

    def params(found, names=None):
        return {p.name: v for p, v in found.items() if names is None or p.name in names}

    def described(kind, uid, own, default, **more):
        return json.dumps({
            "class": f"org.apache.spark.ml.classification.{kind}", "uid": uid,
            "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "paramMap": own, "defaultParamMap": default, **more,
        })

    whole = described(
        "RandomForestClassificationModel", settings.uid, params(settings._paramMap),
        params(settings._defaultParamMap), numFeatures=n_features, numClasses=2, numTrees=trees,
    )
    each = [
        (k, described("DecisionTreeClassificationModel", f"dtc_{settings.uid}_{k}",
                      params(settings._paramMap, of_trees), {}), 1.0)
        for k in range(trees)
    ]
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(
        f"{path}/treesMetadata"
    )
    inner = F.col("featureIndex") >= 0
    spark.createDataFrame(nodes).select("treeID", F.struct(
        "id", "prediction", "impurity", F.array("stats0", "stats1").alias("impurityStats"),
        "rawCount", "gain", "leftChild", "rightChild",
        F.struct(
            "featureIndex",
            F.when(inner, F.array("end")).otherwise(F.array().cast("array<double>"))
            .alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories"),
        ).alias("split"),
    ).alias("nodeData")).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
