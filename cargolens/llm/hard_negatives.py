"""Hard negatives of anchors: exact integer scores behind angular triangle bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cargolens.llm.storage import written

#: Anchors go to the tasks in blocks of about this many bytes, whatever their number.
BLOCK_BYTES = 16 * 2**20
#: Rows of a task are scored in slices of about this many bytes.
SLICE_BYTES = 4 * 2**20
#: Reference directions: mean directions of the most frequent labels.
REFERENCES = 16
_EXACT = 2.0**52  # inner products below this are exact in double precision
_LIMIT = 2**63 - 1


def quantized(embeddings: DataFrame, scale: int = 256, id_column: str = "vec_id",
              label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, components as ``floor(scale * x)``.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no
    part. An empty vector is the zero vector.
    """
    x = F.col(vector_column)
    rows = embeddings.filter(
        F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull()
        & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    return rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("vector"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers; missing components are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    full = np.zeros((len(column), dim), np.int64)
    full[np.arange(dim) < sizes[:, None]] = flat
    return full


def _angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1))


def _references(rows: DataFrame, dim: int, most: int = REFERENCES) -> np.ndarray:
    """Mean directions of the ``most`` most frequent labels, at most that many rows."""
    frequent = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most)
    sums = (
        rows.join(F.broadcast(frequent.select("label")), "label")
        .select("label", F.posexplode("vector"))
        .groupBy("label", "pos").agg(F.sum(F.col("col").cast("double")).alias("total"))
        .orderBy("label", "pos").collect()
    )
    labels = {label: k for k, label in enumerate(dict.fromkeys(r["label"] for r in sums))}
    found = np.zeros((max(len(labels), 1), max(dim, 1)))
    for r in sums:
        found[labels[r["label"]], r["pos"]] = r["total"]
    return found / np.maximum(np.linalg.norm(found, axis=1), 1e-300)[:, None]


def _with_angles(rows: DataFrame, dim: int, references: np.ndarray) -> DataFrame:
    """The rows with ``norm`` and ``angles`` to the reference directions, stored once."""
    shared = rows.sparkSession.sparkContext.broadcast(references)

    def task(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dim).astype(np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            angles = _angles(vectors, norms, shared.value) if dim else np.zeros((len(norms), 1))
            flat = pa.array(angles.ravel())
            lists = pa.ListArray.from_arrays(
                np.arange(0, angles.size + 1, angles.shape[1], dtype=np.int32), flat
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norms), lists], [*batch.schema.names, "norm", "angles"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(task, f"{fields}, norm double, angles array<double>")


def score_bounds(angles: np.ndarray, norms: np.ndarray, angle: np.ndarray,
                 norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row with one anchor, by the angles' triangles.

    With angles s and t to one direction, the angle between two vectors lies between |s - t| and
    min(s + t, 2 pi - s - t); the narrowest interval over all directions counts. Bounds are
    widened beyond what rounding of angles (about 1e-8) and cosines can take away.
    """
    apart = np.abs(angles - angle).max(axis=1)
    around = angles + angle
    together = np.minimum(around, 2 * np.pi - around).min(axis=1)
    product = norms * norm
    room = product * 1e-6 + 1
    found = np.cos(together) * product - room, np.cos(apart) * product + room
    return tuple(np.clip(bound, -float(_LIMIT), float(_LIMIT)) for bound in found)


def _scores(vectors: np.ndarray, norms: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products: doubles while all sums are whole below 2^52, else Python's integers."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    if norms.max() * norm < _EXACT:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    exact = vectors.astype(object) @ anchor.astype(object)
    return np.array([min(max(s, -_LIMIT), _LIMIT) for s in exact.tolist()], np.int64)


class _Best:
    """The first ``most`` rows by score, largest first, then id, of those offered so far."""

    __slots__ = ("scores", "ids", "most")

    def __init__(self, most: int):
        self.scores = self.ids = np.zeros(0, np.int64)
        self.most = most

    @property
    def least(self) -> float:
        """A score below this cannot enter."""
        return self.scores[-1] if len(self.scores) == self.most else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        entering = scores >= self.least
        scores = np.concatenate([self.scores, scores[entering]])
        ids = np.concatenate([self.ids, ids[entering]])
        first = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[first], ids[first]


def _sliced(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    step = max(SLICE_BYTES // (8 * max(dim, 1)), 64)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            angles = part.column("angles")
            yield (
                part.column("vec_id").to_numpy(), np.array(part.column("label").to_pylist()),
                _matrix(part.column("vector"), dim), part.column("norm").to_numpy(),
                angles.flatten().to_numpy().reshape(len(angles), -1),
            )


def _best_rows(rows: DataFrame, block: list, dim: int, most: int, same_label: bool,
               percent: tuple[int, int] | None) -> DataFrame:
    """Per task: the best rows of each target of each anchor of a block.

    A target is a window of scores, ``least`` to ``greatest``; without ``percent`` it is open.
    Only rows whose bounds overlap a window, and reach the worst row of a full list, are scored.
    """
    anchors = [
        (a["anchor"], a["vec_id"], a["label"], np.array(a["vector"] + [0] * (dim - len(a["vector"]))),
         a["norm"], np.array(a["angles"]), a["targets"])
        for a in block
    ]
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def windows(target: int | None) -> tuple[int, int]:
        if percent is None:
            return -_LIMIT, _LIMIT
        # The least and greatest whole score within the stated shares of the target's.
        return -(-percent[0] * target // 100), percent[1] * target // 100

    def task(batches):
        state = [
            [(*windows(t), _Best(most)) for t in targets]
            for _, _, _, _, _, _, targets in shared.value
        ]
        for ids, labels, vectors, norms, angles in _sliced(batches, dim):
            for (_, own, label, vector, norm, angle, _), lists in zip(shared.value, state):
                wanted = (labels == label) == same_label
                if same_label:
                    wanted &= ids != own
                low, high = score_bounds(angles, norms, angle, norm)
                overlap = np.zeros(len(ids), bool)
                for least, greatest, best in lists:
                    overlap |= (high >= max(least, best.least)) & (low <= greatest)
                chosen = np.flatnonzero(wanted & overlap)
                scores = _scores(vectors[chosen], norms[chosen], vector, norm)
                for least, greatest, best in lists:
                    inside = (scores >= least) & (scores <= greatest)
                    if inside.any():
                        best.offer(scores[inside], ids[chosen[inside]])
        found = [
            (anchor[0], place, best.ids[k], best.scores[k])
            for anchor, lists in zip(shared.value, state)
            for place, (_, _, best) in enumerate(lists) for k in range(len(best.ids))
        ]
        columns = list(zip(*found)) if found else [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)],
            ["anchor", "place", "found_id", "score"],
        )

    return rows.mapInArrow(task, "anchor long, place int, found_id long, score long")


def _all_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, dim: int, most: int,
                same_label: bool, percent: tuple[int, int] | None, label: str) -> DataFrame:
    """Best rows of all anchors, block by block, ranked over all tasks; a written table."""
    place = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id")
    found = None
    for k in range(blocks):
        block = anchors.filter(F.col("block") == k).collect()
        if not block and blocks > 1:
            continue
        best = _best_rows(rows, block, dim, most, same_label, percent)
        best = best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
        best = written(best, label)
        found = best if found is None else found.union(best)
    return found


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                   percent: tuple[int, int] = (80, 100), references: int = REFERENCES) -> DataFrame:
    """Hard negatives ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are ``vec_id, label, vector`` as ``quantized`` gives them. Scores are inner products;
    higher ones come first, ties by smaller id. An anchor's positives are its first ``positives``
    other rows of its label; a positive's negatives are the first ``negatives`` rows of other labels
    whose score lies within ``percent`` of the positive's (so none at a negative score).

    Rows stay where they are: each task takes a block of anchors, bounded in bytes, over its rows
    and hands on its best few per window. Rows that repeat count as rows; rows of an anchor's own
    id are not its positives; anchors equal in id, label and vector are one anchor, those equal in
    id alone are several. A shorter vector ends in zeros. Scores beyond 64 bits count as the limit.
    No rows or no anchors give no result.
    """
    rows = written(rows.select("vec_id", "label", "vector"), "vectors")
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = written(_with_angles(rows, dim, _references(rows, dim, references)), "angles")
    anchors = rows.filter(is_anchor).dropDuplicates(["vec_id", "label", "vector"])
    weight = 8 * (dim + references + 4 + positives)
    blocks = -(-anchors.count() * weight // BLOCK_BYTES) or 1
    anchors = written(anchors.select(
        F.xxhash64("vec_id", "label", "vector").alias("anchor"), "*"
    ).withColumn("block", F.pmod("anchor", F.lit(blocks))), "anchors")

    open_ = anchors.withColumn("targets", F.array(F.lit(None).cast("long")))
    near = _all_blocks(rows, open_, blocks, dim, positives, True, None, "positives")
    targets = near.groupBy("anchor").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda t: t["score"])
        .alias("targets")
    )
    aimed = written(anchors.join(targets, "anchor"), "targets")
    hard = _all_blocks(rows, aimed, blocks, dim, negatives, False, percent, "negatives")
    near = near.select(
        "anchor", (F.col("rank") - 1).alias("place"), F.col("found_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return hard.join(near, ["anchor", "place"]).join(anchors.select("anchor", "vec_id"), "anchor").select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank",
        F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
