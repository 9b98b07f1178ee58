"""Quality by nearest labelled neighbours among latent-semantic vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cargolens.llm.exact_dedup import lower_ascii
from cargolens.llm.storage import written

#: Terms of the vector space: the most frequent ones, by documents that hold them.
TERMS = 4096
#: Labelled rows the space is fitted on and that vote, drawn by a hash: bounds the broadcast.
FIT_ROWS = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
_DOCS_AT_ONCE = 256
_FLUSH_TERMS = 500_000
_REPEAT_SHARES = (5, 20, 50)
_SEED = 1
#: Letters of a word's shape: capital, small letter, digit; other ASCII signs stand for themselves.
_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else
    b if b < 128 and not 97 <= b <= 122 else ord("a")
    for b in range(256)
)


def _shapes(text: bytes) -> list[bytes]:
    """The words' shapes, with one letter per stretch of capitals, small letters or digits."""
    text = text.translate(_SHAPE)
    for letter in (b"a", b"A", b"0"):
        while letter * 2 in text:
            text = text.replace(letter * 2, letter)
    return text.split()


def term_counts(text: bytes | None) -> Counter:
    """The terms of a whole text and their counts.

    Terms are lower-cased words, with a word like the one before counted under ``=`` instead,
    shapes of words after ``~``, and one more ``=`` term per share of repeats that is reached.
    """
    words = lower_ascii(text or b"").split()
    found = Counter([w for w, before in zip(words, [b"", *words]) if w != before])
    again = len(words) - found.total()
    for shape, n in Counter(_shapes(text or b"")).items():
        found[b"~" + shape] += n
    if again:
        found[b"="] += again
        for percent in _REPEAT_SHARES:
            if 100 * again >= percent * len(words):
                found[b"=%d" % percent] += again
    return found


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, n_docs`` over all documents; a task sums up what it has before it hands it on."""

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
            ["term", "n"],
        )

    def task(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(term_counts(text).keys())
                if len(counts) >= _FLUSH_TERMS:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    counted = docs.select("text").mapInArrow(task, "term binary, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_docs"))


def _weights(texts: Iterable[bytes | None], place: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """One row of unit length per text: (1 + log n) times the term's weight."""
    texts = list(texts)
    found = np.zeros((len(texts), len(idf)), np.float32)
    for row, text in zip(found, texts):
        pairs = [(place[t], n) for t, n in term_counts(text).items() if t in place]
        if pairs:
            at, n = zip(*pairs)
            row[list(at)] = 1 + np.log(n)
    found *= idf
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(length > 0, length, 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(length > 1e-6, vectors / np.maximum(length, 1e-6), 0).astype(np.float32)


def latent_space(weights: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors as columns, by subspace iteration from a fixed start."""
    k = min(dimensions, *weights.shape)
    start = np.random.default_rng(_SEED).standard_normal((weights.shape[1], k + 8))
    basis = np.linalg.qr(start)[0].astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(weights.T @ (weights @ basis))[0]
    _, _, turn = np.linalg.svd(weights @ basis, full_matrices=False)
    return np.ascontiguousarray(basis @ turn[:k].T, dtype=np.float32)


def _fitted(sample: DataFrame, place: dict[bytes, int], idf: np.ndarray, dimensions: int) -> DataFrame:
    """``space, vectors, quality``: one row, fitted in one task on at most ``FIT_ROWS`` rows."""
    shared = sample.sparkSession.sparkContext.broadcast((place, idf))

    def task(batches):
        place, idf = shared.value
        texts, quality = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            quality += batch.column("quality").to_pylist()
        space, vectors = np.zeros((len(idf), 0), np.float32), np.zeros((len(texts), 0), np.float32)
        if texts and len(idf):
            weights = _weights(texts, place, idf)
            space = latent_space(weights, dimensions)
            vectors = _unit(weights @ space)
        yield pa.RecordBatch.from_arrays(
            [pa.array([space.tobytes()]), pa.array([vectors.tobytes()]),
             pa.array([quality], pa.list_(pa.float64()))], ["space", "vectors", "quality"],
        )

    gathered = sample.select("text", "quality").coalesce(1)
    return gathered.mapInArrow(task, "space binary, vectors binary, quality array<double>")


def votes(cosines: np.ndarray, quality: np.ndarray, neighbours: int) -> np.ndarray:
    """Per row, the labels of the most similar ones, weighted by cosines above zero.

    Rows like nothing get the share of label 1.
    """
    share = float(quality.mean()) if len(quality) else 0.5
    if not cosines.size:
        return np.full(len(cosines), share)
    k = min(neighbours, cosines.shape[1])
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, nearest, axis=1).astype(np.float64), 0) ** 4
    total = weight.sum(axis=1)
    voted = (weight * quality[nearest]).sum(axis=1)
    return np.where(total > 1e-9, voted / np.maximum(total, 1e-9), share)


def neighbour_vote(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None,
                   terms: int = TERMS, fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS,
                   neighbours: int = NEIGHBOURS, text_column: str = "text") -> DataFrame:
    """``doc_id, score`` of every document: the similarity-weighted vote of labelled neighbours.

    ``labels`` are ``doc_id, quality`` (0 or 1); ``learn_from`` is a condition on ``doc_id`` for
    rows to learn from. Terms are counted over all documents and the ``terms`` most frequent
    span the space (ties by term), weighted by inverse document frequency. At most ``fit_rows``
    labelled documents, drawn by a hash of id and text, give the latent space and the voters, which
    go to all tasks; every document's cosines to all voters are computed in blocks, exactly.

    Null and empty texts, and texts without a known term, score the voters' share of label 1, or
    0.5 without voters. An id with several labels counts with their mean; null labels and labels of
    no document count for nothing. Repeated ids and rows are scored each on its own; only
    ``doc_id``, the text and ``quality`` are read, whatever other columns are called. Scores are
    rounded to six places.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text_column).cast("binary").alias("text"))
    spark = docs.sparkSession
    frequent = (
        document_frequencies(rows).orderBy(F.desc("n_docs"), "term").limit(terms).collect()
    )
    place = {bytes(r["term"]): k for k, r in enumerate(frequent)}
    n_docs = np.array([r["n_docs"] for r in frequent], np.float64)
    idf = (np.log((1 + rows.count()) / (1 + n_docs)) + 1).astype(np.float32)

    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = rows.join(F.broadcast(written(known, "voters")), "doc_id")
    # An id may repeat, so the rows are bounded once more.
    sample = sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(fit_rows)
    model = written(_fitted(sample, place, idf, dimensions), "latent").first()
    quality, vectors = np.zeros(0), np.zeros((0, 0), np.float32)
    space = np.zeros((len(idf), 0), np.float32)
    if model is not None and len(model["space"]):
        quality = np.array(model["quality"])
        space = np.frombuffer(model["space"], np.float32).reshape(len(idf), -1)
        vectors = np.frombuffer(model["vectors"], np.float32).reshape(len(quality), -1)
    shared = spark.sparkContext.broadcast((place, idf, space, vectors, quality))

    def task(batches):
        place, idf, space, vectors, quality = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(at, _DOCS_AT_ONCE)
                own = _unit(_weights(part.column(1).to_pylist(), place, idf) @ space)
                cosines = own @ vectors.T if len(vectors) else np.zeros((part.num_rows, 0))
                found = np.clip(votes(cosines, quality, neighbours), 0, 1).round(6)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.float64())], ["doc_id", "score"]
                )

    return rows.mapInArrow(task, f"doc_id {id_type}, score double")
