"""Exact duplicates by 128-bit content hash, with a comparison of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cargolens.llm.storage import written

SALTS = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(text: bytes) -> bytes:
    """A to Z in lower case, all other bytes as they are."""
    return text.translate(_LOWER)


def hash_128(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _normalised(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        raw = value.as_buffer()
        yield lower_ascii(raw.to_pybytes()) if raw is not None else b""


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[bytes], bytes] = hash_128,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A to Z. Documents are grouped by
    ``content_hash`` of that text, the one with the smallest id stays (``keep="largest"``: the
    largest), and the texts of a group are compared byte by byte: a hash that different texts
    share is split by the texts themselves.

    Null text counts as empty; empty texts are equal. A null id is smaller than all others.
    Rows that repeat id and text are all returned; each counts, and all with the kept id are
    kept. An empty table gives an empty result. Other columns are ignored.
    """
    ids = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = ids.schema["doc_id"].dataType.simpleString()

    def digests(batches):
        for batch in batches:
            texts = list(_normalised(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([content_hash(t) for t in texts], pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                ["doc_id", "content", "text_sha256"],
            )

    def texts(batches):
        for batch in batches:
            found = list(_normalised(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([content_hash(t) for t in found], pa.binary()),
                    pa.array([xxhash.xxh64_intdigest(str(i)) % SALTS
                              for i in batch.column(0)], pa.int32()),
                    pa.array(found, pa.binary()),
                ],
                ["content", "salt", "bytes"],
            )

    rows = written(
        ids.mapInArrow(digests, f"doc_id {id_type}, content binary, text_sha256 string"),
        "digests",
    )
    chosen = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    if keep == "smallest":  # min() passes over nulls
        chosen = F.when(F.count("doc_id") == F.count("*"), chosen)
    sizes = F.count("*").alias("group_size")
    groups = written(rows.groupBy("content").agg(chosen.alias("keep_id"), sizes), "groups")

    # Bytes: the smallest and largest text of a group differ if any two do. A hot group is
    # dealt over salts, so that no task reads all its texts.
    shared = groups.filter("group_size > 1").select(
        "content", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    extremes = [F.min("low").alias("low"), F.max("high").alias("high")]
    collisions = written(
        ids.mapInArrow(texts, "content binary, salt int, bytes binary")
        .join(shared, ["content", "salt"])
        .groupBy("content", "salt")
        .agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
        .groupBy("content")
        .agg(*extremes)
        .filter("low <> high")
        .select("content"),
        "collisions",
    )
    key = ["content"]
    if not collisions.isEmpty():
        # Different texts under one hash: their own digest of 256 bits joins the key.
        key = ["content", "text_sha256"]
        groups = written(rows.groupBy(*key).agg(chosen.alias("keep_id"), sizes), "groups")
    return rows.join(groups, key).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
