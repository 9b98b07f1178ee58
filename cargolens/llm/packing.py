"""Packing of token sequences by the sum-of-squares rule (Csirik et al., J. ACM 2006)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargolens.llm.public_bpe import TEXTS_AT_ONCE, id_bytes, shared_vocabulary
from cargolens.llm.storage import written

CAPACITY = 2048
SEPARATOR = 0
GROUP_PIECES = 131_072  # pieces that one task packs
PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): documents as token pieces.

    A document is its text's ids and one separator. Those longer than ``capacity`` are cut into
    pieces of that length; only the first may be shorter. Null text counts as empty, which gives
    the separator alone. Null and repeated ids are ids like others.
    """
    ids = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = ids.schema["doc_id"].dataType.simpleString()
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    separator = np.array([SEPARATOR], dtype="<u4").tobytes()

    def cut(batches):
        encode = id_bytes(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                names, rows = [], []
                encoded = encode([t or "" for t in part.column(1).to_pylist()])
                for row, raw in enumerate(encoded):
                    raw += separator
                    n = len(raw) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        own = raw[4 * start : 4 * (start + length)]
                        names.append(row)
                        rows.append((piece, start, length, zlib.crc32(own), own))
                        start, piece = start + length, piece + 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                found = ["piece", "start", "length", "ids_crc32", "ids"]
                wide = len(found) if with_ids else 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(names)), *arrays[:wide]],
                    ["doc_id", *found[:wide]],
                )

    return ids.mapInArrow(cut, f"doc_id {id_type}, {PIECES}" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed longest first.

    Among the open bins an item fits, it goes to one of that gap for which the sum over gaps of
    (open bins with the gap) squared becomes smallest; of equal choices the smallest gap wins. A
    bin is opened where no open one has room. Full bins leave the sum.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    n_bins = 0
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        gaps = count[size:capacity]
        usable = np.flatnonzero(gaps)
        if len(usable):
            # (N[g]-1)^2 - N[g]^2 + (N[g-s]+1)^2 - N[g-s]^2; a full bin has no second part
            change = 2 * (count[usable] - gaps[usable]) + 2
            if usable[0] == 0:
                change[0] = 1 - 2 * gaps[0]
            gap = size + int(usable[change.argmin()])
            own = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, own = capacity, n_bins
            n_bins += 1
        bins[item], offsets[item] = own, capacity - gap
        if gap > size:
            open_bins[gap - size].append(own)
            count[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; a sequence holds at most ``capacity`` tokens.

    ``pieces`` is a written table with a column ``length`` of 1 to ``capacity``; all its columns
    are returned. Full pieces are sequences of their own. The others are dealt by their place in
    the table over tasks of about ``group_pieces``, enough of every length to leave a few open
    bins per task, and each task packs its own by ``sum_of_squares``. Equal rows are packed each.
    """
    numbered = pieces.withColumn("sequence_id", F.monotonically_increasing_id())
    whole = numbered.filter(F.col("length") >= capacity).select(
        "*", F.lit(0).cast("long").alias("offset")
    )
    rest = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "sequence_id"], ascending=[False, True])
        own, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        # A bin is named after the lowest number among its rows, which no other row has.
        number = frame["sequence_id"].groupby(own).transform("min")
        return frame.assign(sequence_id=number, offset=offset).drop(columns="_llm_group")

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields]
    dealt = rest.withColumn("_llm_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    found = dealt.groupBy("_llm_group").applyInPandas(packed, ", ".join([*columns, "`offset` long"]))
    return found.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all documents.

    Null and empty texts are one separator; an empty table gives an empty result; other columns
    are ignored. See ``token_pieces`` and ``pack``.
    """
    pieces = token_pieces(docs, vocabulary, capacity, id_column, text_column)
    return pack(written(pieces, "pieces"), capacity)
