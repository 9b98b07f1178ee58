"""Periodic runs of words: stretches that repeat themselves, found from Lyndon roots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargolens.llm.suffix_tree import SuffixTree

LEAST_LENGTH = 12
_TEXTS_AT_ONCE = 256
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F],
    dtype=np.uint64,
)


def _next_below(rank: list[int]) -> list[int]:
    """For each place the next one of a smaller rank, the sequence's end if there is none."""
    n = len(rank)
    found = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, rank[i]
        while j < n and rank[j] > own:
            j = found[j]
        found[i] = j
    return found


def lyndon_runs(sequence: list[int], least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """All maximal runs ``(start, length, period)`` of a sequence of positive numbers, by start.

    Every run holds a root that is the longest Lyndon word from its first place, under the order of
    the numbers or under the opposite one (Bannai et al., The "Runs" Theorem). Ranks of suffixes
    give these words; a tree of the sequence extends each root to the right, a tree of its
    reversal to the left. Kept are runs of ``least`` numbers and two periods.
    """
    n = len(sequence)
    if n < max(least, 2):
        return []
    tree, backward = SuffixTree(sequence), SuffixTree(sequence[::-1])
    rank = tree.rank[:n]
    place = np.arange(n)
    smaller = np.array(_next_below(rank.tolist()))
    larger = np.array(_next_below((n + 1 - rank).tolist()))
    # A run that ends with the sequence has a root under the order where the end is smallest.
    inside = larger < n
    i = np.concatenate([place, place[inside]])
    j = np.concatenate([smaller, larger[inside]])
    right = np.zeros(len(i), np.int64)
    right[j < n] = tree.extensions(i[j < n], j[j < n])
    left = np.zeros(len(i), np.int64)
    left[i > 0] = backward.extensions(n - i[i > 0], n - j[i > 0])
    start, period = i - left, j - i
    length = j + right - start
    kept = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start[kept], length[kept], period[kept]], axis=1), axis=0)
    return sorted(map(tuple, found.tolist()), key=lambda run: (run[0], run[2]))


def _repeated_stretches(hashes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of places that are covered by windows of ``width`` occurring twice or more."""
    n = len(hashes) - width + 1
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = windows * _ODD[k % len(_ODD)] + hashes[k : k + n]
        windows ^= windows >> np.uint64(29)
    by_value = np.argsort(windows, kind="stable")
    ordered = windows[by_value]
    equal = ordered[1:] == ordered[:-1]
    if not equal.any():
        return []
    again = np.zeros(n, bool)
    again[by_value[1:][equal]] = True
    again[by_value[:-1][equal]] = True
    change = np.zeros(len(hashes) + 1, np.int32)
    change[:n] += again
    change[width : width + n] -= again
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _candidate_stretches(hashes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches outside of which no word is in a run.

    A run has ``length - period >= least / 2``, so each of its words lies in a window of
    ``least // 2`` words that the run holds twice, one period apart. What no such window covers
    parts the text; the parts are taken again until they stay as they are. Windows whose hashes
    are equal by chance only widen a stretch.
    """
    width, found, open_ = max(least // 2, 1), [], [(0, len(hashes))]
    while open_:
        start, end = open_.pop()
        if end - start < max(least, 2):
            continue
        inner = _repeated_stretches(hashes[start:end], width)
        if inner == [(0, end - start)]:
            found.append((start, end))
        else:
            open_ += [(start + a, start + b) for a, b in inner]
    return sorted(found)


def word_runs(words: list[bytes], least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start, then period."""
    if len(words) < max(least, 2):
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = []
    for start, end in _candidate_stretches(hashes, least):
        numbers: dict[bytes, int] = {}
        sequence = [numbers.setdefault(w, len(numbers) + 1) for w in words[start:end]]
        found += [(start + s, length, p) for s, length, p in lyndon_runs(sequence, least)]
    return found


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs and in the first period of each, joined by one space."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of whole texts, one row per row.

    Words are runs without ASCII white space, compared byte for byte. ``runs`` holds ``start``
    (number of its first word), ``length`` and ``period`` of each maximal run of ``least`` words
    and two periods or more, by start, then period. ``collapsed`` is the text of the words that no
    run holds after its first period, joined by one space. A text is one row's work, in memory
    that grows with its longest stretch of repeated windows. Null and empty texts have no run and
    an empty collapsed text; null and repeated ids are returned as they are, each row on its own;
    other columns are ignored.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text")
    )
    run_type = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                runs, collapsed = [], []
                for text in part.column(1).to_pylist():
                    words = (text or b"").split()
                    found = word_runs(words, least)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    collapsed.append(without_repeats(words, found))
                texts = pa.array(collapsed, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(runs, run_type), texts],
                    ["doc_id", "runs", "collapsed"],
                )

    return rows.mapInArrow(
        task, f"doc_id {id_type}, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )
