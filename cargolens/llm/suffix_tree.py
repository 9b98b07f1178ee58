"""Suffix trees of number sequences and longest common extensions in constant time."""

from __future__ import annotations

import numpy as np


def _ukkonen(text: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Edges (parent * width + first number -> child) and the span of text on each edge.

    ``text`` ends with a number that occurs once. Ukkonen's algorithm: one pass from left to right
    with an active point (``node``, ``edge``, ``length``) and suffix links.
    """
    n, width = len(text), max(text) + 1
    edges: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = pending = 0
    for i, c in enumerate(text):
        pending += 1
        last = 0
        while pending:
            if not length:
                edge = i
            key = node * width + text[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[child]
                span = end[child] - first
                if length >= span:
                    node = child
                    edge += span
                    length -= span
                    continue
                if text[first + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                edges[key] = middle
                start += (first, i)
                end += (first + length, n)
                link += (0, 0)
                edges[middle * width + c] = middle + 1
                edges[middle * width + text[first + length]] = child
                start[child] = first + length
                if last:
                    link[last] = middle
                last = middle
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return edges, start, end, width


class SuffixTree:
    """The suffix tree of a sequence of positive numbers, toured once.

    An Euler tour passes the leaves in the order of their suffixes, the shorter of two equal
    beginnings first. Of the nodes it visits between two neighbouring leaves only the shallowest,
    their lowest common ancestor, can be that of any two leaves, so one depth per pair of
    neighbours is kept; minima over runs of powers of two then answer each query by two look-ups.
    """

    def __init__(self, sequence: list[int]):
        text = [*sequence, 0]
        self.size = len(text)
        edges, start, end, width = _ukkonen(text)
        order, between = self._tour(edges, start, end, width)
        #: Place of each suffix among all, the empty one included.
        self.rank = np.empty(self.size, np.int32)
        self.rank[order] = np.arange(self.size, dtype=np.int32)
        self._minima = [np.array(between, np.int32)]
        reach = 1
        while 2 * reach <= self.size:
            row = self._minima[-1]
            self._minima.append(np.minimum(row[:-reach], row[reach:]))
            reach *= 2

    def _tour(self, edges, start, end, width) -> tuple[list[int], list[int]]:
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        below = np.fromiter(edges.values(), np.int64, len(edges))
        by_key = np.argsort(keys)
        keys, children = keys[by_key], below[by_key].tolist()
        bounds = np.searchsorted(keys, np.arange(len(start) + 1, dtype=np.int64) * width).tolist()
        size, depth_at = self.size, [0] * len(start)
        order, between = [], []
        low = size
        todo = [(0, 0)]  # a node and the depth its edge hangs from
        while todo:
            node, above = todo.pop()
            if above < low:
                low = above
            depth = depth_at[node] = above + end[node] - start[node]
            at, to = bounds[node], bounds[node + 1]
            if at == to:
                order.append(size - depth)
                between.append(low)
                low = size
            else:
                todo += [(children[k], depth) for k in range(to - 1, at - 1, -1)]
        return order, between

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at ``i`` and at ``j`` have in common; ``i`` is not ``j``."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int32)
        for k in np.unique(level):
            here = level == k
            row = self._minima[k]
            found[here] = np.minimum(row[low[here]], row[high[here] - (1 << int(k))])
        return found
