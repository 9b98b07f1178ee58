from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cargolens.llm import periodic_runs as runs, queries
from cargolens.llm.suffix_tree import SuffixTree


def all_runs(sequence, least=12):
    """Runs by comparing the sequence with itself at every distance."""
    numbers: dict = {}
    a = np.array([numbers.setdefault(x, len(numbers)) for x in sequence], dtype=int)
    found: dict = {}
    for p in range(1, len(a) // 2 + 1):
        equal = np.concatenate([[False], a[p:] == a[:-p], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + p
            if length >= max(least, 2 * p):
                found.setdefault((start, length), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def _periodic(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = _periodic(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    found = all_runs(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
    )


@pytest.mark.parametrize("least", [2, 3, 12])
def test_all_runs_of_random_sequences(least):
    rnd = random.Random(least)
    for _ in range(400):
        n, letters = rnd.randint(0, 70), rnd.randint(1, 4)
        sequence = [rnd.randint(1, letters) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 10)
            sequence = [sequence[i] if i < a else sequence[a + (i - a) % p] for i in range(n)]
        assert runs.lyndon_runs(sequence, least) == all_runs(sequence, least)
        words = [b"%d" % x for x in sequence]
        assert runs.word_runs(words, least) == all_runs(sequence, least)


def test_extensions_match_letter_by_letter():
    rnd = random.Random(7)
    sequence = [rnd.randint(1, 2) for _ in range(120)]
    tree = SuffixTree(sequence)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120)))
    i, j = i[i < j], j[i < j]
    for a, b, n in zip(i.tolist(), j.tolist(), tree.extensions(i, j).tolist()):
        same = 0
        while b + same < 120 and sequence[a + same] == sequence[b + same]:
            same += 1
        assert n == same
    assert np.argsort(tree.rank).tolist() == sorted(range(121), key=lambda k: sequence[k:])


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    short = [r for r in rows if len((r.text or "").split()) < 4000]
    assert len(short) > 0.9 * len(rows) and len(found) == len(rows)
    assert {expected(r.doc_id, r.text) for r in short} <= found


def test_edge_rows(spark):
    period = " ".join(f"w{k}" for k in range(5000))
    rows = [
        (1, "x", None), (2, "x", ""), (3, "x", " \t\n"), (None, "x", "a " * 12), (None, "x", "a " * 12),
        (5, "x", "ä\x0bb " * 6), (5, "x", "a b " * 5), (6, "x", f"{period} {period}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, runs string, text string")
    found = runs.periodic_runs(docs).collect()
    # Eleven or fewer words are no run; columns named like the result's are ignored.
    spans = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed[:5]) for r in found]
    assert sorted(spans, key=repr) == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 12, 1)], "a"), (None, [(0, 12, 1)], "a"),
        (5, [(0, 12, 2)], "ä b"), (5, [], "a b a"), (6, [(0, 10000, 5000)], "w0 w1"),
    ], key=repr)
    assert found[-1].collapsed == period
    assert runs.periodic_runs(docs.limit(0)).count() == 0
