"""Candidates among near copies grow with their number, not its square."""

from __future__ import annotations

import numpy as np

from cargolens.llm import jaccard_join


def test_pairs_of_near_copies_grow_in_proportion(spark, monkeypatch):
    tested = []
    near = jaccard_join._near

    def counted(pairs, classes, percent):
        tested[-1] += pairs.count()
        return near(pairs, classes, percent)

    monkeypatch.setattr(jaccard_join, "_near", counted)
    for copies in (300, 1200):
        rng = np.random.default_rng(copies)
        base, rows = [f"b{k}" for k in range(120)], []
        for k in range(copies):
            words = list(base)
            for _ in range(rng.integers(1, 6)):
                words[rng.integers(len(words))] = f"x{rng.integers(10**6)}"
            rows.append((k, " ".join(words)))
        tested.append(0)
        sets = [set(jaccard_join.shingle_set(t.encode()).tolist()) for _, t in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()}
        roots = list(range(copies))
        for a in range(copies):
            for b in range(a):
                if roots[a] != roots[b]:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        low, high = sorted((roots[a], roots[b]))
                        roots = [low if r == high else r for r in roots]
        assert got == dict(enumerate(roots))
    assert tested[1] <= 8 * tested[0]
