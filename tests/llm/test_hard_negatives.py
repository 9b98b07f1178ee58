from __future__ import annotations

import numpy as np
from compare import differences, duck
from pyspark.sql import functions as F

from cargolens.llm import hard_negatives as hard, queries
from cargolens.llm.oracle import ORACLE_SQL


def brute(rows, anchors, positives=5, negatives=5, least=80, most=100):
    found = []
    score = lambda a, b: min(sum(x * y for x, y in zip(a[2], b[2])), hard._LIMIT)
    for a in {tuple(map(repr, r)): r for r in anchors}.values():
        others = [(-score(a, r), r[0], r[1]) for r in rows]
        near = sorted(o for o in others if o[2] == a[1] and o[1] != a[0])[:positives]
        for p, positive_id, _ in near:
            window = sorted(o[:2] for o in others
                            if o[2] != a[1] and least * -p <= 100 * -o[0] <= most * -p)
            for k, (n, negative_id) in enumerate(window[:negatives]):
                found.append((a[0], positive_id, k + 1, negative_id, -p, -n))
    return sorted(found)


def _result(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_query_equals_sql(spark, sf):
    frame = queries.op12_hard_negatives(spark, sf)
    assert differences(frame, duck(sf), ORACLE_SQL["op12_hard_negatives"]) is None


def test_clustered_rows_in_many_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((4, 6)) * 40
    rows = [
        (k, int(k % 3), [int(x) for x in centres[k % 4] + rnd.integers(-9, 9, 6)])
        for k in range(400)
    ]
    rows += [(1000 + k, 1, rows[5][2]) for k in range(60)]  # one common vector
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    monkeypatch.setattr(hard, "BLOCK_BYTES", 2000)
    found = hard.hard_negatives(frame.repartition(5), F.col("vec_id") % 9 == 0)
    assert _result(found) == brute(rows, [r for r in rows if r[0] % 9 == 0])


def test_bounds_hold_every_score_and_leave_out_most_of_other_clusters():
    rnd = np.random.default_rng(5)
    vectors = np.floor(rnd.standard_normal((500, 8)) * 100 + 300 * np.eye(8)[np.arange(500) % 8])
    norms = np.linalg.norm(vectors, axis=1)
    angles = hard._angles(vectors, norms, np.eye(8))
    scores = vectors @ vectors[0]
    low, high = hard.score_bounds(angles, norms, angles[0], norms[0])
    assert (low <= scores).all() and (scores <= high).all()
    assert high[0] - scores[0] < 1e-5 * scores[0] + 2
    assert (high < np.sort(scores)[-5]).mean() > 0.3


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0], "x"), (0, 1, [1.0, 2.0], "x"), (0, 1, [2.0, 2.0], "x"),
        (1, 1, [1.0, 1.0], "x"), (2, 2, [1.0, 1.0], "x"), (3, 2, [1.0, 0.95], "x"), (4, 2, [], "x"),
        (5, 1, [1.5], "x"), (5, 1, [1.5], "x"), (6, 2, [1e30, 1e30], "x"), (None, 2, [1.0, 1.0], "x"),
        (7, None, [1.0, 1.0], "x"), (8, 2, None, "x"), (9, 2, [nan, 1.0], "x"), (10, 2, [inf, 1.0], "x"),
        (11, 2, [None, 1.0], "x"), (12, 2, [-1.0, -1.0], "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank string")
    whole = hard.quantized(frame)
    parts = [(r.vec_id, r.label, list(r.vector)) for r in whole.collect()]
    assert sorted({r[0] for r in parts}) == [0, 1, 2, 3, 4, 5, 6, 12]
    padded = [(i, n, v + [0] * (2 - len(v))) for i, n, v in parts]
    found = hard.hard_negatives(whole, F.col("vec_id") % 3 == 0)
    assert _result(found) == brute(padded, [r for r in padded if r[0] % 3 == 0])
    assert hard.hard_negatives(whole.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    assert hard.hard_negatives(whole, F.lit(False)).count() == 0
