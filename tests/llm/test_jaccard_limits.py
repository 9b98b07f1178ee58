from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cargolens.llm import components, jaccard_join, storage


def test_low_thresholds_are_refused(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d e")], "doc_id long, text string"
    )
    with pytest.raises(ValueError):
        jaccard_join.similar_groups(docs, percent=50)
    found = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs, percent=51).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_frequent_shingles_have_a_place_however_small_their_share(spark):
    """Ten of more than a hundred million shingles are a long list all the same."""
    rows = [(115_000_000, None, None), (None, 7, 10), (None, 7, 30), (None, 5, 10), (None, 3, 2)]
    found = spark.createDataFrame(rows, "n long, shingle long, repeats long")
    shingles, places = jaccard_join._frequent(found)
    assert dict(zip(shingles.tolist(), places.tolist(), strict=True)) == {5: 1, 7: 2}


def test_shingles_that_repeat_in_a_task_are_counted(spark):
    texts = ["a b c d e f", "a b c d e g", "h i j k l"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = jaccard_join._profiles(rows).filter("shingle IS NOT NULL").collect()
    assert [r.repeats for r in found] == [2]


def test_components_of_few_and_many_edges(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(20)] + [(30, 32), (31, 32), (40, 40), (50, None)]
    frame = spark.createDataFrame(edges, "a long, b long")
    expected = {k: 0 for k in range(21)} | {30: 30, 31: 30, 32: 30}
    for most in (components.BROADCAST_ROWS, 0):
        monkeypatch.setattr(components, "BROADCAST_ROWS", most)
        found = components.connected_components(frame).collect()
        assert len(found) == len(expected) and {r.node: r.component for r in found} == expected
    assert components.connected_components(frame.limit(0)).count() == 0


def test_sums_are_seen_while_a_table_is_written(spark):
    for rows, n, most in (([(1,), (5,)], 2, 5), ([], 0, None)):
        frame = spark.createDataFrame(rows, "x long").distinct()
        table, seen = storage.observed(frame, "seen", n=F.count(F.lit(1)), most=F.max("x"))
        assert table.count() == n and seen == {"n": n, "most": most}
