from __future__ import annotations

import zlib

import numpy as np

from cargolens.llm import latent_vote as vote, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op11_neighbour_vote(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 1000
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[k], q) for k, q in labels.items() if rows[k].held_out]
    good = np.mean([r.predicted for r, q in held if q == 1])
    junk = np.mean([1 - r.predicted for r, q in held if q == 0])
    assert good >= 0.95 and junk >= 0.9


def test_votes_by_hand():
    cosines = np.array([[1.0, 0.5, -1.0], [0.0, 0.0, 0.0], [-0.5, -0.1, -0.2]])
    quality = np.array([0.0, 1.0, 1.0])
    found = vote.votes(cosines, quality, 2)
    assert np.allclose(found, [0.5**4 / (1 + 0.5**4), 2 / 3, 2 / 3])


def test_space_keeps_products_of_low_rank():
    rnd = np.random.default_rng(0)
    weights = (rnd.standard_normal((60, 5)) @ rnd.standard_normal((5, 40))).astype(np.float32)
    space = vote.latent_space(weights, 5)
    assert np.allclose(space.T @ space, np.eye(5), atol=1e-4)
    assert np.allclose((weights @ space) @ (weights @ space).T, weights @ weights.T, atol=1e-2)


def test_terms():
    found = vote.term_counts(b"Aa aa AA. b&& b&&\n12 12 345")
    assert found[b"="] == found[b"=20"] == 3 and b"=50" not in found
    assert found[b"aa"] == 1 and found[b"aa."] == 1 and found[b"b&&"] == 1 and found[b"12"] == 1
    assert found[b"~a&&"] == 2 and found[b"~0"] == 3 and found[b"~Aa"] == 1
    assert not vote.term_counts(None) and not vote.term_counts(b" \n")


def test_labels_are_no_input_and_rows_without_labels_do_not_matter(spark):
    good, bad = "plain words in a row of text %d", "?? ?? %d ?? ??"
    docs = [(k, (good if k % 2 else bad) % k, "x") for k in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    rows = {r.doc_id: r.score for r in vote.neighbour_vote(frame, labels).collect()}
    assert min(rows[k] for k in range(1, 80, 2)) > 0.9 and max(rows[k] for k in range(0, 80, 2)) < 0.1
    more = labels.union(spark.createDataFrame([(999, 1), (None, 0), (5, None)], labels.schema))
    assert {r.doc_id: r.score for r in vote.neighbour_vote(frame, more).collect()} == rows


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "good text here"), (3, "good text here"), (None, "bad ?? text"),
         (4, "bad ?? text"), (5, "word " * 50_000)], "doc_id long, text string",
    )
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (4, None), (1, 1)], "doc_id long, quality int")
    found = {(r.doc_id, r.score) for r in vote.neighbour_vote(docs, labels).collect()}
    scores = dict(found)
    assert len(found) == 6 and all(0 <= s <= 1 for s in scores.values())
    assert scores[1] == scores[2] == 0.5  # four voters: 1, 0.5, 0.5 and 0
    assert scores[None] < 0.2
    assert {r.score for r in vote.neighbour_vote(docs, labels.limit(0)).collect()} == {0.5}
    assert vote.neighbour_vote(docs.limit(0), labels).count() == 0
