"""Each word's entry of the cross-entropy models is shuffled once, and passes give the same losses."""

from __future__ import annotations

import numpy as np
import pytest

from cargolens.llm import cross_entropy


def texts(seed=5):
    rng = np.random.default_rng(seed)
    found = [" ".join(f"n{k}" for k in rng.integers(0, 3_000, 400)) for _ in range(40)]
    return [*found, found[0], None, "", "one", "new words here", "one one one"]


def scores(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(texts()[1],), ("one more",), (None,)], "text string")
    return cross_entropy.cross_entropy_difference(docs, target)


def test_no_table_of_pairs_is_written(spark, monkeypatch):
    """Pairs and their losses used to be written and met the texts' entries in a second shuffle."""
    rows = {}

    def written(df, label, write=cross_entropy.written):
        table = write(df, label)
        rows[label] = table.count()
        return table

    monkeypatch.setattr(cross_entropy, "written", written)
    monkeypatch.setattr(cross_entropy, "HEAD_WORDS", 1_000)
    monkeypatch.setattr(cross_entropy, "HEAD_PAIRS", 100)
    assert scores(spark).count() == len(texts())
    words = len({w for t in texts() for w in (t or "").split()} | {"more"})
    both_rare = rows.pop("sums") - 9 * len(texts())  # sums of a text from each of a few tasks
    assert both_rare < 40 * 400
    assert all(n <= words + 100 for n in rows.values()), rows


@pytest.mark.parametrize("head", [0, 500, 10**6])
def test_passes_give_the_same_losses(spark, monkeypatch, head):
    monkeypatch.setattr(cross_entropy, "HEAD_WORDS", head)
    once = {r["doc_id"]: r for r in scores(spark).collect()}
    monkeypatch.setattr(cross_entropy, "PASS_WORDS", 5_000)
    monkeypatch.setattr(cross_entropy, "AT_ONCE", 500)
    again = {r["doc_id"]: r for r in scores(spark).collect()}
    assert len(again) == len(texts()) and again.keys() == once.keys()
    for k, r in once.items():
        assert again[k]["n_words"] == r["n_words"]
        for c in ("loss_target", "loss_background"):
            assert again[k][c] == (r[c] if r[c] is None else pytest.approx(r[c], abs=1e-9))
