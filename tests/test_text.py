"""Chunking, TF-IDF, search and answers on small texts, against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.functions.text import STOP_WORDS
from cargolens.operators import answers, chunks, search, tfidf
from cargolens.sources.text_tables import containing_documents

DOCUMENTS = {
    "none": "no header here " * 60,
    "short": "just a line",
    "empty": "",
    "blank": " \n\t ",
    "plain": "intro\n\n## One\nbody one\n## Two\n\n" + "word " * 250,
    "start": "## First\nx\n### not a section\nmid ## line\n##nospace\n## Last",
    "odd": "## ## Twice #\r\nbody\n##  sep\nafter\n##  \nz",
    "exact": "## H\n" + "y" * 498,
    "over": "## H\n" + "y" * 499,
}


def _cut(text):
    return [p for p in (text[i : i + 500].strip() for i in range(0, len(text), 400)) if p]


def _sections(text):
    """Line by line: gather the lines under each header line."""
    found, name, lines = [], None, []
    for line in [*text.split("\n"), None]:
        if line is None or re.fullmatch(r"## .+", line):
            found.append((name, "\n".join(lines).strip()))
            if line is not None:
                name, lines = line.strip().lstrip("#").strip(), []
        else:
            lines.append(line)
    if len(found) == 1:
        return [("N/A", p) for p in _cut(text)]
    result = [("Preamble", found[0][1])] if found[0][1] else []
    for header, body in found[1:]:
        full = header + "\n" + body
        pieces = [full] if len(full) <= 500 else _cut(full)
        result += [(header, p) for p in pieces]
    return result


def test_sections(spark):
    frame = spark.createDataFrame(list(DOCUMENTS.items()), "doc string, text string")
    rows = chunks.chunk_sections(frame).orderBy("doc", "chunk_no").collect()
    for name, text in DOCUMENTS.items():
        assert [(r.section, r.text) for r in rows if r.doc == name] == _sections(text), name
    windows = chunks.chunk_windows(frame).orderBy("doc", "chunk_no").collect()
    for name, text in DOCUMENTS.items():
        assert [r.text for r in windows if r.doc == name] == _cut(text), name


def _terms(text):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP_WORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


TEXTS = [
    "late delivery penalty applies to late suppliers",
    "safety stock for electronics stays above the reorder level",
    "purchase orders need approval before the order is placed",
    "late orders late orders late orders",
    "the of and",
    "",
]


def test_weights(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    counts = [_terms(t) for t in TEXTS]
    total, seen = Counter(), Counter()
    for c in counts:
        total.update(c)
        seen.update(c.keys())
    terms = sorted(total, key=lambda t: (-total[t], t))[:15]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + seen[t])) + 1 for t in terms}
    vocabulary = tfidf.fit_vocabulary(frame, "id", max_features=15)
    assert [r[0] for r in vocabulary.rows] == terms
    vectors = tfidf.vectors(frame, "id", vocabulary)
    found = {(r.id, r.term): r.weight for r in tfidf.postings(vectors, "id", vocabulary).collect()}
    wanted = {}
    for i, c in enumerate(counts):
        raw = {t: c[t] * idf[t] for t in terms if c[t]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        wanted.update({(i, t): w / norm for t, w in raw.items()})
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], rel=1e-12) for k in wanted)


def _unit(rng, n, width):
    rows = []
    for i in range(n):
        v = np.array([rng.choice([0.0, 0.0, rng.random()]) for _ in range(width)])
        v[rng.randrange(width)] += 1
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    # Copies, whose scores tie.
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)]


def _brute(questions, passages, k, least, skip_self):
    found = set()
    for q, v in questions:
        scored = sorted(
            (-round(float(np.dot(v, w)), 9), p)
            for p, w in passages if not (skip_self and p == q)
        )[:k]
        found |= {(q, rank + 1, p) for rank, (s, p) in enumerate(scored) if -s >= least}
    return found


def _vectors(spark, rows, key, sparse):
    made = spark.createDataFrame(rows, f"{key} bigint, weights array<double>")
    if not sparse:
        return made.repartition(5)
    entries = F.filter(
        F.transform("weights", lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
        lambda e: e["w"] != 0,
    )
    return made.repartition(5).select(
        key, F.transform(entries, lambda e: e["i"]).alias("terms"),
        F.transform(entries, lambda e: e["w"]).alias("weights"),
    )


def _found(frame):
    return {(r.question, r["rank"], r.passage) for r in frame.collect()}


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("skip_self", [False, True])
def test_search_is_exact(spark, sparse, skip_self):
    rng = random.Random(2)
    questions, passages = _unit(rng, 30, 12), _unit(rng, 60, 12)
    found = search.top_matches(
        _vectors(spark, questions, "question", sparse), _vectors(spark, passages, "passage", sparse),
        k=4, min_score=0.3, skip_self=skip_self,
    )
    assert _found(found) == _brute(questions, passages, 4, 0.3, skip_self)


@pytest.mark.parametrize("options", [{"share": False, "salt_rows": 7}, {"share": False}, {}])
def test_many_questions_meet_dealt_postings(spark, options):
    """Questions too many to share, a term in every passage, and weights below zero."""
    rng = random.Random(4)
    questions, passages = _unit(rng, 40, 15), _unit(rng, 120, 15)
    passages = [(i, [1.5, *v[1:]]) for i, v in passages]
    passages += [(1000 + i, [-w for w in v]) for i, v in passages[:9]]
    index = search.InvertedIndex.build(_vectors(spark, passages, "passage", True))
    found = index.top_matches(_vectors(spark, questions, "question", True), 3, 0.4, **options)
    assert _found(found) == _brute(questions, passages, 3, 0.4, False)
    with pytest.raises(ValueError):
        index.top_matches(_vectors(spark, questions, "question", True), 3, 0)


def test_bounds_leave_few_candidates(spark):
    """Common terms of small weight are no reason to score a passage."""
    rng = random.Random(5)

    def vector(own):
        v = np.array([0.05] * 20 + [0.0] * 40)
        v[20 + own] = 1
        return (v / np.linalg.norm(v)).tolist()

    passages = [(i, vector(rng.randrange(40))) for i in range(400)]
    questions = [(i, vector(i)) for i in range(4)]
    index = search.InvertedIndex.build(_vectors(spark, passages, "passage", True))
    asked = _vectors(spark, questions, "question", True)
    same = sum(q[1] == p[1] for q in questions for p in passages)
    assert index.candidates(asked, 3, 0.2).count() == same < 100
    assert _found(index.top_matches(asked)) == _brute(questions, passages, 3, 0.2, False)


@pytest.mark.parametrize("blocks", [{}, {"shared_entries": 60}])
def test_clustered_search_skips_cells(spark, blocks):
    rng = np.random.default_rng(3)
    centres = np.eye(10)[:8] * 5
    points = [(i, (centres[i % 8] + rng.normal(0, 0.2, 10)).tolist()) for i in range(800)]
    points += [(900 + i, points[3][1]) for i in range(20)]  # copies, whose scores tie
    passages = _vectors(spark, points, "passage", False)
    table = search.ClusteredVectors.build(passages, cells=16)
    vectors = np.array([v for _, v in points])
    cells = {r.passage: r.cell for r in table.rows.collect()}
    away = [np.linalg.norm(v - table.centres[cells[i]]) for i, v in points]
    assert len(cells) == len(points)
    assert all(d <= table.radii[cells[i]] + 1e-9 for (i, _), d in zip(points, away))
    assert (table.bounds(vectors[:40]).max(axis=1) >= (vectors[:40] @ vectors.T).max(axis=1)).all()
    questions = points[:40]
    best = np.sort(vectors[:40] @ vectors.T, axis=1)[:, -5]
    assert table.visits(vectors[:40], best).mean() < 0.3
    asked = _vectors(spark, questions, "question", False)
    found = table.top_matches(asked, 5, 0.3, True, **blocks)
    assert _found(found) == _brute(questions, points, 5, 0.3, True)
    assert table.top_matches(asked.limit(0)).count() == 0


def test_search_without_passages(spark):
    none = spark.createDataFrame([], "passage bigint, weights array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "question bigint, weights array<double>")
    assert search.top_matches(asked, none).count() == 0


@pytest.fixture
def answered(spark):
    questions = spark.createDataFrame(
        [
            (1, "What is the late delivery penalty?", "Contract", True),
            (2, "What about stock?", "Inventory", True),
            (3, "Best pizza topping?", None, False),
            (4, "What of the penalty?", None, False),
        ],
        "qid bigint, question string, expected_doc string, answerable boolean",
    )
    hits = spark.createDataFrame(
        [
            (1, 1, 10, "Contract", "Section 3", "The late delivery penalty is 2%.", 0.4),
            (1, 2, 11, "Policy", "Section 1", "Delivery is weekly.", 0.3),
            (2, 1, 12, "Contract", "Section 9", "Nothing of use.", 0.25),
            (4, 1, 10, "Contract", "Section 3", "The late delivery penalty is 2%.", 0.2),
        ],
        "qid bigint, rank int, passage bigint, doc string, section string, text string, score double",
    )
    return questions, hits, answers.extractive_answers(questions, hits)


def test_answers_and_citations(answered):
    rows = {r.qid: r for r in answered[2].collect()}
    assert rows[1].answer == answers.EXTRACTIVE_LABEL + "\n\nThe late delivery penalty is 2%."
    assert rows[1].sources == [
        "Contract — Section 3 (score: 0.4)", "Policy — Section 1 (score: 0.3)"
    ]
    assert (rows[3].answer, rows[3].sources, rows[3].mode) == (
        answers.NOT_ENOUGH_INFO, [], "no_retrieval"
    )
    context = {r.qid: r.context for r in answers.prompt_context(answered[1]).collect()}
    assert context[1] == (
        "[Source: Contract — Section 3]\nThe late delivery penalty is 2%.\n\n"
        "[Source: Policy — Section 1]\nDelivery is weekly."
    )


def _relevance(question, answer):
    sides = [Counter(w for w in re.findall(r"\w\w+", t.lower()) if w not in STOP_WORDS)
             for t in (question, answer)]
    idf = {w: 1.0 if w in sides[0] and w in sides[1] else 1 + math.log(1.5)
           for w in sides[0] | sides[1]}
    q, a = ([side[w] * idf[w] for w in idf] for side in sides)
    norm = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in a))
    return round(sum(x * y for x, y in zip(q, a)) / norm, 3) if norm else 0.0


def test_evaluation(answered):
    questions, hits, rows = answered
    texts = {r.qid: r for r in rows.collect()}
    grounded = {r.qid: r.groundedness for r in answers.groundedness(rows).collect()}
    relevant = {r.qid: r.answer_relevance for r in answers.answer_relevance(rows).collect()}

    def words(t):
        return set(re.findall(r"[a-zA-Z']+", t.lower()))

    for qid in (1, 2, 4):
        context = words("\n".join(h.text for h in texts[qid].hits))
        said = words(texts[qid].answer)
        assert grounded[qid] == round(len(said & context) / len(said), 3)
    assert 3 not in grounded
    for qid, row in texts.items():
        assert relevant[qid] == _relevance(row.question, row.answer)
    detail = {r.qid: r.hit for r in answers.recall_detail(rows).collect()}
    assert detail == {1: True, 2: False}
    summary = answers.qa_evaluation(questions, hits).first()
    assert summary.retrieval_recall_at_k == 0.5
    assert summary.correct_refusal_rate == 0.5
    assert summary.groundedness == round((grounded[1] + grounded[2]) / 2, 3)
    assert summary.answer_relevance == round((relevant[1] + relevant[2]) / 2, 3)


def test_containing_documents(spark):
    items = {1: "a b c d e f", 2: "x y", 3: "one", 4: "a b c d e g", 5: "b  c\nd e f z"}
    documents = {
        1: "zz a b c d e f z", 2: "one x\ny", 3: "a b c d e f1", 4: "xx yy one1", 5: "",
        6: "a b c d e a b c d e g", 7: "x z y one",
    }
    found = containing_documents(
        spark.createDataFrame(list(items.items()), "item_id int, text string"),
        spark.createDataFrame(list(documents.items()), "doc_id int, text string"),
    )
    wanted = {
        (i, d) for i, item in items.items() for d, text in documents.items()
        if f" {' '.join(item.split())} " in f" {' '.join(text.split())} "
    }
    assert {(r.item_id, r.doc_id) for r in found.collect()} == wanted
    assert found.count() == len(wanted)


def test_shared_questions_leave_passages_in_place(spark):
    """Each task hands on its best three per question, not all pairs of a common term."""
    passages = [(i, [0.6, 0.8, 0.0]) for i in range(300)] + [(300, [0.0, 1.0, 0.0])]
    questions = [(i, [0.8, 0.6, 0.0]) for i in range(4)]
    index = search.InvertedIndex.build(_vectors(spark, passages, "passage", True))
    asked = _vectors(spark, questions, "question", True)
    shared = index._shared(asked, index._chosen(asked, 0.2))
    assert index._scan(shared, "bigint", 3, 0.2, False).count() <= 5 * 4 * 3
    assert _found(index.top_matches(asked)) == _brute(questions, passages, 3, 0.2, False)
    assert "postings" not in vars(index)
