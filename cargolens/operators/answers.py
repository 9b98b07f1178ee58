"""Cited extractive answers and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cargolens.functions.numbers import exact_round, scaled_round
from cargolens.functions.text import STOP_WORDS, tokens, word_set
from cargolens.operators.search import TOP_K
from cargolens.session import broadcast_if_small, materialize

# Fixed values ---------------------------------------------------------------
NOT_ENOUGH_INFO = "The available documents do not contain enough information to answer this."
EXTRACTIVE_LABEL = (
    "[Extractive answer — no LLM API key configured, showing the most relevant excerpt directly]"
)
GENERATION_BACKEND = "extractive (no API key set)"
RARE_IDF = "1 + ln(1.5)"  # idf of a word in one of two texts; a word in both has idf 1
# ----------------------------------------------------------------------------


def cite(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches with document, section, text and the score on four decimals.

    ``chunks`` has ``passage``, ``doc``, ``section`` and ``text``. The matches, at most k
    per question, are kept, so the search runs once; few of them are sent to the chunks
    instead of shuffling all texts.
    """
    found = broadcast_if_small(materialize(matches))
    return chunks.join(found, "passage").select(
        F.col("question").alias("qid"), "rank", "passage", "doc", "section", "text",
        scaled_round(F.col("score"), 4).alias("score"),
    )


def ranked_hits(hits: DataFrame) -> DataFrame:
    """One row per question with its hits in rank order; at most k entries each."""
    return hits.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc", "section", "text", "score"))).alias(
            "hits"
        )
    )


def extractive_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """The best passage as the answer, or the refusal if nothing was found.

    Adds ``answer``, ``sources`` (one citation per hit), ``mode`` and the ``hits``.
    """
    listed = questions.join(ranked_hits(hits), "qid", "left")
    top = F.col("hits")[0]["text"]
    sources = F.transform(
        F.col("hits"),
        lambda hit: F.concat(
            hit["doc"], F.lit(" — "), hit["section"], F.lit(" (score: "),
            hit["score"].cast("string"), F.lit(")"),
        ),
    )
    return listed.withColumns(
        {
            "answer": F.coalesce(
                F.concat(F.lit(EXTRACTIVE_LABEL + "\n\n"), top), F.lit(NOT_ENOUGH_INFO)
            ),
            "sources": F.coalesce(sources, F.array().cast("array<string>")),
            "mode": F.when(F.col("hits").isNull(), "no_retrieval").otherwise("extractive"),
        }
    )


def prompt_context(hits: DataFrame) -> DataFrame:
    """The passages of a question with their sources, as one text."""
    blocks = F.transform(
        F.col("hits"),
        lambda hit: F.concat(
            F.lit("[Source: "), hit["doc"], F.lit(" — "), hit["section"], F.lit("]\n"),
            hit["text"],
        ),
    )
    return ranked_hits(hits).select("qid", F.array_join(blocks, "\n\n").alias("context"))


def recall_detail(answers: DataFrame, with_question: bool = False) -> DataFrame:
    """For each answerable question, the documents found and whether the right one is there."""
    docs = F.array_sort(F.array_distinct(F.transform("hits", lambda hit: hit["doc"])))
    return (
        answers.filter("answerable")
        .withColumn("retrieved_docs", F.coalesce(docs, F.array().cast("array<string>")))
        .select(
            "qid",
            *(["question"] if with_question else []),
            "expected_doc",
            "retrieved_docs",
            F.array_contains("retrieved_docs", F.col("expected_doc")).alias("hit"),
        )
    )


def recall_at_k(detail: DataFrame) -> DataFrame:
    """Share of answerable questions whose document was found."""
    return detail.agg(
        exact_round(F.avg(F.col("hit").cast("int")), 3).alias("recall_at_k"),
        F.count("*").alias("questions"),
    )


def word_overlap(answer: Column, context: Column) -> Column:
    """Share of the distinct words of the answer that the context holds."""
    said, given = word_set(answer), word_set(context)
    return F.when(F.size(said) == 0, 0.0).otherwise(
        exact_round(F.size(F.array_intersect(said, given)) / F.size(said), 3)
    )


def groundedness(answers: DataFrame) -> DataFrame:
    """Word overlap of each answer with the passages found for it; without any, no row."""
    texts = F.transform(F.col("hits"), lambda hit: hit["text"])
    context = F.array_join(texts, "\n")
    return answers.filter(F.col("hits").isNotNull() & (context != "")).select(
        "qid", word_overlap(F.col("answer"), context).alias("groundedness")
    )


def answer_relevance(
    answers: DataFrame, stop_words: Sequence[str] = tuple(STOP_WORDS)
) -> DataFrame:
    """Cosine of question and answer under TF-IDF fitted to just these two texts."""

    def terms(side: str) -> Column:
        return F.explode(tokens(F.col(side), stop_words)).alias("term")

    sides = answers.select("qid", "question", "answer").repartition("qid")
    words = sides.select(
        "qid", terms("question"), F.lit(1).alias("asked")
    ).unionByName(sides.select("qid", terms("answer"), F.lit(0).alias("asked")))
    idf = F.when((F.col("q") > 0) & (F.col("a") > 0), 1.0).otherwise(F.expr(RARE_IDF))
    sums = (
        words.groupBy("qid", "term")
        .agg(F.sum("asked").alias("q"), F.sum(1 - F.col("asked")).alias("a"))
        .select("qid", (F.col("q") * idf).alias("q"), (F.col("a") * idf).alias("a"))
        .groupBy("qid")
        .agg(
            F.sum(F.col("q") * F.col("a")).alias("dot"),
            F.sum(F.col("q") * F.col("q")).alias("qq"),
            F.sum(F.col("a") * F.col("a")).alias("aa"),
        )
    )
    norm = F.sqrt("qq") * F.sqrt("aa")
    cosine = F.when(norm > 0, scaled_round(F.col("dot") / norm, 9)).otherwise(0.0)
    return answers.select("qid").join(sums, "qid", "left").select(
        "qid", exact_round(F.coalesce(cosine, F.lit(0.0)), 3).alias("answer_relevance")
    )


def qa_evaluation(questions: DataFrame, hits: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """One row: recall, mean groundedness and relevance, share of correct refusals."""
    return evaluate(questions, hits, top_k)[0]


def evaluate(
    questions: DataFrame, hits: DataFrame, top_k: int = TOP_K
) -> tuple[DataFrame, DataFrame]:
    """The row of measures, and per answerable question what was retrieved for it."""
    answered = materialize(extractive_answers(questions, hits))  # read by each measure
    scored = answered.filter("answerable")
    grounded = groundedness(scored)
    relevant = answer_relevance(scored.filter(F.col("hits").isNotNull()))
    detail = recall_detail(answered, with_question=True)
    recall = recall_at_k(detail)
    measures = answered.agg(
        exact_round(
            F.avg(
                F.when(~F.col("answerable"), (F.col("answer") == NOT_ENOUGH_INFO).cast("int"))
            ),
            3,
        ).alias("correct_refusal_rate")
    ).select(
        recall.select("recall_at_k").scalar().alias("retrieval_recall_at_k"),
        F.lit(top_k).alias("top_k"),
        grounded.agg(exact_round(scaled_round(F.avg("groundedness"), 9), 3)).scalar()
        .alias("groundedness"),
        relevant.agg(exact_round(scaled_round(F.avg("answer_relevance"), 9), 3)).scalar()
        .alias("answer_relevance"),
        "correct_refusal_rate",
        F.lit(GENERATION_BACKEND).alias("generation_backend"),
    )
    return measures, detail
