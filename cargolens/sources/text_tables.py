"""Texts, questions and passages derived from the star-schema parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cargolens.functions.text import SPACE_CLASS, strip
from cargolens.operators.chunks import chunk_windows
from cargolens.operators.filters import lookup
from cargolens.session import broadcast_if_small, materialize, use_all_cores
from cargolens.sources.star_schema import read_table

# Fixed values ---------------------------------------------------------------
# A line of one to three words serves as a section header.
SHORT_LINE = r"(?dm)^([^ \n]+( [^ \n]+){0,2})$"
ANCHOR_WORDS = 5
PASSAGES_PER_DOCUMENT = 1 << 20  # passage key = document key * this + number in the document
# ----------------------------------------------------------------------------

# Wordings of the analytic questions, some for each intent and some for none; supplier i asks
# number i mod 15.
QUESTION_WORDINGS = [
    "Name the vendor with the most delays this year.",
    "List vendors by the highest number of delays, worst one first.",
    "Where is stock running low?",
    "In what product group do we hold the least stock?",
    "Give me everyone with more than {number} delayed orders.",
    "Are there vendors with delayed orders above {number}?",
    "How long is the average delivery time at the moment?",
    "Has the average delay changed?",
    "Whose deliveries got worse lately?",
    "Do you see a performance drop anywhere?",
    "Please give me information about {name}",
    "Could I see the profile of {name}",
    "How many trucks are parked in the yard?",
    "Show me supplier details.",
    "Is there more information about it?",
]


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and texts of all documents."""
    return use_all_cores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their short lines marked as section headers."""
    return all_documents(spark, sf_dir).select(
        "doc_id", F.regexp_replace("text", SHORT_LINE, "## $1").alias("text")
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all documents, with an integer key per passage."""
    pieces = chunk_windows(all_documents(spark, sf_dir), "doc_id")
    return pieces.select(
        (F.col("doc_id") * PASSAGES_PER_DOCUMENT + F.col("chunk_no")).alias("passage"),
        F.col("doc_id").cast("string").alias("doc"),
        "section",
        "text",
    )


def _words(text: Column) -> Column:
    return F.split(strip(text), f"{SPACE_CLASS}+")


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _run(words: Column, at: Column, count: int) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at, F.lit(count)), " "))


def containing_documents(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item, document) pairs where the words of the item follow one another in the document.

    Such a document shares the first five words of the item (the first word, for an item
    of fewer), so documents and items meet on a hash of these and only then are compared.
    """
    item_words = items.select("item_id", _words(F.col("text")).alias("words"))
    long = F.size("words") >= ANCHOR_WORDS
    anchors = item_words.select(
        "item_id",
        F.when(long, _run(F.col("words"), F.lit(1), ANCHOR_WORDS))
        .otherwise(_run(F.col("words"), F.lit(1), 1))
        .alias("anchor"),
        _padded(F.col("words")).alias("item_text"),
    )
    words = F.col("words")
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - (ANCHOR_WORDS - 1), F.lit(1))),
        lambda at: _run(words, at, ANCHOR_WORDS),
    )
    singles = F.transform(F.array_distinct(words), lambda word: F.xxhash64(word))
    document_words = documents.select("doc_id", _words(F.col("text")).alias("words"))
    document_anchors = document_words.select(
        "doc_id", F.explode(F.array_distinct(F.concat(runs, singles))).alias("anchor")
    )
    pairs = broadcast_if_small(
        materialize(
            lookup(document_anchors, anchors, "anchor", deal_by=["doc_id"]).select(
                "doc_id", "item_id", "item_text"
            )
        ),
        most=10_000,  # pairs carry the text of their item
    )
    texts = document_words.select("doc_id", _padded(words).alias("doc_text"))
    return (
        texts.join(pairs, "doc_id")
        .filter(F.contains("doc_text", "item_text"))
        .select("item_id", "doc_id")
    )


def labelled_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as questions; the first document that holds one is expected."""
    items = read_table(spark, sf_dir, "benchmark")
    documents = all_documents(spark, sf_dir)
    expected = (
        containing_documents(items, documents)
        .groupBy("item_id")
        .agg(F.min("doc_id").cast("string").alias("expected_doc"))
    )
    return items.join(expected, "item_id", "left").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("question"),
        "expected_doc",
        F.col("expected_doc").isNotNull().alias("answerable"),
    )


def analytic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analytic question per supplier."""
    key = F.col("s_suppkey")
    wordings = []
    for wording in QUESTION_WORDINGS:
        head, _, tail = wording.partition("{number}")
        if tail:
            number = (key % 50 + 60).cast("string")
            wordings.append(F.concat(F.lit(head), number, F.lit(tail)))
        elif "{name}" in wording:
            wordings.append(F.concat(F.lit(wording.replace("{name}", "")), F.col("s_name")))
        else:
            wordings.append(F.lit(wording))
    chosen = F.element_at(F.array(*wordings), (key % len(wordings) + 1).cast("int"))
    return read_table(spark, sf_dir, "supplier").select(
        key.alias("qid"), chosen.alias("question")
    )
