"""Document files and labelled question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.functions.text import document_title

QUESTIONS = "question string, expected_doc string, answerable boolean"


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per markdown file: title from the file name, whole text, in no order."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return files.select(document_title(stem).alias("doc"), F.col("value").alias("text"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled questions; ``qid`` is a 64-bit hash of the question."""
    rows = spark.read.schema(QUESTIONS).json(path, multiLine=True)
    return rows.select(
        F.xxhash64("question").alias("qid"), "question", "expected_doc", "answerable"
    )
