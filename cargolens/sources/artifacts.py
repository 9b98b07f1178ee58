"""Writing and reading of reports, record files, retrieval indexes and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.operators.delay_model import TrainedDelayModel, feature_names
from cargolens.operators.tfidf import BACKEND, VOCABULARY_SCHEMA, Vocabulary

RECORDS = "instruction string, input string, output string"


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each list of the report as JSON lines in a folder of its name, in files in its order."""
    for name, frame in sections.items():
        frame.orderBy("position").write.mode("overwrite").json(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A list of the report in its order."""
    return spark.read.json(f"{path}/{name}").orderBy("position")


def write_evaluation(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """The row of measures, and what was retrieved for each question, in the questions' order."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    detail.orderBy("qid").write.mode("overwrite").json(f"{path}/per_question_retrieval")


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The measures and the detail per question as written by ``write_evaluation``."""
    detail = spark.read.json(f"{path}/per_question_retrieval").orderBy("qid")
    return spark.read.json(f"{path}/summary"), detail


def write_records(records: DataFrame, path: str) -> None:
    """Instruction records as JSON lines: all, training and validation part."""
    columns = ["instruction", "input", "output"]
    parts = {
        "all": records,
        "train": records.filter("split = 'train'"),
        "validation": records.filter("split = 'validation'"),
    }
    for name, part in parts.items():
        part.select(*columns).write.mode("overwrite").json(f"{path}/{name}")


def read_records(spark: SparkSession, path: str, part: str = "all") -> DataFrame:
    return spark.read.schema(RECORDS).json(f"{path}/{part}")


def write_index(
    chunks: DataFrame, vectors: DataFrame, vocabulary: Vocabulary, path: str
) -> None:
    """Passages, their vectors, the vocabulary and one row of facts about the index."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vocabulary.frame(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
    meta = spark.createDataFrame([(BACKEND, vocabulary.texts)], "backend string, n_chunks bigint")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """Passages, vectors and vocabulary as written by ``write_index``."""
    terms = spark.read.schema(VOCABULARY_SCHEMA).parquet(f"{path}/vocabulary")
    rows = [tuple(row) for row in terms.orderBy("term_no").collect()]
    size = spark.read.parquet(f"{path}/meta").first()["n_chunks"]
    return (
        spark.read.parquet(f"{path}/chunks"),
        spark.read.parquet(f"{path}/vectors"),
        Vocabulary(rows, size),
    )


def write_model(trained: TrainedDelayModel, metrics: DataFrame, path: str) -> None:
    """The fitted pipeline, the imputation values, the feature names and the metrics."""
    spark = metrics.sparkSession
    trained.model.write().overwrite().save(f"{path}/pipeline")
    medians = spark.createDataFrame(
        list(trained.medians.items()), "feature string, median double"
    )
    medians.write.mode("overwrite").json(f"{path}/medians")
    names = [(i, name) for i, name in enumerate(feature_names(trained.model))]
    spark.createDataFrame(names, "position int, feature string").write.mode("overwrite").json(
        f"{path}/features"
    )
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def read_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, float]]:
    """The fitted pipeline and the imputation values."""
    rows = spark.read.schema("feature string, median double").json(f"{path}/medians").collect()
    return PipelineModel.load(f"{path}/pipeline"), {row.feature: row.median for row in rows}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/metrics").select(F.col("*"))
