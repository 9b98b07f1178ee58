"""Token totals kept up to date by signed changes, in batches that commit once."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.llm.public_bpe import TEXTS_AT_ONCE, id_bytes, shared_vocabulary

KEYS = ["source", "lang", "tokenizer"]
CHANGE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id, source, lang, n_tokens, n_words, text_key`` of every whole text.

    Null text counts as empty: no tokens, no words. Null source and language stay null and are
    totalled as groups of their own. ``text_key`` is a 128-bit hash, equal for equal texts.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.col("source").cast("string"), F.col("lang").cast("string"),
    )
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "source", "lang", "n_tokens", "n_words", "text_key"]

    def counted(batches):
        import xxhash

        encode = id_bytes(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), part.column(3),
                        pa.array([len(raw) // 4 for raw in encode(texts)], pa.int64()),
                        pa.array([len(t.split()) for t in texts], pa.int64()),
                        pa.array([xxhash.xxh3_128_hexdigest(t) for t in texts], pa.string()),
                    ],
                    names,
                )

    return rows.mapInArrow(
        counted,
        f"doc_id {id_type}, source string, lang string, n_tokens long, n_words long, "
        "text_key string",
    )


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes of documents counted anew, from ``old_tokens`` to ``n_tokens``."""
    changed = (F.col("n_tokens") - F.col("old_tokens")).alias("n_tokens")
    return counts.select(*KEYS, F.lit(0).alias("n_docs"), changed)


class TokenRollup:
    """Totals by source, language and tokenizer version, in a folder all executors share.

    Each batch is one folder with the sums of its signed changes. A batch is committed when
    Spark's job commit has marked its folder; a batch that failed half-way leaves no mark and is
    written over when it comes again, one that is committed is left as it is. So batches may be
    sent any number of times, in any order, and the totals are sums over committed batches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: str, file: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}{file}")

    def committed(self, batch: str) -> bool:
        mark = self._path(batch, "/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes of a batch unless it is committed; whether they were added now."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"batch names are letters, digits, dots and dashes: {batch!r}")
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("n_docs").cast("long").alias("n_docs"),
            F.sum("n_tokens").cast("long").alias("n_tokens"),
        )
        sums.write.mode("overwrite").parquet(str(self._path(batch).toString()))
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over those of ``batches`` that are
        committed; groups whose documents are all gone are left out."""
        paths = [str(self._path(b).toString()) for b in batches if self.committed(b)]
        if not paths:
            return self.spark.createDataFrame([], CHANGE)
        found = self.spark.read.schema(CHANGE).parquet(*paths).groupBy(*KEYS)
        return found.agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).filter("n_docs <> 0 OR n_tokens <> 0")
