"""TF-IDF over a corpus of passages: fit a bounded vocabulary, then weight any texts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.functions.text import STOP_WORDS, tokens, with_bigrams
from cargolens.session import materialize

# Fixed values ---------------------------------------------------------------
MAX_FEATURES = 4000
BACKEND = "tfidf"
# ----------------------------------------------------------------------------

VOCABULARY_SCHEMA = "term string, term_no int, df bigint, idf double"


def _listed(
    texts: DataFrame, key: str, text: str, bigrams: bool, stop_words: Sequence[str]
) -> DataFrame:
    """Every term of every text, with repeats, as one array per row."""
    words = texts.select(key, tokens(F.col(text), stop_words).alias("words"))
    return words.select(key, (with_bigrams("words") if bigrams else F.col("words")).alias("terms"))


def term_counts(
    texts: DataFrame, key: str, text: str = "text", bigrams: bool = True,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
) -> DataFrame:
    """How often each term occurs in each text: ``key, term, tf``; each row is a text.

    Nothing leaves the row: its terms are sorted, and the lengths of the runs of equal
    terms are their counts.
    """
    term = F.col("terms")
    ordered = _listed(texts, key, text, bigrams, stop_words).withColumn("terms", F.sort_array(term))
    places = F.when(F.size(term) > 0, F.sequence(F.lit(0), F.size(term) - 1))
    first = F.filter(places, lambda i: (i == 0) | (F.get(term, i) != F.get(term, i - 1)))
    start = F.col("starts")
    runs = F.transform(
        start,
        lambda at, k: F.struct(
            F.get(term, at).alias("term"),
            (F.coalesce(F.get(start, k + 1), F.size(term)) - at).cast("long").alias("tf"),
        ),
    )
    return ordered.withColumn("starts", first).select(key, F.inline(runs))


@dataclass
class Vocabulary:
    """The most frequent terms with their idf; at most ``max_features`` rows."""

    rows: list[tuple]
    texts: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, VOCABULARY_SCHEMA)


def _totals(listed: DataFrame) -> DataFrame:
    """``term, total, df``: how often a term occurs, and in how many rows."""
    term = F.col("terms")
    # All terms of a row, then its distinct ones: the place tells which of the two is counted.
    placed = listed.select(
        F.size(term).alias("size"),
        F.posexplode(F.concat(term, F.array_distinct(term))).alias("at", "term"),
    )
    return placed.groupBy("term").agg(
        F.count_if(F.col("at") < F.col("size")).alias("total"),
        F.count_if(F.col("at") >= F.col("size")).alias("df"),
    )


def _frequent_pairs(
    listed: DataFrame, singles: DataFrame, first: list, max_features: int
) -> DataFrame:
    """The pairs of neighbours, as ``terms``, that may be among the first ``max_features`` terms.

    A pair is not more frequent than either of its words, and comes after its first word in the
    order of terms. So its first word is among the ``first`` words, and the other at least as
    frequent as the last of them. Most pairs are rare and thus need not be counted.
    """
    words = F.col("terms")
    starts, ends = [row.term for row in first], None
    if len(first) == max_features:
        ends = [
            row.term for row in singles.filter(F.col("total") >= (first[-1].total if first else 0))
            .limit(2 * max_features + 1).collect()
        ]
    rest = F.greatest(F.size(words) - 1, F.lit(0))

    def pair(one, other):
        known = F.lit(True)
        if ends is not None:
            known = one.isin(starts)
            if len(ends) <= 2 * max_features:  # else too many words are tied with the last
                known = known & other.isin(ends)
        return F.when(known, F.concat(one, F.lit(" "), other))

    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), pair)
    return listed.select(F.array_compact(pairs).alias("terms"))


def fit_vocabulary(
    texts: DataFrame, key: str, text: str = "text", max_features: int = MAX_FEATURES,
    bigrams: bool = True, stop_words: Sequence[str] = tuple(STOP_WORDS),
) -> Vocabulary:
    """The terms with the highest total count; equal counts in order of the term.

    idf = ln((1 + texts) / (1 + texts with the term)) + 1. Only the kept terms, whose
    number the caller bounds, come to the driver, as when fitting any vocabulary.
    """
    singles = materialize(_totals(_listed(texts, key, text, False, stop_words)))
    first = singles.orderBy(F.desc("total"), "term").limit(max_features).collect()
    if bigrams:
        pairs = _totals(_frequent_pairs(
            _listed(texts, key, text, False, stop_words), singles, first, max_features
        ))
        first += pairs.orderBy(F.desc("total"), "term").limit(max_features).collect()
    top = sorted(first, key=lambda row: (-row.total, row.term))[:max_features]
    size = texts.count()
    rows = [
        (row.term, number, row.df, math.log((1 + size) / (1 + row.df)) + 1.0)
        for number, row in enumerate(top)
    ]
    return Vocabulary(rows, size)


def vectors(
    texts: DataFrame, key: str, vocabulary: Vocabulary, text: str = "text", bigrams: bool = True,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
) -> DataFrame:
    """One row per text with the numbers and unit-length weights of its known terms.

    Texts without a known term have no row. Terms are looked up, counted, weighted and
    brought to unit length in the row, so no text and no token is shuffled.
    """
    listed = _listed(texts, key, text, bigrams, stop_words)
    if not vocabulary.rows:
        return listed.filter(F.lit(False)).select(
            key, F.array().cast("array<int>").alias("terms"),
            F.array().cast("array<double>").alias("weights"),
        )
    by_number = sorted(vocabulary.rows, key=lambda row: row[1])
    counted = CountVectorizerModel.from_vocabulary(
        [row[0] for row in by_number], inputCol="terms", outputCol="counts"
    )
    idf = Vectors.dense([row[3] for row in by_number])
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="counts", outputCol="weighted")
    unit = Normalizer(inputCol="weighted", outputCol="unit")
    found = unit.transform(weighted.transform(counted.transform(listed)))
    # The generator keeps the optimizer from counting anew for each use of the vector.
    return (
        found.select(key, F.explode(F.array(F.unwrap_udt("unit"))).alias("unit"))
        .select(key, F.col("unit.indices").alias("terms"), F.col("unit.values").alias("weights"))
        .filter(F.size("terms") > 0)
    )


def postings(vectorized: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """One row per text and term: the weight table of the index."""
    known = F.broadcast(
        vocabulary.frame(vectorized.sparkSession).select("term", "term_no")
    )
    return (
        vectorized.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("entry"))
        .select(
            key, F.col("entry.terms").alias("term_no"), F.col("entry.weights").alias("weight")
        )
        .join(known, "term_no")
        .select(key, "term", "weight")
    )


def index_summary(chunks: DataFrame, document: str) -> DataFrame:
    """Backend, number of passages and number of documents."""
    per_document = chunks.groupBy(document).agg(F.count("*").alias("chunks"))
    return per_document.agg(
        F.lit(BACKEND).alias("backend"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"),
        F.count("*").alias("n_documents"),
    )
