from __future__ import annotations

import random

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from cargolens.functions import numbers, text


def _apply(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}").withColumn("r", expression(F.col("v")))
    return [row.r for row in frame.orderBy("i").collect()]


def test_exact_round_is_python_round(spark):
    rng = random.Random(1)
    values = [k / 2000 for k in range(0, 2001, 7)] + [1 - k / 80 for k in range(80)]
    values += [rng.uniform(-100, 100) for _ in range(500)] + [2.45, 2.35, 2.65, -0.25, 0.25, -2.65]
    for digits in (1, 2, 3):
        got = _apply(spark, values, "double", lambda v: numbers.exact_round(v, digits))
        assert got == [round(v, digits) for v in values]


def test_number_texts(spark):
    values = [0.0, 0.5, 1.5, 2.5, 2.45, 2.65, 12.25, -0.04, 1234.5, 99.95]
    assert _apply(spark, values, "double", numbers.tenth_text)[:7] == [
        f"{v:.1f}" for v in values[:7]
    ]
    assert _apply(spark, values, "double", numbers.signed_tenth_text) == [
        f"{v:+.1f}" for v in values
    ]
    assert _apply(spark, values[:7], "double", numbers.whole_text) == [
        f"{v:.0f}" for v in values[:7]
    ]
    assert _apply(spark, [1234567.5, 12.0], "double", numbers.currency_text) == ["$1,234,568", "$12"]
    assert _apply(spark, [0.1234, 0.8125], "double", numbers.percent_text) == ["12.3%", "81.2%"]


def test_spread_keeps_small_keys_apart(spark):
    keys = spark.range(200_000).select(numbers.spread(F.col("id")).alias("h"))
    row = keys.agg(F.count_distinct("h").alias("d"), F.min("h").alias("l"), F.max("h").alias("u"))
    found = row.first()
    assert found.d == 200_000 and found.l >= 0 and found.u < 1 << 32


def test_strip_and_titles_follow_python(spark):
    values = ["  a b ", " x ", "\x1c\ty\n\x85", "", " \n ", "é ", "no", "​z"]
    assert _apply(spark, values, "string", text.strip) == [v.strip() for v in values]
    stems = ["delivery_policy", "q3_report-v2", "2nd_draft", "ÉTÉ_été", "a", ""]
    assert _apply(spark, stems, "string", text.document_title) == [
        s.replace("_", " ").title() for s in stems
    ]


def test_stop_words_are_sparks(spark):
    full = StopWordsRemover.loadDefaultStopWords("english")
    assert set(text.STOP_WORDS) == {w for w in full if "'" not in w and len(w) > 1}


def test_tokens_and_bigrams(spark):
    rows = spark.createDataFrame([("The late-delivery penalty is 5% a day",), ("",), ("of x",)], "t string")
    found = rows.select(text.with_bigrams(text.tokens(F.col("t"))).alias("w")).collect()
    assert found[0].w == [
        "late", "delivery", "penalty", "day", "late delivery", "delivery penalty", "penalty day"
    ]
    assert found[1].w == [] and found[2].w == []
