"""Published results that the library must reach, stated as values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cargolens.operators import scorecard

# On-time rate, mean delivery days, quality, cost index; score and level.
SCORES = [
    (0.576, 13.3, 60.4, 80.5, 52.1, "MEDIUM"),
    (0.614, 10.1, 76.5, 116.9, 34.7, "MEDIUM"),
    (0.62, 10.0, 70.6, 118.3, 38.0, "MEDIUM"),
    (0.733, 12.4, 79.4, 132.1, 35.0, "MEDIUM"),
    (0.633, 13.3, 69.4, 109.8, 44.1, "MEDIUM"),
    (0.457, 13.7, 76.9, 103.3, 48.4, "MEDIUM"),
    (0.833, 6.4, 82.3, 83.0, 12.2, "LOW"),
    (0.919, 7.0, 93.8, 95.4, 8.0, "LOW"),
    (0.809, 5.1, 90.1, 107.2, 8.8, "LOW"),
    (0.859, 5.3, 81.3, 80.2, 9.2, "LOW"),
]


def test_risk_scores_and_levels(spark):
    frame = spark.createDataFrame(
        SCORES, "on_time_rate double, average_delivery_days double, quality_score double, "
        "cost_index double, wanted double, level string",
    ).withColumn("score", scorecard.risk_score())
    found = frame.select("score", "wanted", scorecard.risk_level(F.col("score")), "level").collect()
    assert all(r[0] == pytest.approx(r[1], abs=1e-9) and r[2] == r[3] for r in found)
