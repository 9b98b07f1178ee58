"""Tables in which one key, one day and copies of one line hold most rows."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from cargolens.plans.oracle import ORACLE_SQL
from cargolens.plans.queries import QUERIES
from cargolens.sources.star_schema import TABLES
from compare import differences, duck

LINES = """
SELECT CASE WHEN h < 10 THEN 5 WHEN h BETWEEN 40 AND 70 THEN 9 ELSE l_orderkey END AS l_orderkey,
       CASE WHEN h < 33 THEN 1 ELSE l_partkey END::BIGINT AS l_partkey,
       CASE WHEN h < 33 THEN 1 ELSE l_suppkey END::BIGINT AS l_suppkey,
       CASE WHEN h < 10 THEN 3 ELSE l_linenumber END::INT AS l_linenumber,
       CASE WHEN h < 10 THEN 7 WHEN h = 50 THEN 4000 + g ELSE l_quantity END::DOUBLE AS l_quantity,
       l_extendedprice,
       CASE WHEN h >= 10 THEN l_discount WHEN g % 3 = 0 THEN 0.09 ELSE 0.01 END AS l_discount,
       l_tax, l_returnflag, l_linestatus,
       CASE WHEN h < 25 THEN TIMESTAMP '1998-05-05' ELSE l_shipdate END AS l_shipdate
FROM (SELECT *, (hash(l_orderkey, l_linenumber, l_partkey, g) % 100)::INT AS h
      FROM '{source}', range(4) AS r(g))
"""
EVENTS = """
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, event_type,
       value, props
FROM '{source}'
"""
# A document that is copied until its copies are a third of all documents.
DOCUMENTS = """
SELECT * FROM '{source}'
UNION ALL
SELECT doc_id + 1000 * g, text, lang, source, n_chars FROM '{source}', range(1, 101) AS r(g)
WHERE doc_id = (SELECT min(doc_id) FROM '{source}' WHERE contains(text,
  (SELECT min(text) FROM '{benchmark}' b
   WHERE EXISTS (SELECT 1 FROM '{source}' d WHERE contains(d.text, b.text)))))
"""


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, sf):
    folder = tmp_path_factory.mktemp("skewed")
    changed = {"lineitem": LINES, "events": EVENTS, "documents": DOCUMENTS}
    for name in TABLES:
        source, target = f"{sf}/{name}.parquet", f"{folder}/{name}.parquet"
        if name in changed:
            sql = changed[name].format(source=source, benchmark=f"{sf}/benchmark.parquet")
            duckdb.sql(f"COPY ({sql}) TO '{target}' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
        else:
            shutil.copy(source, target)
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "supplier_scorecard", "supplier_trend", "supplier_trend_label", "performance_decline",
        "delay_spikes", "quantity_outliers", "value_outliers", "order_list", "delay_features",
        "median_impute", "stratified_split", "rule_confusion_matrix", "answer_questions",
        "instruction_split", "retrieve_topk", "recall_at_k", "qa_evaluation",
    ],
)
def test_same_as_sql_on_skewed_tables(spark, skewed, name):
    assert differences(QUERIES[name](spark, skewed), duck(skewed), ORACLE_SQL[name]) is None


def test_outliers_are_there(spark, skewed):
    assert QUERIES["quantity_outliers"](spark, skewed).count() > 0
    assert QUERIES["value_outliers"](spark, skewed).count() > 0


def test_hot_order_key_is_split(spark, skewed):
    """Lines and orders are joined by key; a hot order is split by the run-time skew join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "32KB",  # several tasks write the hot key
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = QUERIES["order_list"](spark, skewed)
        assert differences(frame, duck(skewed), ORACLE_SQL["order_list"]) is None
        assert "SortMergeJoin(skew=true)" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
