"""One entry per operator, over the star-schema tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargolens.functions.numbers import scaled_round
from cargolens.functions.text import document_title
from cargolens.operators import (
    anomalies, answers, chunks, delay_model, filters, instructions, isolation_forest, kpis,
    questions, scorecard, search, tfidf, trends,
)
from cargolens.session import materialize
from cargolens.sources.star_schema import (
    base_suppliers, read_table, supplier_names, supply_inventory, supply_orders, supply_suppliers,
)
from cargolens.sources.text_tables import (
    all_documents, analytic_questions, document_chunks, labelled_questions, markdown_documents,
)

DIGITS = 6  # floats are compared on this many decimals


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "date"}
    )


# Fitted models and vocabularies, kept per session and folder: several queries share one.
_fitted: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def _completed(spark: SparkSession, sf_dir: str, with_priority: bool = False) -> DataFrame:
    return supply_orders(spark, sf_dir, with_priority, only_completed=True)


# --- tables, filters and joins ----------------------------------------------


def table_scan(spark, sf):
    return read_table(spark, sf, "part")


def doc_titles(spark, sf):
    stem = F.concat_ws("_", "source", "lang")
    return read_table(spark, sf, "documents").select(
        "doc_id", document_title(stem).alias("title")
    )


def completed_orders(spark, sf):
    return _dates_as_text(filters.completed(_completed(spark, sf)))


def low_stock(spark, sf):
    return filters.low_stock(supply_inventory(spark, sf))


def inventory_status(spark, sf):
    return filters.inventory_status(supply_inventory(spark, sf))


def supplier_filter(spark, sf):
    return filters.supplier_list(
        supply_suppliers(spark, sf), ["AFRICA", "ASIA", "EUROPE"], ["MEDIUM", "HIGH"], "lier#"
    )


def order_filter(spark, sf):
    listed = filters.order_list(
        supply_orders(spark, sf, with_priority=True),
        supplier_names(spark, sf),
        statuses=["Delayed", "In Transit"],
        priorities=["Urgent", "High"],
    )
    return _dates_as_text(listed)


def order_list(spark, sf):
    return _dates_as_text(
        filters.order_list(
            supply_orders(spark, sf, with_priority=True), supplier_names(spark, sf)
        )
    )


def supplier_search(spark, sf):
    names = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("LIER#"), F.substring_index("s_name", "#", -1)).alias("name")
    )
    return questions.supplier_search(names, supply_suppliers(spark, sf))


def supplier_matches(spark, sf):
    # The last two digits of each name: short texts that several suppliers hold.
    names = read_table(spark, sf, "supplier").select(F.right("s_name", F.lit(2)).alias("name"))
    found = questions.matching_suppliers(names, supplier_names(spark, sf))
    return found.select("name", "supplier_id", "supplier_name")


# --- dashboard --------------------------------------------------------------


def dashboard_kpis(spark, sf):
    row = kpis.dashboard_kpis(
        supply_suppliers(spark, sf), supply_orders(spark, sf), supply_inventory(spark, sf)
    )
    return _rounded(row, "avg_delivery_days", "on_time_share", "inventory_value")


def risk_distribution(spark, sf):
    return kpis.risk_distribution(supply_suppliers(spark, sf))


def status_breakdown(spark, sf):
    return kpis.status_breakdown(supply_orders(spark, sf))


def monthly_delay_rate(spark, sf):
    return _rounded(kpis.monthly_delay_rate(_completed(spark, sf)), "delay_rate_pct")


def stock_by_category(spark, sf):
    return kpis.stock_by_category(supply_inventory(spark, sf))


def inventory_value_by_category(spark, sf):
    found = kpis.inventory_value_by_category(supply_inventory(spark, sf))
    return found.withColumn("value", F.round("value", 2))


def recent_alerts(spark, sf):
    return kpis.recent_alerts(supply_suppliers(spark, sf), supply_inventory(spark, sf))


# --- suppliers --------------------------------------------------------------


def supplier_scorecard(spark, sf):
    return supply_suppliers(spark, sf)


def risk_score(spark, sf):
    return supply_suppliers(spark, sf).select("supplier_id", "risk_score", "risk_level")


def risk_reasons(spark, sf):
    return supply_suppliers(spark, sf).select(
        "supplier_id",
        F.array_join(scorecard.risk_sentences(), " | ").alias("sentences"),
        F.array_join(scorecard.risk_phrases(), ", and ").alias("phrases"),
    )


def recommendations(spark, sf):
    level = F.col("risk_level")
    return supply_suppliers(spark, sf).select(
        "supplier_id", "risk_level", scorecard.recommendation(level).alias("steps")
    )


def supplier_profile(spark, sf):
    return scorecard.supplier_profile(supply_suppliers(spark, sf))


def supplier_trend(spark, sf):
    found = trends.supplier_trend(_completed(spark, sf))
    return _rounded(found, "first_rate", "second_rate", "change")


def supplier_trend_label(spark, sf):
    found = trends.supplier_trend_label(_completed(spark, sf))
    return _rounded(found, "first_rate", "second_rate", "change")


def performance_decline(spark, sf):
    found = trends.performance_decline(_completed(spark, sf))
    return _rounded(found, "delay_rate_first_half", "delay_rate_second_half", "decline")


# --- analytic questions -----------------------------------------------------


def route_questions(spark, sf):
    return questions.route_questions(analytic_questions(spark, sf))


def most_delayed(spark, sf):
    return questions.most_delayed(supply_suppliers(spark, sf))


def lowest_inventory_category(spark, sf):
    return _rounded(
        questions.lowest_inventory_category(supply_inventory(spark, sf)),
        "avg_stock_to_reorder_ratio",
    )


def above_delay_threshold(spark, sf):
    return questions.above_delay_threshold(supply_suppliers(spark, sf), 95)


def recent_delivery_time(spark, sf):
    return _dates_as_text(
        _rounded(questions.recent_delivery_time(_completed(spark, sf)), "avg_days")
    )


def answer_questions(spark, sf):
    return questions.answer_questions(
        analytic_questions(spark, sf), supply_suppliers(spark, sf), _completed(spark, sf),
        supply_inventory(spark, sf),
    )


# --- anomalies --------------------------------------------------------------


def supplier_months(spark, sf):
    return _rounded(anomalies.supplier_months(_completed(spark, sf)), "avg_delay")


def delay_spikes(spark, sf):
    return anomalies.delay_spikes(_completed(spark, sf), supplier_names(spark, sf))


def spike_headlines(spark, sf):
    return anomalies.spike_headlines(delay_spikes(spark, sf))


def quantity_outliers(spark, sf):
    # Quantities are evenly spread over 1 to 50, so only a narrow fence leaves rows outside.
    return anomalies.quantity_outliers(supply_orders(spark, sf), multiplier=0.4)


def value_outliers(spark, sf):
    rows = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    found = anomalies.upper_outliers(rows, "user_id", "value", ["event_id"])
    return _rounded(found, "upper_bound")


def isolation_flags(spark, sf):
    return isolation_forest.isolation_forest(
        _completed(spark, sf), supplier_names(spark, sf)
    )


def anomaly_agreement(spark, sf):
    return anomalies.agreement(delay_spikes(spark, sf), isolation_flags(spark, sf))


def anomaly_report(spark, sf):
    return anomalies.report_lines(
        anomalies.report_sections(
            delay_spikes(spark, sf), quantity_outliers(spark, sf), isolation_flags(spark, sf),
            supply_inventory(spark, sf),
        )
    )


# --- delay model ------------------------------------------------------------


def _features(spark, sf):
    return delay_model.delay_features(
        _completed(spark, sf, with_priority=True), supply_suppliers(spark, sf),
        supply_inventory(spark, sf),
    )


def _trained(spark, sf) -> delay_model.TrainedDelayModel:
    return _once(spark, sf, "delay model", lambda: delay_model.train(_features(spark, sf)))


def _predictions(spark, sf):
    """The scored test orders, written once: the trees are walked by the first query that asks."""

    def scored():
        trained = _trained(spark, sf)
        rows = delay_model.score(trained.model, trained.test)
        return materialize(
            rows.select("order_id", "is_delayed", "probability_delayed", "prediction")
        )

    return _once(spark, sf, "predictions", scored)


def delay_features(spark, sf):
    return _features(spark, sf)


def median_impute(spark, sf):
    # Features below a floor are taken as missing, so that there is something to fill.
    rows = _features(spark, sf).withColumns(
        {
            "on_time_rate": F.when(F.col("on_time_rate") >= 0.8, F.col("on_time_rate")),
            "quantity": F.when(F.col("quantity") >= 10, F.col("quantity")),
        }
    )
    rows = materialize(rows.select("order_id", *delay_model.NUMERIC))
    filled = delay_model.impute(rows, delay_model.feature_medians(rows))
    return _rounded(filled, *delay_model.NUMERIC)


def stratified_split(spark, sf):
    rows = filters.completed(_completed(spark, sf)).select(
        "order_id", filters.is_delayed().alias("is_delayed")
    )
    return delay_model.stratified_split(rows)


def train_only_features(spark, sf):
    return delay_model.train_only_features(
        _completed(spark, sf, with_priority=True), base_suppliers(spark, sf),
        supply_inventory(spark, sf),
    )


def delay_model_scores(spark, sf):
    return _predictions(spark, sf)


def delay_metrics(spark, sf):
    n_train = F.lit(_trained(spark, sf).n_train)
    return delay_model.delay_metrics(_predictions(spark, sf), n_train)


def confusion_matrix(spark, sf):
    return delay_model.confusion_matrix(_predictions(spark, sf))


def classification_report(spark, sf):
    return delay_model.classification_report(_predictions(spark, sf))


def feature_importance(spark, sf):
    trained = _trained(spark, sf)
    return delay_model.feature_importance(trained.model, trained.test)


def score_new_orders(spark, sf):
    trained = _trained(spark, sf)
    open_orders = supply_orders(spark, sf, with_priority=True).filter("status = 'In Transit'")
    return delay_model.score_new_orders(
        trained.model, trained.medians, open_orders, supply_suppliers(spark, sf),
        supply_inventory(spark, sf),
    )


def _rule(spark, sf):
    features = delay_model.delay_features(
        _completed(spark, sf).withColumn("priority", F.lit("Standard")),
        supply_suppliers(spark, sf),
        supply_inventory(spark, sf),
    )
    return delay_model.rule_predictions(features)


def rule_metrics(spark, sf):
    return delay_model.delay_metrics(_rule(spark, sf), F.lit(0))


def rule_confusion_matrix(spark, sf):
    return delay_model.confusion_matrix(_rule(spark, sf))


def rule_classification_report(spark, sf):
    return _rounded(
        delay_model.classification_report(_rule(spark, sf)), "precision", "recall", "f1_score"
    )


# --- retrieval --------------------------------------------------------------


def _index(spark, sf) -> tuple[DataFrame, tfidf.Vocabulary, DataFrame]:
    """Passages, vocabulary and vectors over all documents, built once as a stored index is."""

    def build():
        passages = materialize(document_chunks(spark, sf))
        vocabulary = tfidf.fit_vocabulary(passages, "passage")
        return passages, vocabulary, materialize(tfidf.vectors(passages, "passage", vocabulary))

    return _once(spark, sf, "index", build)


def _labelled(spark, sf) -> DataFrame:
    """The labelled questions, kept like the question set of an evaluation."""
    return _once(spark, sf, "questions", lambda: materialize(labelled_questions(spark, sf)))


def _hits(spark, sf):
    """Cited passages for the benchmark texts, at most three each, searched and written once."""

    def search_all():
        passages, vocabulary, vectors = _index(spark, sf)
        asked = read_table(spark, sf, "benchmark").select(
            F.col("item_id").alias("question"), "text"
        )
        inverted = search.InvertedIndex.build(vectors)
        found = inverted.top_matches(tfidf.vectors(asked, "question", vocabulary))
        return materialize(answers.cite(found, passages))

    return _once(spark, sf, "hits", search_all)


def chunk_sections(spark, sf):
    return chunks.chunk_sections(markdown_documents(spark, sf), "doc_id")


def chunk_windows(spark, sf):
    return chunks.chunk_windows(all_documents(spark, sf), "doc_id")


def term_counts(spark, sf):
    return tfidf.term_counts(all_documents(spark, sf), "doc_id")


def tfidf_weights(spark, sf):
    _, vocabulary, vectors = _index(spark, sf)
    return _rounded(tfidf.postings(vectors, "passage", vocabulary), "weight")


def index_summary(spark, sf):
    return tfidf.index_summary(document_chunks(spark, sf), "doc")


def retrieve_topk(spark, sf):
    return _hits(spark, sf).select("qid", "rank", "passage", "doc", "score")


def dense_topk(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    norm = F.sqrt(
        F.aggregate(
            F.transform("embedding", lambda x: x.cast("double")),
            F.lit(0.0),
            lambda total, x: total + x * x,
        )
    )
    scaled = rows.withColumn("norm", norm).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
        .alias("weights"),
    )
    # The stated set of questions: a twentieth of the vectors, each against all others.
    found = search.top_matches(
        scaled.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "question"),
        scaled.withColumnRenamed("vec_id", "passage"),
        skip_self=True,
    )
    return found.select(
        F.col("question").alias("query_id"), F.col("passage").alias("vec_id"), "rank",
        scaled_round(F.col("score"), 4).alias("score"),
    )


def extractive_answers(spark, sf):
    asked = _labelled(spark, sf)
    return answers.extractive_answers(asked, _hits(spark, sf)).select(
        "qid", "answer", F.array_join("sources", "; ").alias("sources"), "mode"
    )


def qa_context(spark, sf):
    return answers.prompt_context(_hits(spark, sf))


def recall_at_k(spark, sf):
    asked = _labelled(spark, sf)
    detail = answers.recall_detail(answers.extractive_answers(asked, _hits(spark, sf)))
    return detail.withColumn("retrieved_docs", F.array_join("retrieved_docs", ","))


def groundedness(spark, sf):
    asked = _labelled(spark, sf)
    return answers.groundedness(answers.extractive_answers(asked, _hits(spark, sf)))


def answer_relevance(spark, sf):
    asked = _labelled(spark, sf)
    return answers.answer_relevance(answers.extractive_answers(asked, _hits(spark, sf)))


def qa_evaluation(spark, sf):
    return answers.qa_evaluation(_labelled(spark, sf), _hits(spark, sf))


# --- instruction records ----------------------------------------------------


def instr_summary(spark, sf):
    return instructions.summary_records(supply_suppliers(spark, sf))


def instr_risk(spark, sf):
    return instructions.risk_records(supply_suppliers(spark, sf))


def instr_recommend(spark, sf):
    return instructions.recommend_records(supply_suppliers(spark, sf))


def instr_trend(spark, sf):
    return instructions.trend_records(supplier_names(spark, sf), _completed(spark, sf))


def _split_records(spark, sf):
    return instructions.train_split(
        instructions.all_records(supply_suppliers(spark, sf), _completed(spark, sf))
    )


def instruction_split(spark, sf):
    return _split_records(spark, sf)


def chat_records(spark, sf):
    chats = instructions.chat_records(_split_records(spark, sf))
    return chats.select(
        "record_id", "split", F.posexplode("messages").alias("position", "message")
    ).select("record_id", "split", "position", "message.role", "message.content")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "table_scan": table_scan,
    "doc_titles": doc_titles,
    "completed_orders": completed_orders,
    "low_stock": low_stock,
    "inventory_status": inventory_status,
    "supplier_filter": supplier_filter,
    "order_filter": order_filter,
    "order_list": order_list,
    "supplier_search": supplier_search,
    "supplier_matches": supplier_matches,
    "dashboard_kpis": dashboard_kpis,
    "risk_distribution": risk_distribution,
    "status_breakdown": status_breakdown,
    "monthly_delay_rate": monthly_delay_rate,
    "stock_by_category": stock_by_category,
    "inventory_value_by_category": inventory_value_by_category,
    "recent_alerts": recent_alerts,
    "supplier_scorecard": supplier_scorecard,
    "risk_score": risk_score,
    "risk_reasons": risk_reasons,
    "recommendations": recommendations,
    "supplier_profile": supplier_profile,
    "supplier_trend": supplier_trend,
    "supplier_trend_label": supplier_trend_label,
    "performance_decline": performance_decline,
    "route_questions": route_questions,
    "most_delayed": most_delayed,
    "lowest_inventory_category": lowest_inventory_category,
    "above_delay_threshold": above_delay_threshold,
    "recent_delivery_time": recent_delivery_time,
    "answer_questions": answer_questions,
    "supplier_months": supplier_months,
    "delay_spikes": delay_spikes,
    "spike_headlines": spike_headlines,
    "quantity_outliers": quantity_outliers,
    "value_outliers": value_outliers,
    "isolation_forest": isolation_flags,
    "anomaly_agreement": anomaly_agreement,
    "anomaly_report": anomaly_report,
    "delay_features": delay_features,
    "median_impute": median_impute,
    "stratified_split": stratified_split,
    "train_only_features": train_only_features,
    "delay_model_scores": delay_model_scores,
    "delay_metrics": delay_metrics,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "feature_importance": feature_importance,
    "score_new_orders": score_new_orders,
    "rule_metrics": rule_metrics,
    "rule_confusion_matrix": rule_confusion_matrix,
    "rule_classification_report": rule_classification_report,
    "chunk_sections": chunk_sections,
    "chunk_windows": chunk_windows,
    "term_counts": term_counts,
    "tfidf_weights": tfidf_weights,
    "index_summary": index_summary,
    "retrieve_topk": retrieve_topk,
    "dense_topk": dense_topk,
    "extractive_answers": extractive_answers,
    "qa_context": qa_context,
    "recall_at_k": recall_at_k,
    "groundedness": groundedness,
    "answer_relevance": answer_relevance,
    "qa_evaluation": qa_evaluation,
    "instr_summary": instr_summary,
    "instr_risk": instr_risk,
    "instr_recommend": instr_recommend,
    "instr_trend": instr_trend,
    "instruction_split": instruction_split,
    "chat_records": chat_records,
}
