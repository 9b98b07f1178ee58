"""One entry per operator of this subpackage, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cargolens.llm import (
    bpe_automaton, chat_links, cross_entropy, decision_list, exact_dedup, fuzzy_lines, hard_negatives,
    jaccard_join, latent_vote, packing, periodic_runs, token_rollup, url_rules,
)
from cargolens.llm.storage import scratch, written

URL_RULES = """VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    AS rules(host, path, verdict)"""

ANSWER_SCHEMA = {
    "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1},
                   "turn": {"type": "integer", "minimum": 0}},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark, sf):
    """All conversations as tool traffic: a user's turn calls, the assistant's turn answers.

    Each call waits for the call two turns before; other roles stay texts.
    """
    turn, text = F.col("turn"), F.col("text")
    number = F.concat(F.lit("call-"), turn.cast("string"))
    before = F.when(turn >= 2, F.array(F.concat(F.lit("call-"), (turn - 2).cast("string"))))
    call = F.to_json(F.struct(
        number.alias("id"), F.lit("answer").alias("name"),
        F.struct(text.alias("prompt"), turn.alias("turn")).alias("arguments"),
        before.alias("after"),
    ))
    asked = F.concat(F.lit(chat_links.OPEN), call, F.lit(chat_links.CLOSE))
    answer = F.to_json(F.struct(
        F.concat(F.lit("call-"), (turn - 1).cast("string")).alias("tool_call_id"),
        text.alias("content"),
    ))
    is_user, is_assistant = F.col("role") == "user", F.col("role") == "assistant"
    messages = _table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(is_user, "assistant").when(is_assistant, "tool").otherwise(F.col("role"))
        .alias("role"),
        F.when(is_user, asked).when(is_assistant, answer).otherwise(text).alias("text"),
    )
    return chat_links.link_tool_calls(messages, {"answer": ANSWER_SCHEMA})


def op2_redirect_rules(spark, sf):
    pages = _table(spark, sf, "pages")
    rules = spark.sql(f"SELECT * FROM {URL_RULES}")
    return url_rules.judge_urls(pages, rules, url_rules.page_links(pages))


def op3_jaccard_join(spark, sf):
    return jaccard_join.similar_groups(_table(spark, sf, "documents"))


def op4_exact_dedup(spark, sf):
    return exact_dedup.exact_duplicates(_table(spark, sf, "documents"), keep="largest")


def op5_best_fit_packing(spark, sf):
    return packing.pack_documents(_table(spark, sf, "documents"))


def op6_decision_list(spark, sf):
    judged, _ = decision_list.judge_documents(
        _table(spark, sf, "documents"), _table(spark, sf, "labels")
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op7_fuzzy_lines(spark, sf):
    documents = _table(spark, sf, "documents")
    found = fuzzy_lines.drop_fuzzy_lines(documents.select("doc_id", "text"), least_words=1)
    return found.withColumnRenamed("_llm_removed", "n_removed")


def op8_token_rollup(spark, sf):
    """Inserts of all documents, a revision of all, deletes of later copies, and a batch again."""
    counts = written(token_rollup.count_tokens(_table(spark, sf, "documents")), "counts")
    words = counts.withColumns({"tokenizer": F.lit("words"), "n_tokens": F.col("n_words")})
    pieces = counts.withColumn("tokenizer", F.lit("byte_bpe_50k"))
    # Counted anew with the end-of-text id that separates documents in training.
    revised = pieces.withColumns(
        {"old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 1}
    )
    first = written(counts.groupBy("text_key").agg(F.min("doc_id").alias("first")), "first")
    copies = revised.join(first, "text_key").filter("doc_id <> first")
    state = token_rollup.TokenRollup(spark, scratch(spark, "rollup"))
    everything = token_rollup.inserts(words).union(token_rollup.inserts(pieces))
    state.commit("insert", everything)
    state.commit("revise", token_rollup.revisions(revised))
    state.commit("delete", token_rollup.deletes(copies))
    state.commit("insert", everything)  # sent again: changes nothing
    return state.totals(["insert", "revise", "delete"])


def op9_cross_entropy(spark, sf):
    return cross_entropy.cross_entropy_difference(
        _table(spark, sf, "documents"), target=_table(spark, sf, "benchmark")
    )


def op10_bpe_automaton(spark, sf):
    found = bpe_automaton.bpe_round_trip(_table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _id_checksum(column: str) -> Column:
    """The unsigned CRC-32 of a decimal id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op11_neighbour_vote(spark, sf):
    """Labels of rows with a remainder of 0 are held out; a null id is not held out."""
    held_out = F.coalesce(_id_checksum("doc_id") % 5 == 0, F.lit(False))
    found = latent_vote.neighbour_vote(
        _table(spark, sf, "documents"), _table(spark, sf, "labels"), learn_from=~held_out
    )
    return found.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op12_hard_negatives(spark, sf):
    rows = hard_negatives.quantized(_table(spark, sf, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def _with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents repeat a stretch of their words to the end.

    Documents without an id or without words stay as they are.
    """
    h = _id_checksum("doc_id")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chosen = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(h / 10)
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    chosen = chosen.withColumn("p", period)
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i)
                        .otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return chosen.select(
        "doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")
    )


def op13_periodic_runs(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(_with_periods(docs))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"),
    ))), 1)
    best = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    length, period = -F.col("best.order"), F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
        .alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_redirect_rules": op2_redirect_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decision_list": op6_decision_list,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_token_rollup": op8_token_rollup,
    "op9_cross_entropy": op9_cross_entropy,
    "op10_bpe_automaton": op10_bpe_automaton,
    "op11_neighbour_vote": op11_neighbour_vote,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
