"""Decision lists over text statistics, grown and pruned by sequential covering.

Rules are conjunctions of thresholds, as in IREP (Fürnkranz and Widmer, ICML 1994): grown on two
thirds of the labelled rows by information gain, pruned on the rest, kept while they are precise
there. The list becomes one ordered conditional expression. All counting is Spark aggregates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, functions as F

from cargolens.llm.storage import written

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_capitals", "n_marks"]
KEEP, REJECT = "keep", "reject"


@dataclass(frozen=True)
class Rule:
    """Rejects a row for which all conditions (feature, over, cut) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self) -> Column:
        found = F.lit(True)
        for feature, over, cut in self.conditions:
            value = F.col(feature)
            found = found & ((value > F.lit(cut)) if over else (value <= F.lit(cut)))
        return found


def text_statistics(docs: DataFrame, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``doc_id`` and the counts of ``COUNTS`` for every whole text, within its row.

    Words are runs without ASCII white space, lines those with a word. Null counts as empty: no
    words and no lines. ``n_repeat_words`` counts words in windows of five words that occur
    twice or more in the text. Texts of any length are read
    whole; rows that repeat are counted each; other columns are ignored.
    """
    words = F.col("words")
    text = F.col("text")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    trimmed = F.btrim(text, F.lit(SPACE))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    rows = rows.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z][A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
    )
    counts = ["n_symbols", "n_capitals", "n_marks"]
    rows = rows.select(
        "doc_id", *counts,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= WINDOW, windows).alias("windows"),
    )
    counts += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    # Most texts repeat nothing; in the others windows are sorted, so that equal ones are
    # neighbours, and the places of those with an equal neighbour are put in order again.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(
        "doc_id", *counts, F.when(repeats, F.sort_array(placed)).alias("sorted")
    )

    def equal(i, j):
        return F.get("sorted", i)["h"].eqNullSafe(F.get("sorted", j)["h"])

    twice = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda i: ((i > 0) & equal(i, i - 1))
        | ((i < F.size("sorted") - 1) & equal(i, i + 1)),
    )
    places = F.sort_array(F.transform(twice, lambda i: F.get("sorted", i)["i"]))
    rows = rows.select(
        "doc_id", *counts, F.when(F.col("sorted").isNotNull(), places).alias("places")
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.size("places") - 1),
        lambda j: F.least(F.lit(WINDOW), F.get("places", j) - F.get("places", j - 1)),
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)
    return rows.select(
        "doc_id", *counts,
        F.when(F.col("places").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def features() -> dict[str, Column]:
    """What the rules may ask, by name; no words give zeros."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "word_count": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "capitals_share": F.col("n_capitals") / chars,
        "marks_per_word": F.col("n_marks") / n,
        "words_per_line": F.col("n_words") / lines,
    }


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _gain(p: int, n: int, p_before: int, n_before: int) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p_before / (p_before + n_before)))


def learn_rules(
    rows: DataFrame, names: list[str], most_rules: int = 10, most_conditions: int = 3,
    quantiles: int = 16, least_precision: float = 0.95, least_rows: int = 3,
) -> list[Rule]:
    """Rules that reject, in the order they were learned.

    ``rows`` has the double columns ``names``, ``reject`` (boolean) and ``part`` (true for the
    pruning third). Cuts lie half-way between neighbouring quantiles
    of all rows and of the rejected ones. A rule is kept if
    it finds at least ``least_rows`` rejected rows of the pruning part and is right there for
    ``least_precision`` of what it finds; the first that is not ends the list. Rows with a null
    label or feature are left out; no rows, or only one label, give no rules.
    """
    rows = rows.select(*names, "reject", "part").dropna()
    shares = [k / quantiles for k in range(1, quantiles)]
    found = rows.agg(
        *(F.percentile_approx(c, shares, 1000).alias(f"{c}_all") for c in names),
        *(F.percentile_approx(F.when(F.col("reject"), F.col(c)), shares, 1000).alias(f"{c}_bad")
          for c in names),
    ).first()
    values = {c: sorted({*(found[f"{c}_all"] or []), *(found[f"{c}_bad"] or [])}) for c in names}
    cuts = {c: [(x + y) / 2 for x, y in pairwise(v)] for c, v in values.items()}
    if not any(cuts.values()):
        return []

    def place(c):  # the number of cuts that the value is over
        return sum((F.when(F.col(c) > cut, 1).otherwise(0) for cut in cuts[c]), F.lit(0))

    # One row per combination of places; all later counts are over these.
    table = written(
        rows.select(*(place(c).alias(c) for c in names), "reject", "part")
        .groupBy(*names, "part")
        .agg(F.count_if("reject").alias("p"), F.count_if(~F.col("reject")).alias("n")),
        "places",
    )

    def at(condition):
        feature, over, k = condition
        return F.col(feature) > k if over else F.col(feature) <= k

    def all_of(conditions):
        holds = F.lit(True)
        for condition in conditions:
            holds = holds & at(condition)
        return holds

    def totals(frame):
        row = frame.agg(F.sum("p"), F.sum("n")).first()
        return row[0] or 0, row[1] or 0

    def counts_by_place(frame):
        each = ", ".join(f"'{c}', `{c}`" for c in names)
        long = frame.selectExpr("p", "n", f"stack({len(names)}, {each}) AS (feature, place)")
        return long.groupBy("feature", "place").agg(F.sum("p"), F.sum("n")).collect()

    def best(frame, p_before, n_before):
        by = {c: {} for c in names}
        for feature, k, p, n in counts_by_place(frame):
            by[feature][k] = (p, n)
        choices = []
        for c in names:
            p = n = 0
            for k in range(len(cuts[c])):
                p, n = p + by[c].get(k, (0, 0))[0], n + by[c].get(k, (0, 0))[1]
                choices.append((_gain(p, n, p_before, n_before), (c, False, k)))
                choices.append((_gain(p_before - p, n_before - n, p_before, n_before),
                                (c, True, k)))
        return max(choices, key=lambda x: (x[0], x[1]))

    rules: list[Rule] = []
    open_rows = table
    while len(rules) < most_rules:
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < most_conditions:
            frame = open_rows.filter(~F.col("part")).filter(all_of(conditions))
            p, n = totals(frame)
            if not p or not n:
                break
            gain, condition = best(frame, p, n)
            if gain <= 0:
                break
            conditions.append(condition)
        if not conditions:
            break
        prune = open_rows.filter("part")
        kept, (p, n) = max(
            ((conditions[:k], totals(prune.filter(all_of(conditions[:k]))))
             for k in range(1, len(conditions) + 1)),
            key=lambda x: (x[1][0] - x[1][1]) / max(1, sum(x[1])),
        )
        if p < least_rows or p < least_precision * (p + n):
            break
        rules.append(Rule(tuple((c, over, cuts[c][k]) for c, over, k in kept)))
        open_rows = open_rows.filter(~all_of(kept))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds rejects; what none rejects is kept. Features must be columns."""
    if not rules:
        return F.lit(KEEP)
    found = F.when(rules[0].holds(), REJECT)
    for rule in rules[1:]:
        found = found.when(rule.holds(), REJECT)
    return found.otherwise(KEEP)


def judge_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                    text_column: str = "text") -> tuple[DataFrame, list[Rule]]:
    """All documents with counts, ``base_failed`` and ``kept``, and the rules learned.

    Labels are ``doc_id, quality``; quality 0 is to be rejected. The rules are learned on all
    labelled documents that pass the base rules, which are the ones the list decides on. Labels of unknown documents
    and null labels are ignored, without labels only the base rules reject. Null ids are
    judged, never labelled.
    """
    counted = written(text_statistics(docs, id_column, text_column), "statistics")
    asked = features()
    names = list(asked)
    known = labels.select("doc_id", "quality").dropna().select(
        F.col("doc_id").alias("labelled"), (F.col("quality") == 0).alias("reject"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("part"),
    )
    rows = (
        counted.filter(~base_failed()).withColumns(asked).join(known, F.col("doc_id") == F.col("labelled"))
        .select(*names, "reject", "part")
    )
    rules = learn_rules(rows, names)
    judged = counted.withColumns(asked).select(
        *counted.columns, base_failed().alias("base_failed"),
        (~base_failed() & (verdict(rules) == KEEP)).alias("kept"),
    )
    return judged, rules
