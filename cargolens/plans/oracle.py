"""SQL counterparts of the registered queries, in DuckDB's dialect.

Written from the definitions, not from the Spark plans: windows are literal
``row_number``s, leave-one-out statistics are self joins, quantiles are built-ins and
retrieval pairs every question with every passage.
"""

from __future__ import annotations

import math

from cargolens.functions.numbers import HASH_INPUT_RANGE, HASH_MULTIPLIER, HASH_RANGE
from cargolens.functions.text import SPACE_CLASS, STOP_WORDS, TOKEN_PATTERN, WORD_PATTERN
from cargolens.operators.answers import (
    EXTRACTIVE_LABEL, GENERATION_BACKEND, NOT_ENOUGH_INFO, RARE_IDF,
)
from cargolens.operators.delay_model import NUMERIC
from cargolens.operators.instructions import (
    ELEVATED_TEXT, FAMILIES, MONITOR_TEXT, RECOMMEND_WORDINGS, RELIABLE_TEXT, REVIEW_TEXT,
    RISK_WORDINGS, SUMMARY_WORDINGS, SYSTEM_PROMPT, TREND_WORDINGS,
)
from cargolens.operators.isolation_forest import (
    CONTAMINATION, EULER_GAMMA, HALF_STEP, LENGTH_UNITS, MIN_ROWS, SAMPLE, SEED, TREES, mean_path,
)
from cargolens.operators.questions import (
    CODE_PATTERN, INTENT_PATTERNS, MOST, NAME_PATTERN, NO_NAME_TEXT, NUMBER_PATTERN,
    UNROUTED_TEXT,
)
from cargolens.operators.scorecard import (
    NO_RISK_PHRASE, NO_RISK_SENTENCE, RECOMMENDATIONS,
)
from cargolens.operators.trends import CONCERN_TEXT, NO_DECLINE_TEXT, STEADY_TEXT
from cargolens.sources.text_tables import PASSAGES_PER_DOCUMENT, QUESTION_WORDINGS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(_quote(t) for t in texts) + "]"


# --- number and text snippets -----------------------------------------------


def _exact(x: str, digits: int) -> str:
    """Half-even rounding of the binary value."""
    s = f"1e{digits}::DOUBLE"
    c = "134217729::DOUBLE"
    high = f"(v*{c} - (v*{c} - v))"
    error = f"(({high}*{s} - v*{s}) + (v - {high})*{s})"
    tie = f"v*{s} - floor(v*{s}) = 0.5"
    return (
        f"list_transform([CAST({x} AS DOUBLE)], lambda v: (CASE WHEN {tie} AND {error} > 0 "
        f"THEN floor(v*{s}) + 1 WHEN {tie} AND {error} < 0 THEN floor(v*{s}) "
        f"ELSE round_even(v*{s}, 0) END) / {s})[1]"
    )


def _scaled(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE)"


def _tenth(x: str) -> str:
    return f"printf('%.1f', {_exact(x, 1)})"


def _whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _percent(x: str) -> str:
    return f"{_tenth(f'{x} * 100::DOUBLE')} || '%'"


def _spread(key: str) -> str:
    return f"((({key}) % {HASH_INPUT_RANGE}) * {HASH_MULTIPLIER} % {HASH_RANGE})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')"


def _windows(x: str) -> str:
    """List of 500-character windows, 400 apart, stripped."""
    piece = _strip(f"substring({x}, i + 1, 500)")
    return f"list_transform(range(0, length({x}), 400), lambda i: {piece})"


# --- supply tables ----------------------------------------------------------

ORDERS = """
lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_id, l_suppkey AS supplier_id,
         l_partkey AS product_id, CAST(l_shipdate AS DATE) AS order_date,
         CAST(l_quantity AS INTEGER) AS quantity,
         CASE WHEN l_shipdate >= TIMESTAMP '2001-10-20' THEN 'In Transit'
              WHEN l_discount > 0.085 THEN 'Delayed' ELSE 'On Time' END AS status,
         3 + l_linenumber AS lead_days,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High'
              ELSE 'Standard' END AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
delayed_lines AS (
  SELECT *, CASE status WHEN 'Delayed' THEN 1 + quantity % 13 WHEN 'On Time' THEN 0 END
            AS delivery_delay,
         order_date + lead_days AS expected_delivery
  FROM lines),
supply_orders AS (
  SELECT *, expected_delivery + delivery_delay AS actual_delivery FROM delayed_lines),
done AS (
  SELECT *, CASE WHEN status = 'Delayed' THEN 1 ELSE 0 END AS is_delayed,
         actual_delivery - order_date AS full_days
  FROM supply_orders WHERE status <> 'In Transit')
"""

SUPPLIERS = f"""{ORDERS},
rollup_counts AS (
  SELECT supplier_id, count(*) AS total_orders, CAST(sum(is_delayed) AS BIGINT) AS delayed_orders,
         avg(full_days) AS mean_days
  FROM done GROUP BY supplier_id),
base_suppliers AS (
  SELECT s_suppkey AS supplier_id, s_name AS supplier_name, r_name AS category,
         n_name AS location, CAST(20 + (s_suppkey * 37) % 81 AS DOUBLE) AS quality_score,
         CAST(60 + (s_suppkey * 53) % 101 AS DOUBLE) AS cost_index, s_acctbal >= 0 AS active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
rated AS (
  SELECT b.*, coalesce(total_orders, 0) AS total_orders,
         coalesce(delayed_orders, 0) AS delayed_orders,
         {_scaled('coalesce(mean_days, 5.0::DOUBLE)', 1)} AS average_delivery_days,
         CASE WHEN coalesce(total_orders, 0) > 0
              THEN {_exact('1::DOUBLE - CAST(delayed_orders AS DOUBLE) / total_orders', 3)}
              ELSE 0::DOUBLE END AS on_time_rate
  FROM base_suppliers b LEFT JOIN rollup_counts USING (supplier_id)),
risked AS (
  SELECT *, {_exact(
      'least(100::DOUBLE, (1::DOUBLE - on_time_rate) * 45::DOUBLE '
      '+ greatest(0::DOUBLE, average_delivery_days - 5::DOUBLE) * 2.2::DOUBLE '
      '+ greatest(0::DOUBLE, 85::DOUBLE - quality_score) * 0.6::DOUBLE '
      '+ greatest(0::DOUBLE, cost_index - 110::DOUBLE) * 0.15::DOUBLE)', 1)} AS risk_score
  FROM rated),
suppliers AS (
  SELECT *, CASE WHEN risk_score >= 55 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM'
                 ELSE 'LOW' END AS risk_level
  FROM risked)
"""

INVENTORY = """
inventory AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         (p_partkey * 37) % (p_size * 40) AS current_stock, p_size * 10 AS reorder_level,
         p_size * 40 AS monthly_demand, p_retailprice AS unit_cost
  FROM part)
"""

SUPPLIER_COLUMNS = (
    "supplier_id, supplier_name, category, location, quality_score, average_delivery_days, "
    "on_time_rate, cost_index, active, total_orders, delayed_orders, risk_score, risk_level"
)
ORDER_DATES = (
    "CAST(order_date AS VARCHAR) AS order_date, CAST(expected_delivery AS VARCHAR) AS "
    "expected_delivery, CAST(actual_delivery AS VARCHAR) AS actual_delivery"
)
ORDER_LIST = f"""
SELECT order_id, s_name AS supplier_name, product_id, quantity, priority, delivery_delay, status,
       {ORDER_DATES}
FROM supply_orders JOIN supplier ON supplier_id = s_suppkey
"""

RISK_SENTENCES = f"""
CASE WHEN on_time_rate >= 0.85 AND average_delivery_days <= 7 AND quality_score >= 85
          AND cost_index <= 115 THEN {_quote(NO_RISK_SENTENCE)}
ELSE concat_ws(' | ',
  CASE WHEN on_time_rate < 0.85 THEN 'On-time delivery rate is ' || {_percent('on_time_rate')}
       || ', below the 85% target.' END,
  CASE WHEN average_delivery_days > 7 THEN 'Average delivery time of ' || average_delivery_days
       || ' days exceeds the 7-day baseline.' END,
  CASE WHEN quality_score < 85 THEN 'Quality score of ' || quality_score
       || ' is below the 85 target.' END,
  CASE WHEN cost_index > 115 THEN 'Cost index of ' || cost_index
       || ' is above the category norm (110).' END) END
"""
RISK_PHRASES = f"""
CASE WHEN on_time_rate >= 0.85 AND average_delivery_days <= 7 AND quality_score >= 85
          AND cost_index <= 115 THEN {_quote(NO_RISK_PHRASE)}
ELSE concat_ws(', and ',
  CASE WHEN on_time_rate < 0.85 THEN 'an on-time delivery rate of only '
       || {_whole('on_time_rate * 100::DOUBLE')} || '%' END,
  CASE WHEN average_delivery_days > 7 THEN 'a longer-than-average delivery time of '
       || average_delivery_days || ' days' END,
  CASE WHEN quality_score < 85 THEN 'a below-target quality score of ' || quality_score END,
  CASE WHEN cost_index > 115 THEN 'an above-average cost index of ' || cost_index END) END
"""
STEPS = f"""
CASE risk_level WHEN 'HIGH' THEN {_quote(RECOMMENDATIONS['HIGH'])}
WHEN 'MEDIUM' THEN {_quote(RECOMMENDATIONS['MEDIUM'])} ELSE {_quote(RECOMMENDATIONS['LOW'])} END
"""

# --- trends -----------------------------------------------------------------

HALVES = f"""
ranked AS (
  SELECT supplier_id, status,
         row_number() OVER (
           PARTITION BY supplier_id
           ORDER BY order_date, {_spread('order_id')}, order_id, status = 'On Time') AS position,
         count(*) OVER (PARTITION BY supplier_id) AS n
  FROM done),
halves AS (
  SELECT supplier_id, n AS completed_orders,
         avg(CASE WHEN status = 'On Time' THEN 1.0 ELSE 0.0 END)
           FILTER (position <= n // 2) AS first_share,
         avg(CASE WHEN status = 'On Time' THEN 1.0 ELSE 0.0 END)
           FILTER (position > n // 2) AS second_share,
         1::DOUBLE - avg(CASE WHEN status = 'Delayed' THEN 1.0 ELSE 0.0 END)
           FILTER (position <= n // 2) AS first_kept,
         1::DOUBLE - avg(CASE WHEN status = 'Delayed' THEN 1.0 ELSE 0.0 END)
           FILTER (position > n // 2) AS second_kept
  FROM ranked GROUP BY supplier_id, n)
"""
LABELLED_TREND = f"""{HALVES},
labelled AS (
  SELECT supplier_id, completed_orders, first_kept AS first_rate, second_kept AS second_rate,
         (second_kept - first_kept) * 100::DOUBLE AS change
  FROM halves WHERE completed_orders >= 20),
trend AS (
  SELECT *, CASE WHEN change > 1 THEN 'improved' WHEN change < -1 THEN 'declined'
                 ELSE 'remained stable' END AS direction
  FROM labelled)
"""
DECLINE = """
span AS (SELECT min(order_date) AS low, max(order_date) AS high FROM done),
sides AS (
  SELECT supplier_id,
         avg(is_delayed) FILTER (2 * (order_date - low) <= high - low) AS delay_rate_first_half,
         avg(is_delayed) FILTER (2 * (order_date - low) > high - low) AS delay_rate_second_half
  FROM done, span GROUP BY supplier_id),
declines AS (
  SELECT *, delay_rate_second_half - delay_rate_first_half AS decline FROM sides
  WHERE delay_rate_first_half IS NOT NULL AND delay_rate_second_half IS NOT NULL)
"""

# --- analytic questions -----------------------------------------------------


def _wording(number: int, text: str) -> str:
    filled = _quote(text).replace("{number}", "' || (s_suppkey % 50 + 60) || '")
    filled = filled.replace("{name}", "' || s_name || '")
    return f"WHEN {number} THEN {filled}"


QUESTIONS = f"""
questions AS (
  SELECT s_suppkey AS qid, CASE s_suppkey % {len(QUESTION_WORDINGS)}
    {' '.join(_wording(i, text) for i, text in enumerate(QUESTION_WORDINGS))} END AS question
  FROM supplier),
routed AS (
  SELECT qid, question,
    CASE {' '.join(f"WHEN regexp_matches(lower(question), {_quote(pattern)}) THEN '{intent}'"
                   for intent, pattern in INTENT_PATTERNS)} END AS intent,
    nullif(regexp_extract(question, {_quote(NUMBER_PATTERN)}, 1), '') AS digits,
    CASE WHEN digits IS NOT NULL
      THEN least(coalesce(TRY_CAST(digits AS BIGINT), {MOST}), {MOST}) END AS number,
    coalesce(nullif(regexp_extract(question, {_quote(CODE_PATTERN)}, 1), ''),
             nullif(regexp_extract(question, {_quote(NAME_PATTERN)}, 1), '')) AS name
  FROM questions)
"""
SUPPLIER_SENTENCE = f"""
supplier_name || ' (' || supplier_id || '): on-time rate ' || {_percent('on_time_rate')}
|| ', avg delivery ' || average_delivery_days || ' days, quality score ' || quality_score
|| ', risk level ' || risk_level || ' (score ' || risk_score || ').'
"""


def _search(names: str) -> str:
    return f"""
matched AS (
  SELECT name, supplier_id, {SUPPLIER_SENTENCE} AS sentence
  FROM {names} JOIN suppliers
    ON contains(lower(supplier_name), lower(name))
    OR contains(lower(CAST(supplier_id AS VARCHAR)), lower(name))),
found AS (
  SELECT name, min(supplier_id) AS first_match, count(*) AS matches,
         arg_min(sentence, supplier_id) AS sentence
  FROM matched GROUP BY name),
searched AS (
  SELECT name, first_match, coalesce(matches, 0) AS matches,
         coalesce(sentence, 'No supplier found matching ''' || name || '''.') AS text
  FROM (SELECT DISTINCT name FROM {names}) LEFT JOIN found USING (name))
"""


STOCK_RATIO = """
ratios AS (
  SELECT category, avg(CAST(current_stock AS DOUBLE)
           / CASE WHEN reorder_level = 0 THEN 1 ELSE reorder_level END) AS ratio
  FROM inventory GROUP BY category)
"""
RECENT = """
recent AS (
  SELECT max(order_date) AS last_date, avg(full_days) AS avg_days, count(*) AS orders
  FROM done WHERE order_date >= (SELECT max(order_date) - 30 FROM done))
"""
ANSWERS = f"""
WITH {SUPPLIERS}, {INVENTORY}, {QUESTIONS}, {STOCK_RATIO}, {RECENT}, {DECLINE},
asked_names AS (
  SELECT DISTINCT name FROM routed WHERE intent = 'supplier_lookup' AND name IS NOT NULL),
{_search('asked_names')},
most AS (SELECT * FROM suppliers ORDER BY delayed_orders DESC, supplier_id LIMIT 1),
lowest AS (SELECT * FROM ratios ORDER BY ratio, category LIMIT 1),
worst AS (SELECT * FROM declines ORDER BY decline DESC, supplier_id LIMIT 1)
SELECT qid, intent, CASE
  WHEN intent IS NULL THEN {_quote(UNROUTED_TEXT)}
  WHEN intent = 'most_delayed_supplier' THEN (SELECT supplier_name || ' (' || supplier_id
    || ') has the highest number of delayed orders: ' || delayed_orders || ' delayed out of '
    || total_orders || ' total orders (' || {_percent('on_time_rate')} || ' on-time rate).'
    FROM most)
  WHEN intent = 'lowest_inventory_category' THEN (SELECT 'The ''' || category
    || ''' category has the lowest average stock-to-reorder-level ratio ('
    || printf('%.2f', {_exact('ratio', 2)})
    || 'x), meaning it is closest to running low on average across its products.' FROM lowest)
  WHEN intent = 'suppliers_above_delay_threshold' THEN 'Found '
    || (SELECT count(*) FROM suppliers WHERE delayed_orders > coalesce(number, 20))
    || ' supplier(s) with more than '
    || CASE WHEN number = {MOST} THEN ltrim(digits, '0') ELSE CAST(coalesce(number, 20) AS VARCHAR) END
    || ' delayed orders.'
  WHEN intent = 'average_delivery_time_period' THEN (SELECT
    'The average delivery time over the last 30 days of order data (ending ' || last_date
    || ') was ' || {_tenth('avg_days')} || ' days, based on ' || orders || ' completed orders.'
    FROM recent)
  WHEN intent = 'supplier_performance_decline' THEN coalesce((SELECT s_name || ' (' || supplier_id
    || ') shows the largest decline in performance: its delay rate increased by '
    || {_tenth('decline * 100::DOUBLE')} || ' percentage points from the first half to the '
    || 'second half of the available order history.'
    FROM worst JOIN supplier ON s_suppkey = supplier_id), {_quote(NO_DECLINE_TEXT)})
  WHEN name IS NULL THEN {_quote(NO_NAME_TEXT)}
  ELSE (SELECT text FROM searched s WHERE s.name = routed.name) END AS text
FROM routed
"""

# --- anomalies --------------------------------------------------------------

# The split of the completed orders, and suppliers that saw its training part only.
SPLIT = f"""
hashed AS (SELECT *, {_spread('order_id')} AS place FROM done),
positions AS (
  SELECT *, row_number() OVER (PARTITION BY is_delayed ORDER BY place, order_id) AS position,
         count(*) OVER (PARTITION BY is_delayed) AS n
  FROM hashed),
cuts AS (
  SELECT is_delayed, max((place, order_id)) FILTER (position <= n * 8 // 10) AS cut
  FROM positions GROUP BY is_delayed),
split_orders AS (
  SELECT hashed.*, CASE WHEN (place, order_id) <= cut THEN 'train' ELSE 'test' END AS split
  FROM hashed JOIN cuts USING (is_delayed)),
train_orders AS (SELECT * FROM split_orders WHERE split = 'train')
"""
TRAIN_SUPPLIERS = SUPPLIERS.replace(
    "rollup_counts AS (", SPLIT.strip() + ",\nrollup_counts AS ("
).replace("FROM done GROUP BY supplier_id", "FROM train_orders GROUP BY supplier_id")

SPIKES = f"""
months AS (
  SELECT supplier_id, strftime(order_date, '%Y-%m') AS month,
         avg(CAST(coalesce(delivery_delay, 0) AS DOUBLE)) AS x, count(*) AS n
  FROM done GROUP BY ALL),
month_counts AS (SELECT supplier_id, count(*) AS months FROM months GROUP BY supplier_id),
history AS (
  SELECT a.supplier_id, a.month, a.x, count(*) AS others, avg(b.x) AS mu,
         greatest(coalesce(stddev_samp(b.x), 0.5::DOUBLE), 0.5::DOUBLE) AS sigma
  FROM months a JOIN months b ON a.supplier_id = b.supplier_id AND a.month <> b.month
  JOIN month_counts c ON a.supplier_id = c.supplier_id
  WHERE c.months >= 4 AND a.n >= 3 AND b.n >= 3
  GROUP BY a.supplier_id, a.month, a.x),
spikes AS (
  SELECT supplier_id, s_name AS supplier_name, month,
         {_exact(_scaled('mu', 9), 1)} AS normal_avg_delay_days,
         {_exact(_scaled('x', 9), 1)} AS anomalous_avg_delay_days,
         {_exact(_scaled('(x - mu) / sigma', 9), 2)} AS z_score,
         'Delivery Delay Spike' AS type
  FROM history LEFT JOIN supplier ON s_suppkey = supplier_id
  WHERE others >= 3 AND x >= 2 AND (x - mu) / sigma >= 2 AND x > mu)
"""


def _forest(trees: int, sample: int, seed: int) -> str:
    """Isolation forest over supplier-months: grown by levels, walked by levels."""
    last = math.ceil(math.log2(sample))
    parts = [f"""
forest_months AS MATERIALIZED (
  SELECT supplier_id, strftime(order_date, '%Y-%m') AS month,
         avg(CAST(coalesce(delivery_delay, 0) AS DOUBLE)) AS x0,
         CAST(sum(is_delayed) AS DOUBLE) AS x1, CAST(count(*) AS DOUBLE) AS x2,
         {_spread(f"{_spread('supplier_id')} + {HALF_STEP} * "
                  "(any_value(year(order_date)) * 12 + any_value(month(order_date)))")} AS place
  FROM done GROUP BY supplier_id, month),
counted AS (SELECT count(*) AS n FROM forest_months),
drawn AS (
  SELECT tree, x0, x1, x2,
         row_number() OVER (PARTITION BY tree ORDER BY (place - (tree * {HASH_MULTIPLIER} + {seed})
             % {HASH_RANGE} + {HASH_RANGE}) % {HASH_RANGE}, supplier_id, month) AS place
  FROM forest_months, (SELECT unnest(range({trees})) AS tree)),
level0 AS MATERIALIZED (
  SELECT tree, 1::BIGINT AS node, x0, x1, x2 FROM drawn WHERE place <= {sample})"""]
    for depth in range(last + 1):
        choice = f"floor(hash * len(varying) / {HASH_RANGE}::DOUBLE)::INTEGER + 1"
        inner = "coalesce(split < cut.high, false)" if depth < last else "false"
        parts.append(f"""
spans{depth} AS (
  SELECT tree, node, count(*) AS n, ((tree * 1024 + node) * {HASH_MULTIPLIER} + {seed * HALF_STEP})
         % {HASH_RANGE} AS hash,
         list_filter([{{'k': 0, 'low': min(x0), 'high': max(x0)}},
                      {{'k': 1, 'low': min(x1), 'high': max(x1)}},
                      {{'k': 2, 'low': min(x2), 'high': max(x2)}}],
                     lambda f: f.high > f.low) AS varying
  FROM level{depth} GROUP BY tree, node),
cuts{depth} AS (SELECT tree, node, n, hash, varying[{choice}] AS cut FROM spans{depth}),
placed{depth} AS (
  SELECT *, cut.low + (cut.high - cut.low) * ({_spread('hash')} / {HASH_RANGE}::DOUBLE) AS split
  FROM cuts{depth}),
nodes{depth} AS MATERIALIZED (
  SELECT tree, node, CASE WHEN {inner} THEN cut.k ELSE -1 END AS feature, split,
         CAST(round_even(({depth} + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
           ELSE 2 * (ln(n - 1) + {EULER_GAMMA}) - 2 * (n - 1)::DOUBLE / n END)
           * {LENGTH_UNITS}, 0) AS BIGINT) AS units
  FROM placed{depth}),
level{depth + 1} AS MATERIALIZED (
  SELECT m.tree, node * 2 + CASE WHEN [x0, x1, x2][feature + 1] > split THEN 1 ELSE 0 END AS node,
         x0, x1, x2
  FROM level{depth} m JOIN nodes{depth} USING (tree, node) WHERE feature >= 0)""")
    nodes = " UNION ALL ".join(f"SELECT * FROM nodes{d}" for d in range(last + 1))
    parts.append(f"""
nodes AS MATERIALIZED ({nodes}),
walk0 AS (
  SELECT supplier_id, month, x0, x1, x2, tree, 1::BIGINT AS node
  FROM forest_months, (SELECT unnest(range({trees})) AS tree))""")
    for depth in range(last):
        parts.append(f"""
walk{depth + 1} AS (
  SELECT supplier_id, month, x0, x1, x2, w.tree, CASE WHEN feature < 0 THEN w.node
         ELSE w.node * 2 + CASE WHEN [x0, x1, x2][feature + 1] > split THEN 1 ELSE 0 END END AS node
  FROM walk{depth} w JOIN nodes USING (tree, node))""")
    norm = mean_path(sample)
    parts.append(f"""
paths AS (
  SELECT supplier_id, month, any_value(x0) AS x0, CAST(sum(units) AS BIGINT) AS units
  FROM walk{last} JOIN nodes USING (tree, node) GROUP BY supplier_id, month),
raw_scores AS MATERIALIZED (
  SELECT *, -pow(2::DOUBLE, -(units / {float(trees * LENGTH_UNITS)}::DOUBLE) / {norm}::DOUBLE)
           AS iso_raw
  FROM paths),
flags AS (
  SELECT supplier_id, coalesce(s_name, CAST(supplier_id AS VARCHAR)) AS supplier_name, month,
         {_exact('x0', 1)} AS avg_delay,
         {_exact('iso_raw - cut', 3)} AS isolation_forest_score,
         'Isolation Forest Flag (delay pattern)' AS type
  FROM raw_scores, (SELECT quantile_cont(iso_raw, {CONTAMINATION}) AS cut FROM raw_scores), counted
  LEFT JOIN supplier ON supplier_id = s_suppkey
  WHERE n >= {MIN_ROWS} AND iso_raw - cut < 0)""")
    return ",".join(parts)


FOREST = _forest(TREES, SAMPLE, SEED)


def _outliers(table: str, group: str, value: str, multiplier: float = 3) -> str:
    return f"""
bounds AS (
  SELECT {group}, quantile_cont({value}, 0.75)
           + {multiplier}::DOUBLE * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS upper_bound
  FROM {table} GROUP BY {group}
  HAVING count(*) >= 10 AND quantile_cont({value}, 0.75) <> quantile_cont({value}, 0.25)),
outliers AS (
  SELECT t.*, upper_bound FROM {table} t JOIN bounds USING ({group}) WHERE {value} > upper_bound)
"""


# --- delay model ------------------------------------------------------------

FEATURES = f"""{SUPPLIERS}, {INVENTORY},
features AS (
  SELECT order_id, done.supplier_id, done.product_id, on_time_rate, average_delivery_days,
         quality_score, risk_score, quantity, CAST(month(order_date) AS INTEGER) AS order_month,
         inventory.category, priority, is_delayed
  FROM done LEFT JOIN suppliers ON done.supplier_id = suppliers.supplier_id
  LEFT JOIN inventory ON done.product_id = inventory.product_id)
"""
RULE = f"""{FEATURES},
rule AS (
  SELECT is_delayed, CASE WHEN on_time_rate
           < (SELECT quantile_cont(on_time_rate, 0.5) FROM features) THEN 1 ELSE 0 END AS predicted
  FROM features),
cells AS (
  SELECT count(*) FILTER (is_delayed = 1 AND predicted = 1) AS tp,
         count(*) FILTER (is_delayed = 0 AND predicted = 1) AS fp,
         count(*) FILTER (is_delayed = 1 AND predicted = 0) AS fn,
         count(*) FILTER (is_delayed = 0 AND predicted = 0) AS tn
  FROM rule),
shares AS (
  SELECT *, tp + fp + fn + tn AS n,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p1,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r1,
         CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0 END AS p0,
         CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END AS r0
  FROM cells),
scores AS (
  SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1,
         CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
         CAST(tp + tn AS DOUBLE) / n AS accuracy
  FROM shares)
"""

# --- retrieval --------------------------------------------------------------


def _terms(name: str, source: str, key: str, text: str, bigrams: bool = True) -> str:
    """Terms per text, with repeats."""
    stops = ", ".join(_quote(w) for w in STOP_WORDS)
    pairs = f"""
  UNION ALL
  SELECT {key}, unnest(list_transform(range(1, len(words)),
                lambda i: words[i] || ' ' || words[i + 1])) AS term FROM {name}_words"""
    return f"""
{name}_words AS (
  SELECT {key}, list_filter(regexp_extract_all(lower({text}), '{TOKEN_PATTERN}'),
                lambda w: w NOT IN ({stops})) AS words
  FROM {source}),
{name}_terms AS (
  SELECT {key}, unnest(words) AS term FROM {name}_words{pairs if bigrams else ''}),
{name}_counts AS (SELECT {key}, term, count(*) AS tf FROM {name}_terms GROUP BY {key}, term)
"""


CHUNKS = f"""
chunk_lists AS (
  SELECT doc_id, list_filter({_windows('text')}, lambda p: p <> '') AS pieces FROM documents),
chunk_rows AS (
  SELECT doc_id, unnest(range(0, len(pieces))) AS chunk_no, unnest(pieces) AS text
  FROM chunk_lists),
chunks AS (
  SELECT doc_id * {PASSAGES_PER_DOCUMENT} + chunk_no AS passage, CAST(doc_id AS VARCHAR) AS doc,
         'N/A' AS section, text
  FROM chunk_rows)
"""


def _weights(name: str, key: str) -> str:
    return f"""
{name}_raw AS (SELECT {key}, term, tf * idf AS w FROM {name}_counts JOIN vocabulary USING (term)),
{name}_weights AS (
  SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)
"""


INDEX = f"""{CHUNKS}, {_terms('chunk', 'chunks', 'passage', 'text')},
vocabulary AS (
  SELECT term, ln((1 + (SELECT count(*) FROM chunks))::DOUBLE / (1 + count(*))) + 1 AS idf
  FROM chunk_counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 4000),
{_weights('chunk', 'passage')}
"""
HITS = f"""{INDEX}, {_terms('asked', 'benchmark', 'item_id', 'text')},
{_weights('asked', 'item_id')},
pairs AS (
  SELECT item_id AS qid, passage, round(sum(a.weight * c.weight), 9) AS score
  FROM asked_weights a JOIN chunk_weights c USING (term) GROUP BY item_id, passage),
ranked_pairs AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage) AS rank FROM pairs),
hits AS (
  SELECT qid, CAST(rank AS INTEGER) AS rank, passage, doc, section, text,
         round(score, 4) AS score
  FROM ranked_pairs JOIN chunks USING (passage) WHERE rank <= 3 AND score >= 0.2)
"""


def _spaced(x: str) -> str:
    return f"' ' || regexp_replace({_strip(x)}, '{SPACE_CLASS}+', ' ', 'g') || ' '"


LABELLED = f"""
spaced_documents AS (SELECT doc_id, {_spaced('text')} AS spaced FROM documents),
spaced_items AS (SELECT item_id, text, {_spaced('text')} AS spaced FROM benchmark),
labelled_questions AS (
  SELECT item_id AS qid, any_value(text) AS question,
         CAST(min(doc_id) AS VARCHAR) AS expected_doc, min(doc_id) IS NOT NULL AS answerable
  FROM spaced_items i LEFT JOIN spaced_documents d ON contains(d.spaced, i.spaced)
  GROUP BY item_id)
"""
ANSWERED = f"""{HITS}, {LABELLED},
answers AS (
  SELECT q.qid, any_value(question) AS question, any_value(expected_doc) AS expected_doc,
         any_value(answerable) AS answerable, count(rank) AS found,
         string_agg(doc || ' — ' || section || ' (score: ' || score || ')', '; ' ORDER BY rank)
           AS sources,
         string_agg(text, chr(10) ORDER BY rank) AS context,
         coalesce({_quote(EXTRACTIVE_LABEL)} || chr(10) || chr(10)
           || max(text) FILTER (rank = 1), {_quote(NOT_ENOUGH_INFO)}) AS answer
  FROM labelled_questions q LEFT JOIN hits h ON q.qid = h.qid
  GROUP BY q.qid)
"""


def _words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {_quote(WORD_PATTERN)}))"


GROUNDED = f"""
word_sets AS (
  SELECT qid, {_words('answer')} AS said, {_words('context')} AS given
  FROM answers WHERE context <> ''),
grounded AS (
  SELECT qid, CASE WHEN len(said) = 0 THEN 0::DOUBLE ELSE
    {_exact('CAST(len(list_intersect(said, given)) AS DOUBLE) / len(said)', 3)} END
    AS groundedness
  FROM word_sets)
"""
RELEVANT = f"""
{_terms('side_q', 'answers', 'qid', 'question', bigrams=False)},
{_terms('side_a', 'answers', 'qid', 'answer', bigrams=False)},
both_sides AS (
  SELECT coalesce(q.qid, a.qid) AS qid,
         coalesce(q.tf, 0) * CASE WHEN a.tf IS NULL THEN {RARE_IDF} ELSE 1 END AS q,
         coalesce(a.tf, 0) * CASE WHEN q.tf IS NULL THEN {RARE_IDF} ELSE 1 END AS a
  FROM side_q_counts q FULL JOIN side_a_counts a ON q.qid = a.qid AND q.term = a.term),
cosines AS (
  SELECT qid, CASE WHEN sum(q * q) > 0 AND sum(a * a) > 0
    THEN sum(q * a) / (sqrt(sum(q * q)) * sqrt(sum(a * a))) ELSE 0 END AS cosine
  FROM both_sides GROUP BY qid),
relevant AS (
  SELECT qid, {_exact(_scaled('coalesce(cosine, 0)::DOUBLE', 9), 3)} AS answer_relevance
  FROM answers LEFT JOIN cosines USING (qid))
"""
RECALL = """
recalls AS (
  SELECT q.qid, any_value(expected_doc) AS expected_doc,
         coalesce(string_agg(DISTINCT doc, ',' ORDER BY doc), '') AS retrieved_docs,
         coalesce(bool_or(doc = expected_doc), false) AS hit
  FROM labelled_questions q LEFT JOIN hits h ON q.qid = h.qid
  WHERE answerable GROUP BY q.qid)
"""

# --- instruction records ----------------------------------------------------


def _record(family: str, wordings: list[str], given: str, answer: str, source: str) -> str:
    number = FAMILIES.index(family)
    pick = f"({_spread('supplier_id')} // 4096 + {number}) % {len(wordings)} + 1"
    return f"""
{family}_records AS (
  SELECT '{family}' AS family, supplier_id, {_list(wordings)}[{pick}] AS instruction,
         {given} AS input, {answer} AS output
  FROM {source})"""


RATE = _whole("on_time_rate * 100::DOUBLE")
SUMMARY = _record(
    "summary", SUMMARY_WORDINGS,
    f"""'Supplier: ' || supplier_name || ' (' || supplier_id || ')' || chr(10)
    || 'On-time delivery: ' || {RATE} || '%' || chr(10)
    || 'Average delivery time: ' || average_delivery_days || ' days' || chr(10)
    || 'Quality score: ' || quality_score || chr(10)
    || 'Total orders: ' || total_orders || ', Delayed orders: ' || delayed_orders || chr(10)
    || 'Risk level: ' || risk_level""",
    f"""supplier_name || ' has completed ' || total_orders || ' orders with an on-time delivery '
    || 'rate of ' || {RATE} || '% and an average delivery time of ' || average_delivery_days
    || ' days. Quality score is ' || quality_score || ', and ' || delayed_orders
    || ' of its orders have been delayed. Overall risk is classified as ' || risk_level || '.'""",
    "suppliers",
)
RISK = _record(
    "risk", RISK_WORDINGS,
    f"""'Supplier: ' || supplier_name || chr(10) || 'Risk level: ' || risk_level
    || ' (score: ' || risk_score || ')' || chr(10) || 'On-time rate: ' || {RATE}
    || '%, Avg delivery: ' || average_delivery_days || ' days, Quality: ' || quality_score
    || ', Cost index: ' || cost_index""",
    f"""supplier_name || ' is classified as ' || risk_level || ' risk primarily due to '
    || {RISK_PHRASES} || '. ' || CASE WHEN risk_level <> 'LOW' THEN {_quote(ELEVATED_TEXT)}
    ELSE {_quote(RELIABLE_TEXT)} END""",
    "suppliers",
)
RECOMMEND = _record(
    "recommend", RECOMMEND_WORDINGS,
    "'Supplier: ' || supplier_name || chr(10) || 'Risk level: ' || risk_level",
    f"""'Supplier Risk: ' || risk_level || chr(10) || chr(10) || 'Possible actions:' || chr(10)
    || {STEPS}""",
    "suppliers",
)
EARLY, LATE = _whole("first_rate * 100::DOUBLE"), _whole("second_rate * 100::DOUBLE")
TREND = _record(
    "trend", TREND_WORDINGS,
    f"""'Supplier: ' || s_name || chr(10) || 'Earlier on-time rate: ' || {EARLY} || '%'
    || chr(10) || 'Recent on-time rate: ' || {LATE} || '%'""",
    f"""s_name || '''s on-time delivery rate ' || direction || ' from ' || {EARLY} || '% to '
    || {LATE} || '% (' || CASE WHEN change < 0 THEN '-' ELSE '+' END || {_tenth('abs(change)')}
    || ' percentage points). ' || CASE direction WHEN 'declined' THEN {_quote(REVIEW_TEXT)}
    ELSE {_quote(MONITOR_TEXT)} END""",
    "trend JOIN supplier ON s_suppkey = supplier_id",
)
RECORDS = f"""{SUPPLIERS}, {LABELLED_TREND}, {SUMMARY}, {RISK}, {RECOMMEND}, {TREND},
all_records AS (
  SELECT * FROM summary_records UNION ALL SELECT * FROM risk_records
  UNION ALL SELECT * FROM recommend_records UNION ALL SELECT * FROM trend_records),
numbered AS (
  SELECT *, supplier_id * {len(FAMILIES)} + list_position({_list(FAMILIES)}, family) - 1
         AS record_id
  FROM all_records),
placed AS (
  SELECT *, row_number() OVER (ORDER BY {_spread('record_id')}) AS place, count(*) OVER () AS n
  FROM numbered),
records AS (
  SELECT family, supplier_id, instruction, input, output, record_id,
         CASE WHEN place <= n * 9 // 10 THEN 'train' ELSE 'validation' END AS split
  FROM placed)
"""

# --- the queries ------------------------------------------------------------


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


QUANTITIES = f"""{_outliers('supply_orders', 'product_id', 'quantity', 0.4)},
quantities AS (
  SELECT order_id, product_id, supplier_id, quantity,
         {_exact('upper_bound', 1)} AS upper_bound_iqr, 'Unusual Order Quantity' AS type
  FROM outliers)
"""

ORACLE_SQL: dict[str, str] = {
    "table_scan": "SELECT * FROM part",
    "doc_titles": r"""
SELECT doc_id, array_to_string(list_transform(
    regexp_extract_all(lower(source || ' ' || lang), '\p{L}+|[^\p{L}]+'),
    lambda w: upper(w[1]) || w[2:]), '') AS title
FROM documents""",
    "completed_orders": f"""
WITH {ORDERS}
SELECT order_id, supplier_id, product_id, quantity, status, delivery_delay, {ORDER_DATES}
FROM done""",
    "low_stock": f"""
WITH {INVENTORY}
SELECT product_id, product_name, current_stock, reorder_level FROM inventory
WHERE current_stock < reorder_level""",
    "inventory_status": f"""
WITH {INVENTORY}
SELECT *, CASE WHEN current_stock < reorder_level THEN 'LOW STOCK' ELSE 'OK' END AS status
FROM inventory""",
    "supplier_filter": f"""
WITH {SUPPLIERS}
SELECT supplier_id, supplier_name, category, location, on_time_rate, average_delivery_days,
       quality_score, risk_level, risk_score
FROM suppliers
WHERE category IN ('AFRICA', 'ASIA', 'EUROPE') AND risk_level IN ('MEDIUM', 'HIGH')
  AND supplier_name ILIKE '%lier#%'""",
    "order_filter": f"""
WITH {ORDERS} {ORDER_LIST}
WHERE status IN ('Delayed', 'In Transit') AND priority IN ('Urgent', 'High')""",
    "order_list": f"WITH {ORDERS} {ORDER_LIST}",
    "supplier_search": f"""
WITH {SUPPLIERS},
asked AS (SELECT 'LIER#' || string_split(s_name, '#')[2] AS name FROM supplier),
{_search('asked')}
SELECT * FROM searched""",
    "supplier_matches": """
SELECT DISTINCT right(a.s_name, 2) AS name, b.s_suppkey AS supplier_id, b.s_name AS supplier_name
FROM supplier a JOIN supplier b
  ON contains(lower(b.s_name), lower(right(a.s_name, 2)))
  OR contains(CAST(b.s_suppkey AS VARCHAR), lower(right(a.s_name, 2)))""",
    "dashboard_kpis": f"""
WITH {SUPPLIERS}, {INVENTORY},
kpis AS (
  SELECT (SELECT count(*) FROM suppliers) AS total_suppliers,
         (SELECT count(*) FROM suppliers WHERE active) AS active_suppliers,
         (SELECT avg(average_delivery_days) FROM suppliers) AS avg_delivery_days,
         (SELECT count(*) FROM suppliers WHERE risk_level = 'HIGH') AS high_risk_suppliers,
         (SELECT count(*) FROM suppliers WHERE risk_level = 'MEDIUM') AS medium_risk_suppliers,
         (SELECT avg(CASE WHEN status = 'On Time' THEN 1.0 ELSE 0.0 END) FROM done)
           AS on_time_share,
         (SELECT count(*) FROM done WHERE status = 'Delayed') AS delayed_orders,
         (SELECT count(*) FROM inventory WHERE current_stock < reorder_level)
           AS low_stock_products,
         (SELECT sum(current_stock * unit_cost) FROM inventory) AS inventory_value)
SELECT * REPLACE ({_rounded('avg_delivery_days', 'on_time_share', 'inventory_value')}),
       {_tenth('avg_delivery_days')} || ' days' AS avg_delivery_text,
       {_percent('on_time_share')} AS on_time_text,
       '$' || format('{{:,}}', CAST(round_even(inventory_value, 0) AS BIGINT))
         AS inventory_value_text
FROM kpis""",
    "risk_distribution": f"""
WITH {SUPPLIERS}
SELECT level AS risk_level, count(supplier_id) AS suppliers
FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) levels(level)
LEFT JOIN suppliers ON risk_level = level GROUP BY level""",
    "status_breakdown": f"""
WITH {ORDERS} SELECT status, count(*) AS orders FROM supply_orders GROUP BY status""",
    "monthly_delay_rate": f"""
WITH {ORDERS}
SELECT strftime(order_date, '%Y-%m') AS month, round(avg(is_delayed) * 100, 6) AS delay_rate_pct
FROM done GROUP BY month""",
    "stock_by_category": f"""
WITH {INVENTORY}
SELECT category, CAST(sum(current_stock) AS BIGINT) AS current_stock,
       CAST(sum(reorder_level) AS BIGINT) AS reorder_level
FROM inventory GROUP BY category""",
    "inventory_value_by_category": f"""
WITH {INVENTORY}
SELECT category, round(sum(current_stock * unit_cost), 2) AS value
FROM inventory GROUP BY category""",
    "recent_alerts": f"""
WITH {SUPPLIERS}, {INVENTORY},
high AS (
  SELECT 0 AS kind, supplier_id AS id, '🔴 **' || supplier_name || '** is HIGH risk (score '
         || risk_score || ')' AS alert
  FROM suppliers WHERE risk_level = 'HIGH'),
low AS (
  SELECT 1 AS kind, product_id AS id, '🟡 **' || product_name || '** is below reorder level ('
         || current_stock || ' / ' || reorder_level || ')' AS alert
  FROM inventory WHERE current_stock < reorder_level ORDER BY product_id LIMIT 5)
SELECT * FROM (SELECT * FROM high UNION ALL SELECT * FROM low) ORDER BY kind, id LIMIT 10""",
    "supplier_scorecard": f"WITH {SUPPLIERS} SELECT {SUPPLIER_COLUMNS} FROM suppliers",
    "risk_score": f"WITH {SUPPLIERS} SELECT supplier_id, risk_score, risk_level FROM suppliers",
    "risk_reasons": f"""
WITH {SUPPLIERS}
SELECT supplier_id, {RISK_SENTENCES} AS sentences, {RISK_PHRASES} AS phrases FROM suppliers""",
    "recommendations": f"""
WITH {SUPPLIERS} SELECT supplier_id, risk_level, {STEPS} AS steps FROM suppliers""",
    "supplier_profile": f"""
WITH {SUPPLIERS}
SELECT supplier_id, supplier_name, category, location,
       {_percent('on_time_rate')} AS on_time_percent, average_delivery_days, quality_score,
       total_orders, delayed_orders, cost_index, risk_level, risk_score
FROM suppliers""",
    "supplier_trend": f"""
WITH {ORDERS}, {HALVES},
changes AS (
  SELECT supplier_id, completed_orders, first_share AS first_rate, second_share AS second_rate,
         (second_share - first_share) * 100::DOUBLE AS change
  FROM halves WHERE completed_orders >= 10),
worded AS (
  SELECT *, CASE WHEN change > 0 THEN 'increased' ELSE 'decreased' END AS direction,
         change < -5 AS concern
  FROM changes)
SELECT supplier_id, completed_orders, {_rounded('first_rate', 'second_rate', 'change')},
       direction, concern,
       'The supplier''s on-time delivery rate ' || direction || ' from ' || {EARLY} || '% to '
       || {LATE} || '% comparing the first and second half of its order history. '
       || CASE WHEN concern THEN {_quote(CONCERN_TEXT)} ELSE {_quote(STEADY_TEXT)} END AS insight
FROM worded""",
    "supplier_trend_label": f"""
WITH {ORDERS}, {LABELLED_TREND}
SELECT supplier_id, completed_orders, {_rounded('first_rate', 'second_rate', 'change')}, direction
FROM trend""",
    "performance_decline": f"""
WITH {ORDERS}, {DECLINE}
SELECT supplier_id, {_rounded('delay_rate_first_half', 'delay_rate_second_half', 'decline')}
FROM (SELECT * FROM declines ORDER BY declines.decline DESC, supplier_id LIMIT 10)""",
    "route_questions": f"WITH {QUESTIONS} SELECT * EXCLUDE (digits) FROM routed",
    "most_delayed": f"""
WITH {SUPPLIERS}
SELECT supplier_id, supplier_name, delayed_orders, total_orders, on_time_rate FROM suppliers
ORDER BY delayed_orders DESC, supplier_id LIMIT 5""",
    "lowest_inventory_category": f"""
WITH {INVENTORY}, {STOCK_RATIO}
SELECT category, round(ratio, 6) AS avg_stock_to_reorder_ratio FROM ratios""",
    "above_delay_threshold": f"""
WITH {SUPPLIERS}
SELECT supplier_id, supplier_name, delayed_orders, total_orders, on_time_rate FROM suppliers
WHERE delayed_orders > 95""",
    "recent_delivery_time": f"""
WITH {ORDERS}, {RECENT}
SELECT CAST(last_date AS VARCHAR) AS last_date, round(avg_days, 6) AS avg_days, orders
FROM recent""",
    "answer_questions": ANSWERS,
    "supplier_months": f"""
WITH {ORDERS}
SELECT supplier_id, strftime(order_date, '%Y-%m') AS month,
       round(avg(CAST(coalesce(delivery_delay, 0) AS DOUBLE)), 6) AS avg_delay,
       CAST(sum(is_delayed) AS BIGINT) AS delayed_count, count(*) AS order_count
FROM done GROUP BY supplier_id, month""",
    "delay_spikes": f"WITH {ORDERS}, {SPIKES} SELECT * FROM spikes",
    "spike_headlines": f"""
WITH {ORDERS}, {SPIKES}
SELECT * FROM spikes ORDER BY z_score DESC, supplier_id, month LIMIT 15""",
    "quantity_outliers": f"WITH {ORDERS}, {QUANTITIES} SELECT * FROM quantities",
    "value_outliers": f"""
WITH {_outliers('events', 'user_id', 'value')}
SELECT event_id, user_id, event_type, value, round(upper_bound, 6) AS upper_bound FROM outliers""",
    "isolation_forest": f"WITH {ORDERS}, {FOREST} SELECT * FROM flags",
    "anomaly_agreement": f"""
WITH {ORDERS}, {SPIKES}, {FOREST}
SELECT coalesce(s.supplier_id, f.supplier_id) AS supplier_id, coalesce(s.month, f.month) AS month,
       z_score, isolation_forest_score,
       CASE WHEN isolation_forest_score IS NULL THEN 'z_score'
            WHEN z_score IS NULL THEN 'isolation_forest' ELSE 'both' END AS found_by
FROM spikes s FULL JOIN flags f ON s.supplier_id = f.supplier_id AND s.month = f.month""",
    "anomaly_report": f"""
WITH {ORDERS}, {INVENTORY}, {SPIKES}, {QUANTITIES}, {FOREST}
SELECT 'delivery_delay_anomalies' AS section,
       row_number() OVER (ORDER BY z_score DESC, supplier_id, month) AS position,
       to_json(s)::VARCHAR AS record FROM spikes s
UNION ALL
SELECT 'order_quantity_anomalies', row_number() OVER (ORDER BY product_id, order_id),
       to_json(q)::VARCHAR FROM quantities q
UNION ALL
SELECT 'isolation_forest_anomalies',
       row_number() OVER (ORDER BY isolation_forest_score, supplier_id, month),
       to_json(f)::VARCHAR FROM flags f
UNION ALL
SELECT 'low_stock_products', row_number() OVER (ORDER BY product_id), to_json(p)::VARCHAR
FROM (SELECT product_id, product_name, current_stock, reorder_level FROM inventory
      WHERE current_stock < reorder_level) p""",
    "delay_features": f"WITH {FEATURES} SELECT * FROM features",
    "median_impute": f"""
WITH {FEATURES},
masked AS (
  SELECT * REPLACE (CASE WHEN on_time_rate >= 0.8 THEN on_time_rate END AS on_time_rate,
                    CASE WHEN quantity >= 10 THEN quantity END AS quantity)
  FROM features)
SELECT order_id, {', '.join(
    f"round(coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM masked)), 6) AS {c}"
    for c in NUMERIC)}
FROM masked""",
    "stratified_split": f"""
WITH {ORDERS}, {SPLIT} SELECT order_id, is_delayed, split FROM split_orders""",
    "train_only_features": f"""
WITH {TRAIN_SUPPLIERS}, {INVENTORY}
SELECT order_id, o.supplier_id, o.product_id, on_time_rate, average_delivery_days, quality_score,
       risk_score, quantity, CAST(month(order_date) AS INTEGER) AS order_month,
       inventory.category, priority, is_delayed, split
FROM split_orders o LEFT JOIN suppliers ON o.supplier_id = suppliers.supplier_id
LEFT JOIN inventory ON o.product_id = inventory.product_id""",
    "rule_metrics": f"""
WITH {RULE}
SELECT {_exact('accuracy', 4)} AS accuracy, {_exact('p1', 4)} AS precision,
       {_exact('r1', 4)} AS recall, {_exact('f1', 4)} AS f1_score, 0 AS n_train, n AS n_test,
       {_exact('CAST(tp + fn AS DOUBLE) / n', 4)} AS positive_rate_test
FROM scores""",
    "rule_confusion_matrix": f"""
WITH {RULE}
SELECT actual, predicted, orders FROM (
  SELECT unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted,
         unnest([tn, fp, fn, tp]) AS orders FROM cells)""",
    "rule_classification_report": f"""
WITH {RULE},
report AS (
  SELECT '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1_score, tn + fp AS support FROM scores
  UNION ALL SELECT '1', p1, r1, f1, tp + fn FROM scores
  UNION ALL SELECT 'accuracy', NULL, NULL, accuracy, n FROM scores
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM scores
  UNION ALL SELECT 'weighted avg', (p0 * (tn + fp) + p1 * (tp + fn)) / n,
    (r0 * (tn + fp) + r1 * (tp + fn)) / n, (f0 * (tn + fp) + f1 * (tp + fn)) / n, n FROM scores)
SELECT row, {_rounded('precision', 'recall', 'f1_score')}, support FROM report""",
    "chunk_sections": f"""
WITH marked AS (
  SELECT doc_id,
         regexp_replace(text, '(?m)^([^ \\n]+( [^ \\n]+){{0,2}})$', '## \\1', 'g') AS text
  FROM documents),
parts AS (
  SELECT doc_id, text, string_split(
           regexp_replace(text, '(?m)^(## .+)$', chr(1) || '\\1', 'g'), chr(1)) AS parts
  FROM marked),
pieces AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS part_no, unnest(parts) AS part
  FROM parts WHERE len(parts) > 1),
sections AS (
  SELECT doc_id, part_no, part,
         {_strip("regexp_replace(" + _strip("regexp_extract(part, '^[^\\n]*')") + ", '^#+', '')")}
           AS name,
         {_strip("regexp_replace(part, '^[^\\n]*', '')")} AS body
  FROM pieces),
texts AS (
  SELECT doc_id, part_no, CASE WHEN part_no = 1 THEN 'Preamble' ELSE name END AS section,
         CASE WHEN part_no = 1 THEN {_strip('part')} ELSE name || chr(10) || body END AS full_text
  FROM sections),
listed AS (
  SELECT doc_id, part_no, section,
         CASE WHEN part_no = 1 OR length(full_text) <= 500 THEN [full_text]
              ELSE {_windows('full_text')} END AS windows
  FROM texts
  UNION ALL
  SELECT doc_id, 1, 'N/A', {_windows('text')} FROM parts WHERE len(parts) = 1),
flat AS (
  SELECT doc_id, part_no, section, generate_subscripts(windows, 1) AS window_no,
         unnest(windows) AS text
  FROM listed)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part_no, window_no) - 1
         AS INTEGER) AS chunk_no, section, text
FROM flat WHERE text <> ''""",
    "chunk_windows": f"""
WITH {CHUNKS}
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, 'N/A' AS section, text FROM chunk_rows""",
    "term_counts": f"""
WITH {_terms('document', 'documents', 'doc_id', 'text')}
SELECT doc_id, term, tf FROM document_counts""",
    "tfidf_weights": f"""
WITH {INDEX} SELECT passage, term, round(weight, 6) AS weight FROM chunk_weights""",
    "index_summary": f"""
WITH {CHUNKS}
SELECT 'tfidf' AS backend, count(*) AS n_chunks, count(DISTINCT doc) AS n_documents FROM chunks""",
    "retrieve_topk": f"WITH {HITS} SELECT qid, rank, passage, doc, score FROM hits",
    "dense_topk": """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE
           / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
  FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS score
  FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs WHERE score >= 0.2)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score
FROM ranked WHERE rank <= 3""",
    "extractive_answers": f"""
WITH {ANSWERED}
SELECT qid, answer, coalesce(sources, '') AS sources,
       CASE WHEN found = 0 THEN 'no_retrieval' ELSE 'extractive' END AS mode
FROM answers""",
    "qa_context": f"""
WITH {HITS}
SELECT qid, string_agg('[Source: ' || doc || ' — ' || section || ']' || chr(10) || text,
                       chr(10) || chr(10) ORDER BY rank) AS context
FROM hits GROUP BY qid""",
    "recall_at_k": f"WITH {HITS}, {LABELLED}, {RECALL} SELECT * FROM recalls",
    "groundedness": f"WITH {ANSWERED}, {GROUNDED} SELECT * FROM grounded",
    "answer_relevance": f"WITH {ANSWERED}, {RELEVANT} SELECT * FROM relevant",
    "qa_evaluation": f"""
WITH {ANSWERED}, {GROUNDED}, {RELEVANT}, {RECALL},
summary AS (
  SELECT (SELECT avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FROM recalls) AS recall,
         (SELECT avg(groundedness) FROM grounded JOIN answers USING (qid) WHERE answerable) AS g,
         (SELECT avg(answer_relevance) FROM relevant JOIN answers USING (qid)
          WHERE answerable AND found > 0) AS r,
         (SELECT avg(CASE WHEN answer = {_quote(NOT_ENOUGH_INFO)} THEN 1.0 ELSE 0.0 END)
          FROM answers WHERE NOT answerable) AS refused)
SELECT {_exact('recall', 3)} AS retrieval_recall_at_k, 3 AS top_k,
       {_exact(_scaled('g', 9), 3)} AS groundedness,
       {_exact(_scaled('r', 9), 3)} AS answer_relevance,
       {_exact('refused', 3)} AS correct_refusal_rate,
       {_quote(GENERATION_BACKEND)} AS generation_backend
FROM summary""",
    "instr_summary": f"WITH {SUPPLIERS}, {SUMMARY} SELECT * FROM summary_records",
    "instr_risk": f"WITH {SUPPLIERS}, {RISK} SELECT * FROM risk_records",
    "instr_recommend": f"WITH {SUPPLIERS}, {RECOMMEND} SELECT * FROM recommend_records",
    "instr_trend": f"WITH {ORDERS}, {LABELLED_TREND}, {TREND} SELECT * FROM trend_records",
    "instruction_split": f"WITH {RECORDS} SELECT * FROM records",
    "chat_records": f"""
WITH {RECORDS}
SELECT record_id, split, 0 AS position, 'system' AS role, {_quote(SYSTEM_PROMPT)} AS content
FROM records
UNION ALL
SELECT record_id, split, 1, 'user', CASE WHEN coalesce(input, '') <> ''
  THEN instruction || chr(10) || chr(10) || input ELSE instruction END FROM records
UNION ALL
SELECT record_id, split, 2, 'assistant', output FROM records""",
}
