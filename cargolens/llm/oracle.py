"""SQL counterparts of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINK = "(?i)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>"
_META = "(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>"

OP2 = f"""
WITH RECURSIVE rules(host, path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
           ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), raw AS (
    SELECT url AS src, unnest([
        regexp_extract(regexp_extract(html, '{_LINK}', 0),
                       '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
        regexp_extract(regexp_extract(html, '{_META}', 0),
                       '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS dst
    FROM pages WHERE url IS NOT NULL
), links AS (
    SELECT src, CASE
        WHEN dst LIKE '//%' THEN regexp_extract(src, '^([^:/?#]*:)//', 1) || dst
        WHEN dst LIKE '/%' THEN regexp_extract(src, '^([^:/?#]*://[^/?#]*)', 1) || dst
        ELSE dst END AS dst
    FROM raw
), urls AS (
    SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT src FROM links
                              UNION ALL SELECT dst FROM links WHERE contains(dst, '://'))
    WHERE url IS NOT NULL
), parsed AS (
    SELECT url,
        translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS rest
    FROM urls
), ruled AS (
    SELECT p.url, p.host, p.path, CASE WHEN p.host <> '' THEN p.host || p.rest END AS address,
        max_by(r.host || r.path, length(r.host || r.path)) AS rule,
        max_by(r.verdict, length(r.host || r.path)) AS decision
    FROM parsed p LEFT JOIN rules r
        ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY ALL
), edges AS (
    SELECT DISTINCT a.address AS a, b.address AS b
    FROM links l JOIN ruled a ON l.src = a.url JOIN ruled b ON l.dst = b.url
    WHERE a.address <> b.address
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (
    SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), blocked AS (
    SELECT r.a AS address, min(s.b) AS via
    FROM reach r JOIN ruled u ON u.address = r.b AND u.decision = 'block'
    JOIN reach s ON s.a = r.a
    GROUP BY r.a
)
SELECT p.page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, u.rule,
    coalesce(u.decision, CASE WHEN b.address IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
    CASE WHEN u.rule IS NULL THEN b.via END AS via
FROM pages p LEFT JOIN ruled u ON p.url = u.url LEFT JOIN blocked b ON u.address = b.address
"""

OP4 = f"""
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
"""

OP12 = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                       ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
    n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""

ORACLE_SQL = {"op12_hard_negatives": OP12, "op2_redirect_rules": OP2, "op4_exact_dedup": OP4}
