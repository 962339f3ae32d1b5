"""Oracle SQL of this subpackage's queries, for those that SQL can express."""

from __future__ import annotations

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters(count: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, from one row per component."""
    steps = [
        f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE {FINITE} AND len(embedding) = 64
),
parts AS MATERIALIZED (
    SELECT r, unnest(range(64)) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
),
first AS (
    SELECT r, row_number() OVER (ORDER BY sha256('{2}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {count}
),
centroids0 AS MATERIALIZED (SELECT c, i, CAST(x AS HUGEINT) AS x FROM first JOIN parts USING (r))"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""
near{k} AS MATERIALIZED (
    SELECT r, c, d FROM (
        SELECT p.r, q.c, sum((p.x - q.x) * (p.x - q.x)) AS d FROM parts p JOIN centroids{k} q USING (i) GROUP BY p.r, q.c
    ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""
        )
        if k < rounds:
            steps.append(
                f"""
sums{k} AS (SELECT n.c, p.i, sum(p.x) AS s, count(*) AS n FROM near{k} n JOIN parts p USING (r) GROUP BY ALL),
centroids{k + 1} AS MATERIALIZED (
    SELECT q.c, q.i, CASE WHEN s.n IS NULL THEN q.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x
    FROM centroids{k} q LEFT JOIN sums{k} s ON s.c = q.c AND s.i = q.i
)"""
            )
    return f"""
WITH {",".join(steps)},
codes AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS code FROM centroids{rounds} GROUP BY c)
SELECT k.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
    CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
    codes.code AS centroid_sha256
FROM near{rounds} n JOIN kept k USING (r) JOIN codes ON codes.c = n.c
"""


NEGATIVES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        embedding
    FROM embeddings WHERE {FINITE} AND label IS NOT NULL
),
parts AS MATERIALIZED (
    SELECT r, unnest(range(len(embedding))) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
    FROM kept
),
scores AS MATERIALIZED (
    SELECT a.r AS a, b.r AS b, sum(p.x * q.x) AS score
    FROM kept a JOIN parts p ON p.r = a.r JOIN parts q ON q.i = p.i JOIN kept b ON b.r = q.r
    WHERE a.vec_id % 50 = 0 AND a.r <> b.r GROUP BY ALL
),
positives AS (
    SELECT s.a, s.b, s.score FROM scores s JOIN kept k ON k.r = s.a JOIN kept o ON o.r = s.b AND o.label = k.label
    QUALIFY row_number() OVER (PARTITION BY s.a ORDER BY s.score DESC, o.vec_id) <= 5
),
found AS (
    SELECT p.a, p.b, p.score AS positive_score, s.score AS negative_score, o.vec_id AS negative_id,
        row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, o.vec_id) AS place
    FROM positives p JOIN kept k ON k.r = p.a JOIN scores s ON s.a = p.a
        JOIN kept o ON o.r = s.b AND o.label <> k.label
    WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY place <= 3
)
SELECT a.vec_id AS anchor_id, b.vec_id AS positive_id, CAST(place AS INTEGER) AS rank, negative_id,
    CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM found f JOIN kept a ON a.r = f.a JOIN kept b ON b.r = f.b
"""

URL_RULES = """
WITH rests AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0
        THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
),
urls AS (
    SELECT row_number() OVER () AS r, page_id,
        translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM rests
),
rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM urls LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_ptolemaic_clusters": _clusters(),
        "op12_packed_negatives": NEGATIVES,
        "op13_url_rules": URL_RULES,
    }
