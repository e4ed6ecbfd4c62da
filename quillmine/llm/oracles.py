"""SQL for those operators of this subpackage that SQL can express."""

from __future__ import annotations


def ball_kmeans_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Plain k-means, every vector against every centroid, a query for each round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
 FROM embeddings WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = {size})""",
        "parts AS MATERIALIZED (SELECT row_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster FROM kept QUALIFY cluster < {k})",
        "centres_0 AS MATERIALIZED (SELECT cluster, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM first)",
    ]
    for i in range(rounds + 1):
        parts += [
            f"far_{i} AS (SELECT row_id, cluster, sum((x - c) * (x - c)) AS d FROM parts JOIN centres_{i} USING (pos) GROUP BY row_id, cluster)",
            f"near_{i} AS MATERIALIZED (SELECT row_id, cluster, d FROM far_{i} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster) = 1)",
        ]
        if i < rounds:
            parts += [
                f"sums_{i} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM near_{i} JOIN parts USING (row_id) GROUP BY cluster, pos)",
                f"""centres_{i + 1} AS MATERIALIZED (SELECT o.cluster, o.pos, CASE WHEN n IS NULL THEN o.c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
 FROM centres_{i} o LEFT JOIN sums_{i} USING (cluster, pos))""",
            ]
    return f"""WITH {", ".join(parts)},
sums AS (SELECT cluster, sum(d) AS inertia FROM near_{rounds} GROUP BY cluster),
names AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS name FROM centres_{rounds} GROUP BY cluster)
SELECT vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s.inertia AS BIGINT) AS cluster_inertia,
 CAST((SELECT sum(inertia) FROM sums) AS BIGINT) AS inertia, name AS centroid_sha256
FROM near_{rounds} n JOIN kept USING (row_id) JOIN sums s USING (cluster) JOIN names USING (cluster)"""


_ENDINGS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked_search_sql(k: int = 10) -> str:
    """Every term of every document, joined with those of the items."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{_ENDINGS}')) AS term"
    return f"""WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
words AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, {terms} FROM docs) GROUP BY d, term),
sizes AS MATERIALIZED (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM words GROUP BY d),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM words, whole GROUP BY term, docs),
scores AS (SELECT item_id, d, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
 FROM asked JOIN weights USING (term) JOIN words USING (term) JOIN sizes USING (d), whole GROUP BY item_id, d)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN docs USING (d) WHERE score > 0 QUALIFY rank <= {k}"""
