"""SQL of the training-data queries that DuckDB can state."""

from __future__ import annotations

# Vectors whose components are all there and finite, as whole numbers; r tells repeated rows apart.
_KEPT = """
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding){sized}
)"""


def _gap(a: str, b: str) -> str:
    """Squared distance of two lists of whole numbers; every term is exact in a double."""
    return f"(list_inner_product({a}, {a}) - 2 * list_inner_product({a}, {b}) + list_inner_product({b}, {b}))::BIGINT"


def centroid_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    parts = [_KEPT.format(sized=f" AND len(embedding) = {dims}")]
    parts.append(f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, vec_id, v) - 1 AS c, v AS m FROM kept
  ORDER BY c LIMIT {k}
)""")
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, x % {k} AS c, x // {k} AS d FROM (SELECT r, min({_gap('v', 'm')} * {k} + c) AS x FROM kept, c{i} GROUP BY r)
)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  WITH cells AS (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (
    SELECT c, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM kept JOIN a{i} USING (r)) GROUP BY c, i),
  moved AS (SELECT c, list(m ORDER BY i) AS m FROM cells GROUP BY c)
  SELECT c, coalesce(moved.m, c{i}.m) AS m FROM c{i} LEFT JOIN moved USING (c)
)""")
    return f"""WITH {','.join(parts)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} USING (c)"""


def code_sql(parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64) -> str:
    width = dims // parts
    ctes = [_KEPT.format(sized=""), f"""
pieces AS MATERIALIZED (
  SELECT r, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM kept, range({parts}) t(p)
)""", f"""
starts AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept),
b0 AS MATERIALIZED (SELECT p, e, x AS m FROM pieces JOIN starts USING (r) WHERE e < {entries})"""]
    for i in range(rounds + 1):
        ctes.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, p, s % {entries} AS e, s // {entries} AS d FROM (
    SELECT r, p, min({_gap('x', 'm')} * {entries} + e) AS s FROM pieces JOIN b{i} USING (p) GROUP BY r, p)
)""")
        if i < rounds:
            ctes.append(f"""
b{i + 1} AS MATERIALIZED (
  WITH cells AS (SELECT p, e, i, floor(sum(x) / count(*)) AS m FROM (
    SELECT p, e, unnest(x) AS x, unnest(range(1, {width + 1})) AS i FROM pieces JOIN a{i} USING (r, p)) GROUP BY p, e, i),
  moved AS (SELECT p, e, list(m ORDER BY i) AS m FROM cells GROUP BY p, e)
  SELECT p, e, coalesce(moved.m, b{i}.m) AS m FROM b{i} LEFT JOIN moved USING (p, e)
)""")
    return f"""WITH {','.join(ctes)},
coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(m, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), book"""
