"""DuckDB SQL of the operators on vectors; rounds are common table expressions, one after the other."""

from __future__ import annotations

_KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
#: floor(s / n) of integers.
_MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _distance(a: str, b: str) -> str:
    """Squared, exact: all terms are whole numbers below 2^53."""
    return f"CAST(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) - 2 * list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) + list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) AS BIGINT)"


def sort_means(k: int = 8, dims: int = 64, rounds: int = 10, seed: int = 3) -> str:
    ctes = [f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS x FROM embeddings WHERE {_KEPT} AND len(embedding) = {dims})",
            f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"]
    for t in range(rounds + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT r, any_value(v.x) AS x, min(struct_pack(d := {_distance('v.x', 'c.x')}, c := c.c)) AS m FROM v, c{t} c GROUP BY r)")
        if t < rounds:
            ctes.append(f"e{t} AS (SELECT m.c AS c, unnest(x) AS x, unnest(range({dims})) AS i FROM a{t})")
            ctes.append(f"n{t} AS (SELECT c, list(x ORDER BY i) AS x FROM (SELECT c, i, {_MEAN} AS x FROM e{t} GROUP BY c, i) GROUP BY c)")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{t} o LEFT JOIN n{t} n USING (c))")
    return f"""WITH {", ".join(ctes)}
        SELECT v.vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m.c"""


def annular_codes(parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64) -> str:
    width = dims // parts
    ctes = [f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_WHOLE} AS x FROM embeddings WHERE {_KEPT})",
            f"f AS MATERIALIZED (SELECT r, p, x[p * {width} + 1 : p * {width} + {width}] AS x FROM v, range({parts}) t(p) WHERE len(x) = {dims})",
            f"o AS (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v WHERE vec_id IS NOT NULL AND len(x) = {dims} QUALIFY e < {entries})",
            "c0 AS MATERIALIZED (SELECT p, e, x FROM f JOIN o USING (r))"]
    for t in range(rounds + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT r, p, any_value(f.x) AS x, min(struct_pack(d := {_distance('f.x', 'c.x')}, e := c.e)) AS m FROM f JOIN c{t} c USING (p) GROUP BY r, p)")
        if t < rounds:
            ctes.append(f"s{t} AS (SELECT p, m.e AS e, unnest(x) AS x, unnest(range({width})) AS i FROM a{t})")
            ctes.append(f"n{t} AS (SELECT p, e, list(x ORDER BY i) AS x FROM (SELECT p, e, i, {_MEAN} AS x FROM s{t} GROUP BY ALL) GROUP BY p, e)")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.x, o.x) AS x FROM c{t} o LEFT JOIN n{t} n USING (p, e))")
    return f"""WITH {", ".join(ctes)},
        k AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
        h AS (SELECT sha256(coalesce(string_agg(array_to_string(x, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v LEFT JOIN k USING (r), h"""
