"""DuckDB SQL of the queries that SQL can express over whole tables; the others are held against brute force in tests."""

from __future__ import annotations


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Product-quantisation codes: one pair of steps (assign, average) a round, then a last assignment."""
    size = f"(len(v) // {parts})"
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * {size} + 1 : (p + 1) * {size}] AS x FROM kept, range({parts}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, p, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT * {entries} + e) AS best
  FROM part JOIN book{k} USING (p) GROUP BY vec_id, p
)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, e, list((((s - ((s % n) + n) % n) // n)::DOUBLE) ORDER BY j) AS mean FROM (
      SELECT p, best % {entries} AS e, j, sum(x[j])::BIGINT AS s, count(*) AS n
      FROM near{k} JOIN part USING (vec_id, p), range(1, 100000) u(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY p, e) USING (p, e)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
JOIN kept USING (vec_id), (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda v: v::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
"""


FILL_MIDDLE = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM base
), cut AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, pos, line, keeper IS NOT NULL AND keeper != k.doc_id AS gone FROM keyed k LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL: dict[str, str] = {"op11_pivot_codes": _codes(), "op12_fill_middle": FILL_MIDDLE, "op13_line_dedup": LINE_DEDUP}
