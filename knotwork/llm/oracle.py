"""SQL twins of this package's queries, where SQL can express them on whole tables."""

from __future__ import annotations

P5_FOUND = """
SELECT result_id, CAST(pos - 1 AS INTEGER) AS passage_pos
FROM (SELECT result_id, unnest(context) AS passage, unnest(range(1, len(context) + 1)) AS pos FROM results_step)
WHERE length(passage) > 1600
"""

P4_FOUND = r"""
WITH p AS (SELECT result_id, unnest(context) AS passage FROM results_step),
 w AS (SELECT result_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM p WHERE passage IS NOT NULL),
 g AS (SELECT DISTINCT result_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
 n AS (SELECT result_id, count(*) AS n FROM g GROUP BY 1),
 s AS (SELECT a.result_id AS result_id_a, b.result_id AS result_id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.result_id < b.result_id GROUP BY 1, 2)
SELECT result_id_a, result_id_b FROM s JOIN n x ON x.result_id = result_id_a JOIN n y ON y.result_id = result_id_b WHERE c >= 0.7 * (x.n + y.n - c)
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p5_found": P5_FOUND}
