"""DuckDB SQL that returns the rows of the registered queries, where SQL can express them on whole tables."""

from __future__ import annotations

from sourcelight.llm import op4_mix

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(l) - 1)), lambda i: array_to_string(l[i : i + 2], ' '))) AS g FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT x AS a, y AS b FROM (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL)
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

LEAKS = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark WHERE item_id IS NOT NULL),
iv AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i : i + k - 1], ' '))) AS g FROM (SELECT *, least(10, len(l)) AS k FROM iw WHERE len(l) > 0)),
dv AS (
  SELECT doc_id, k, unnest(range(1, len(l) - k + 2)) AS p, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i : i + k - 1], ' '))) AS g
  FROM dw JOIN (SELECT DISTINCT k FROM iv) ON len(l) >= k
),
h AS (SELECT doc_id, k, p, item_id FROM dv JOIN iv USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, line, p, r.key IS NULL OR r.m = doc_id AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": NEAR,
    "op4_mix_sources": f"WITH RECURSIVE {op4_mix.oracle()}",
    "op5_benchmark_decontamination": LEAKS,
    "op10_line_dedup": LINES,
}

NEGATIVES = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)))),
s AS (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND (a.label <> b.label OR a.id <> b.id)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS goal, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, goal AS positive_score, score AS negative_score FROM n WHERE rank <= 5
"""
ORACLES["op12_hard_negatives"] = NEGATIVES
