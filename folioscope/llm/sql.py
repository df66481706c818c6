"""SQL for DuckDB that gives the same rows as the queries, where SQL can say it."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower(text), '[一-鿿]|[^ \\t\\r\\n一-鿿]+')"

P2 = """
WITH t AS (SELECT DISTINCT rowid, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM (SELECT "rowid", text FROM chunks) WHERE text IS NOT NULL),
s AS (SELECT DISTINCT rowid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 20),
n AS (SELECT rowid, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rowid AS rowid_a, b.rowid AS rowid_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rowid < b.rowid GROUP BY 1, 2)
SELECT rowid_a, rowid_b FROM c JOIN n a ON a.rowid = rowid_a JOIN n b ON b.rowid = rowid_b WHERE c >= 0.6 * (a.n + b.n - c) - 1e-9
"""

P2_GROUPS = """
WITH RECURSIVE t AS (SELECT DISTINCT rowid, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM (SELECT "rowid", text FROM chunks) WHERE text IS NOT NULL),
c AS (SELECT rowid, w, min(rowid) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS copies FROM t WHERE len(w) >= 5),
s AS (SELECT DISTINCT rowid AS k, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4])) AS g FROM c WHERE rowid = class_id),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS root, a AS k FROM e UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.k),
g AS (SELECT k, min(root) AS group_id FROM r GROUP BY 1), d AS (SELECT a AS k, count(*) AS links FROM e GROUP BY 1)
SELECT c.rowid, class_id, coalesce(group_id, class_id) AS group_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN g ON g.k = class_id LEFT JOIN d ON d.k = class_id
"""

P4 = "SELECT DISTINCT \"rowid\" FROM chunks WHERE len(regexp_extract_all(text, '[一-鿿]|[^ \\t\\r\\n一-鿿]+')) > 450"

P6 = """
WITH RECURSIVE ties AS (
  SELECT DISTINCT id, 'g:' || lower(trim("group")) AS tie FROM gold WHERE trim("group") <> ''
  UNION SELECT DISTINCT id, 'c:' || lower(regexp_replace(e.neutral_citation, '\\s+', '', 'g')) FROM (SELECT id, unnest(expected_sources) AS e FROM gold) WHERE regexp_replace(e.neutral_citation, '\\s+', '', 'g') <> ''),
reach AS (
  SELECT DISTINCT id AS root, id FROM gold
  UNION SELECT r.root, b.id FROM reach r JOIN ties a ON a.id = r.id JOIN ties b ON b.tie = a.tie),
unit AS (SELECT id, min(root) AS unit FROM reach GROUP BY 1),
bad AS (SELECT unit FROM unit JOIN gold USING (id) GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1)
SELECT DISTINCT id FROM unit WHERE unit IN (SELECT unit FROM bad)
"""

P8_ROUNDTRIP = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

_REPEATED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4])) AS g FROM d WHERE len(w) >= 5),
f AS (SELECT r, i, min(i) OVER (PARTITION BY r, g) < i AS again FROM p),
c AS (SELECT DISTINCT r, i + k AS i FROM f, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE again),
n AS (SELECT r, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_repeated, CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(n, 0) / len(w) END AS share FROM d LEFT JOIN n USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2,
        "p2_groups": P2_GROUPS,
        "p4_found": P4,
        "p6_found": P6,
        "p8_roundtrip": P8_ROUNDTRIP,
        "p10_found": f"SELECT doc_id FROM ({_REPEATED}) WHERE n_words >= 20 AND n_repeated >= 0.3 * n_words - 1e-9",
        "p10_repetition": _REPEATED,
    }
