"""SQL for the queries of this package that SQL can express."""

P1_FOUND = """
WITH t AS (
  SELECT DISTINCT page_id AS k, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS s FROM wiki_pages WHERE title IS NOT NULL),
tg AS (
  SELECT DISTINCT 'title' AS kind, k, s AS txt, substr(s, i::INT, 3) AS g
  FROM (SELECT k, s, unnest(range(1, length(s) - 1)) AS i FROM t WHERE length(s) >= 3)),
c AS (
  SELECT DISTINCT chunk_id AS k, lower(chunk_text) AS txt, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS w
  FROM wiki_chunks WHERE chunk_text IS NOT NULL),
cg AS (
  SELECT DISTINCT 'chunk' AS kind, k, txt, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT k, txt, w, unnest(range(1, len(w))) AS i FROM c WHERE len(w) >= 2)),
g AS (SELECT * FROM tg UNION ALL SELECT * FROM cg),
n AS (SELECT kind, k, txt, count(*) AS n FROM g GROUP BY ALL),
o AS (
  SELECT a.kind, a.k AS x, b.k AS y, a.txt AS tx, b.txt AS ty, count(*) AS o
  FROM g a JOIN g b ON a.kind = b.kind AND a.g = b.g AND a.k < b.k GROUP BY ALL)
SELECT DISTINCT o.kind, o.x AS key_a, o.y AS key_b
FROM o JOIN n p ON p.kind = o.kind AND p.k = o.x AND p.txt = o.tx JOIN n q ON q.kind = o.kind AND q.k = o.y AND q.txt = o.ty
WHERE o.o >= 0.7 * (p.n + q.n - o.o) - 1e-9
"""


P2_FOUND = """
WITH raw AS (
  SELECT DISTINCT 'tags' AS kind, 0 AS side, page_id AS k, tags AS v FROM wiki_pages
  UNION ALL SELECT DISTINCT 'out_links', 0, page_id, out_links FROM retrieval_nodes
  UNION ALL SELECT DISTINCT 'in_links', 0, page_id, in_links FROM retrieval_nodes
  UNION ALL SELECT DISTINCT 'sources', 0, page_id, sources FROM retrieval_nodes
  UNION ALL SELECT DISTINCT 'profile', 0, page_id, tags FROM wiki_pages
  UNION ALL SELECT DISTINCT 'profile', 1, profile_id, tags FROM tag_profiles),
u AS (SELECT kind, side, k, hash(v) AS h, regexp_replace(lower(unnest(v)), '[\\s\\p{Z}_-]+', '', 'g') AS x FROM raw),
s AS (SELECT DISTINCT kind, side, k, h, x FROM u WHERE x IS NOT NULL AND x <> ''),
n AS (SELECT kind, side, k, h, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 4),
o AS (
  SELECT a.kind, a.side AS sa, b.side AS sb, a.k AS ka, b.k AS kb, a.h AS ha, b.h AS hb, count(*) AS o
  FROM s a JOIN s b ON a.kind = b.kind AND a.x = b.x
    AND ((a.kind = 'profile' AND a.side = 0 AND b.side = 1) OR (a.kind <> 'profile' AND a.k < b.k)) GROUP BY ALL)
SELECT DISTINCT o.kind, least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM o
JOIN n p ON p.kind = o.kind AND p.side = sa AND p.k = ka AND p.h = ha
JOIN n q ON q.kind = o.kind AND q.side = sb AND q.k = kb AND q.h = hb
WHERE ka <> kb AND o >= 0.7 * (p.n + q.n - o) - 1e-9
"""

P3_FOUND = """
WITH v AS (
  SELECT DISTINCT chunk_id AS k, CAST(embedding AS DOUBLE[64]) AS e FROM wiki_chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.k AS q, b.k AS n, array_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.k <> b.k),
r AS (SELECT q, n, c, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS r FROM s WHERE c >= 0.9)
SELECT DISTINCT least(q, n) AS key_a, greatest(q, n) AS key_b FROM r WHERE r <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND}
