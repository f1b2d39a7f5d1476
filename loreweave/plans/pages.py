"""Page rewriting, summaries, expansion and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import pages as fn
from loreweave.functions.search import query_tokens, tokens_contained
from loreweave.functions.text import ref_key, source_identity
from loreweave.operators import graph as op
from loreweave.plans import graph, text
from loreweave.storage import materialize, table


def entity_summaries(spark, sf_dir) -> DataFrame:
    slug = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    made = table(spark, sf_dir, "documents").select("doc_id", fn.entity_summary("text", slug).alias("s")).where("s is not null")
    return made.select("doc_id", "s.slug", "s.type", "s.title", F.coalesce("s.description", F.lit("")).alias("description"), F.array_join("s.tags", "|").alias("tags"))


def slug_hashes(spark, sf_dir) -> DataFrame:
    sources = table(spark, sf_dir, "retrieval_nodes").select(F.explode("sources").alias("raw")).where("raw is not null").distinct()
    return sources.select(source_identity("raw", keep_unmatched=True).alias("identity")).distinct().select("identity", fn.stable_hash("identity").alias("hash"))


def stamped_pages(spark, sf_dir) -> DataFrame:
    """Documents with their field ``updated`` set to one date."""
    rows = table(spark, sf_dir, "documents").where("text like '---%'")
    return rows.select("doc_id", F.md5(fn.set_scalar("text", "type", F.lit("checked")).cast("binary")).alias("hash"))


def source_pages(spark, sf_dir) -> DataFrame:
    """Pages per source identity, letter case ignored."""
    named = graph.nodes(spark, sf_dir).select("id", F.explode("sources").alias("raw")).where("raw is not null")
    keyed = named.select("id", F.lower(source_identity("raw", keep_unmatched=True)).alias("identity")).distinct()
    return keyed.groupBy("identity").agg(F.count("*").alias("pages"), F.min("id").alias("first_page"))


def log_operations(spark, sf_dir) -> DataFrame:
    lines = F.regexp_extract_all("text", F.lit(r"(?md)^## (\[[0-9-]{10}\] [a-z]+ \|)"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select(F.explode(lines).alias("x"))
    return rows.select(F.substring("x", 2, 7).alias("month"), F.regexp_extract("x", r"\] ([a-z]+) ", 1).alias("operation")).groupBy("month", "operation").agg(F.count("*").alias("n"))


def import_skips(spark, sf_dir) -> DataFrame:
    files = table(spark, sf_dir, "file_snapshots").select("project_id", "path", "size").distinct()
    return files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(fn.import_skipped("path", "size").cast("int")).alias("skipped"))


_QUERY = "findings and sources of the index"
_TOKENS = query_tokens(_QUERY)


def graph_expansion(spark, sf_dir) -> DataFrame:
    """Pages related to the search hits: three per hit with a relevance of 2 or more, no hit itself, the best relevance."""
    n, edges, pairs = graph._graph(spark, sf_dir)
    hits = n.where(tokens_contained(F.lower(F.concat_ws(" ", "title", "id")), _TOKENS) > 0).select("id")
    near = op.related(op.relevance(pairs, n, edges), 3).where(F.round("relevance", 6) >= 2)
    found = near.join(hits, "id", "left_semi").join(hits.select(F.col("id").alias("other")), "other", "left_anti")
    return found.groupBy(F.col("other").alias("id")).agg(F.round(F.max("relevance"), 6).alias("relevance"), F.count("*").alias("hits"))


def graph_expansion_all(spark, sf_dir) -> DataFrame:
    """As ``graph_expansion``, with the three per hit chosen among all nodes, linked or not."""
    n, edges, _ = graph._graph(spark, sf_dir)
    hits = materialize(n.where(tokens_contained(F.lower(F.concat_ws(" ", "title", "id")), _TOKENS) > 0).select("id"), "hits")
    near = op.related_nodes(hits, n, edges, 3).where(F.round("relevance", 6) >= 2)
    found = near.join(hits.select(F.col("id").alias("other")), "other", "left_anti")
    return found.groupBy(F.col("other").alias("id")).agg(F.round(F.max("relevance"), 6).alias("relevance"), F.count("*").alias("hits"))


def knowledge_gaps(spark, sf_dir) -> DataFrame:
    """Isolated pages, sparse communities (by page type) and bridges."""
    n, _, pairs = graph._graph(spark, sf_dir)
    return _gaps(n, op.link_counts(n, graph.links(spark, sf_dir)), pairs, materialize(graph._labels(n), "labels"))


def knowledge_gaps_detected(spark, sf_dir) -> DataFrame:
    """As ``knowledge_gaps``, with the detected communities."""
    n, found, edges, pairs = graph._written(spark, sf_dir)
    counts = materialize(op.link_counts(n, found), "counts")
    return _gaps(n, counts, pairs, graph._detected(n, edges)[0])


def _gaps(n: DataFrame, counts: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    few = counts.where("links <= 1").join(n.select("id", "type"), "id").where("coalesce(type, '') <> 'overview' and id not in ('index', 'log')")
    sparse = op.community_stats(labels, pairs, counts).where("cohesion < 0.15 and nodes >= 3")
    parts = [
        few.select(F.lit("isolated-node").alias("gap"), F.col("id").alias("subject"), F.col("links").alias("n")),
        sparse.select(F.lit("sparse-community"), "community", "nodes"),
        op.bridges(pairs, labels, 3).select(F.lit("bridge-node"), "id", "communities"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def title_terms(spark, sf_dir) -> DataFrame:
    """Pages by how many of the query's tokens occur how often in their title: the dialect that counts occurrences."""
    lower = F.lower(F.coalesce("title", F.lit("")))
    hits = sum((((F.length(lower) - F.length(F.replace(lower, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in _TOKENS), F.lit(0))
    stem = (ref_key("page_id") == ref_key(F.lit(_QUERY))).cast("int")
    return table(spark, sf_dir, "wiki_pages").select("page_id", "title").distinct().select("page_id", (hits * 5 + stem * 200).alias("score")).where("score > 0")


def newest_pages(spark, sf_dir) -> DataFrame:
    """The latest delivered row of each page, ties by the row's values, and how late it came."""
    rows = table(spark, sf_dir, "wiki_pages").select("page_id", "title", "updated_at", "ingested_at").distinct()
    order = Window.partitionBy("page_id").orderBy(F.desc("ingested_at"), F.desc("updated_at"), F.desc_nulls_last("title"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


QUERIES = {f.__name__: f for f in (entity_summaries, slug_hashes, stamped_pages, source_pages, log_operations, import_skips, graph_expansion, graph_expansion_all, knowledge_gaps, knowledge_gaps_detected, title_terms, newest_pages)}

_F = text._front_sql("text")
_BODY = f"regexp_replace(text, '{text._FRONT}', '')"
_IDENTITY = text._IDENTITY.format(text._SLASHED)
_HITS = " + ".join(f"contains(lower(concat_ws(' ', title, id)), '{t}')::INT" for t in _TOKENS)
SQL = {
    "entity_summaries": f"""WITH a AS (SELECT doc_id, text, {_F} AS f, {_BODY} AS body FROM documents)
SELECT doc_id, 'doc-' || doc_id AS slug, coalesce({text._scalar_sql('type')}, 'unknown') AS type, coalesce({text._scalar_sql('title')}, 'doc-' || doc_id) AS title,
  coalesce(substr(coalesce({text._scalar_sql('description')}, nullif(trim(regexp_extract(body, '(?m)^([^#\\s][^\\r\\n]*)', 1), ' '), '')), 1, 200), '') AS description, {text._list_sql('tags')} AS tags FROM a WHERE f <> ''""",
    "slug_hashes": f"""WITH a AS (SELECT DISTINCT {_IDENTITY} AS identity FROM (SELECT unnest(sources) AS raw FROM retrieval_nodes) WHERE raw IS NOT NULL)
SELECT identity, CASE WHEN identity = '' THEN {fn.FNV_START} ELSE list_reduce(list_prepend({fn.FNV_START}::BIGINT, list_transform(string_split(identity, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * {fn.FNV_FACTOR}) & 4294967295) END AS hash FROM a""",
    "stamped_pages": f"""WITH a AS (SELECT doc_id, text, {_F} AS f, {_BODY} AS body FROM documents WHERE text LIKE '---%')
SELECT doc_id, md5(CASE WHEN f = '' THEN text ELSE '---' || chr(10) || CASE WHEN regexp_matches(f, '(?m)^type:') THEN regexp_replace(f, '(?m)^type:[ \\t]*[^\\r\\n]*', 'type: checked', 'g') ELSE f || 'type: checked' || chr(10) END || '---' || chr(10) || body END) AS hash FROM a""",
    "source_pages": graph._BASE + f"""SELECT identity, count(DISTINCT id) AS pages, min(id) AS first_page FROM (SELECT id, lower({_IDENTITY}) AS identity FROM (SELECT id, unnest(sources) AS raw FROM n) WHERE raw IS NOT NULL) GROUP BY identity""",
    "log_operations": r"WITH a AS (SELECT unnest(regexp_extract_all(text, '(?m)^## (\[[0-9-]{10}\] [a-z]+ \|)', 1)) AS x FROM documents) SELECT substr(x, 2, 7) AS month, regexp_extract(x, '\] ([a-z]+) ', 1) AS operation, count(*) AS n FROM a GROUP BY ALL",
    "import_skips": r"""WITH a AS (SELECT DISTINCT project_id, lower(replace(path, '\', '/')) AS p, replace(path, '\', '/') AS q, path, size FROM file_snapshots)
SELECT project_id, count(*) AS files, sum((regexp_matches(q, '(^|/)\.store(-imported)?(/|$)') OR q = 'wiki' OR starts_with(q, 'wiki/') OR starts_with(q, 'raw/sources/.cache/') OR regexp_matches(q, '(^|/)\.[^/]*$') OR regexp_extract(p, '\.([^./]*)$', 1) IN ('json', 'yaml', 'yml', 'xml') OR size > 104857600)::INT)::BIGINT AS skipped FROM a GROUP BY project_id""",
    "graph_expansion": graph._REL + f""", h AS (SELECT id FROM n WHERE {_HITS} > 0), w AS (SELECT a AS id, b AS other, relevance FROM rr UNION ALL SELECT b, a, relevance FROM rr),
k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(relevance, 6) DESC, other) <= 3)
SELECT other AS id, round(max(relevance), 6) AS relevance, count(*) AS hits FROM k WHERE round(relevance, 6) >= 2 AND id IN (SELECT id FROM h) AND other NOT IN (SELECT id FROM h) GROUP BY other""",
    "graph_expansion_all": graph._ALL + f""", h AS (SELECT id FROM n WHERE {_HITS} > 0),
k AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(relevance, 6) DESC, other) <= 3)
SELECT other AS id, round(max(relevance), 6) AS relevance, count(*) AS hits FROM k WHERE round(relevance, 6) >= 2 AND id IN (SELECT id FROM h) AND other NOT IN (SELECT id FROM h) GROUP BY other""",
    "knowledge_gaps": graph._BASE + graph._DESCRIBED + """, c AS (SELECT community, count(*) AS nodes FROM t GROUP BY 1),
i AS (SELECT x.community, count(*) AS k FROM u JOIN t x ON x.id = u.a JOIN t y ON y.id = u.b WHERE x.community = y.community GROUP BY 1)
SELECT 'isolated-node' AS gap, id AS subject, links AS n FROM t WHERE links <= 1 AND coalesce(type, '') <> 'overview' AND id NOT IN ('index', 'log')
UNION ALL SELECT 'sparse-community', community, nodes FROM c LEFT JOIN i USING (community) WHERE nodes >= 3 AND coalesce(k, 0) / (nodes * (nodes - 1) / 2) < 0.15
UNION ALL SELECT * FROM (SELECT 'bridge-node', nb.id, count(DISTINCT t.community) AS m FROM nb JOIN t ON t.id = nb.n WHERE lower(nb.id) NOT IN ('index', 'log', 'overview') GROUP BY nb.id HAVING m >= 3 ORDER BY m DESC, nb.id LIMIT 3)""",
    "title_terms": "WITH a AS (SELECT DISTINCT page_id, title, lower(coalesce(title, '')) AS l FROM wiki_pages), b AS (SELECT page_id, (" + " + ".join(f"(length(l) - length(replace(l, '{t}', ''))) // {len(t)}" for t in _TOKENS) + f") * 5 + 200 * ({text._KEY.format('page_id')} = '{_QUERY.replace(' ', '')}')::INT AS score FROM a) SELECT page_id, score::INT AS score FROM b WHERE score > 0",
    "newest_pages": "SELECT page_id, title, updated_at, ingested_at FROM (SELECT DISTINCT page_id, title, updated_at, ingested_at FROM wiki_pages) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC, updated_at DESC, title DESC NULLS LAST) = 1",
}
