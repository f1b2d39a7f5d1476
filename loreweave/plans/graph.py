"""Graph queries over retrieval_nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import graph as op
from loreweave.storage import materialize, table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node; of rows that differ the greatest holds."""
    rows = table(spark, sf_dir, "retrieval_nodes").select(F.col("page_id").alias("id"), "title", F.lower(F.trim("page_type")).alias("type"), "sources", "out_links").distinct()
    return rows.groupBy("id").agg(F.max(F.struct("title", "type", "sources", "out_links")).alias("m")).select("id", "m.*")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(nodes(spark, sf_dir))


def _resolved(n: DataFrame) -> DataFrame:
    raw = n.select(F.col("id").alias("src"), F.explode("out_links").alias("raw")).where("raw is not null")
    return op.resolve_links(n, raw)


_KEY = r"regexp_replace(regexp_replace(lower(regexp_replace(replace(trim({}, ' '), '\', '/'), '^.*/', '')), '\.md$', ''), '[\s_-]+', '', 'g')"
_BASE = f"""
WITH n AS (
  SELECT page_id AS id, m.title AS title, m.type AS type, m.sources AS sources, m.out_links AS out_links FROM (
    SELECT page_id, max(struct_pack(title, type := lower(trim(page_type, ' ')), sources, out_links)) AS m FROM retrieval_nodes GROUP BY page_id)),
r AS (SELECT src, raw FROM (SELECT id AS src, unnest(out_links) AS raw FROM n) WHERE raw IS NOT NULL),
kk AS (SELECT {_KEY.format('id')} AS key, min(id) AS near FROM n GROUP BY 1 HAVING key <> ''),
l AS (SELECT r.src, r.raw, coalesce(n.id, kk.near) AS dst FROM r LEFT JOIN n ON r.raw = n.id LEFT JOIN kk ON kk.key = {_KEY.format('r.raw')}),
e AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND src <> dst),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
dg AS (SELECT n.id, count(x.i) AS degree FROM n LEFT JOIN (SELECT src AS i FROM e UNION ALL SELECT dst FROM e) x ON x.i = n.id GROUP BY n.id),
lc AS (SELECT n.id, count(x.i) AS links FROM n LEFT JOIN (SELECT src AS i FROM l WHERE dst IS NOT NULL AND src <> dst UNION ALL SELECT dst FROM l WHERE dst IS NOT NULL AND src <> dst) x ON x.i = n.id GROUP BY n.id),
nb AS (SELECT src AS id, dst AS n FROM e UNION SELECT dst, src FROM e),
aa AS (
  SELECT u.a, u.b, count(*) AS common, sum(1 / ln(greatest(dg.degree, 2))) AS score
  FROM u JOIN nb x ON x.id = u.a JOIN nb y ON y.id = u.b AND y.n = x.n JOIN dg ON dg.id = x.n GROUP BY u.a, u.b),
sh AS (
  SELECT u.a, u.b, len(list_intersect(coalesce(p.sources, []), coalesce(q.sources, []))) AS shared
  FROM u LEFT JOIN n p ON p.id = u.a LEFT JOIN n q ON q.id = u.b)
"""
_AFFINITY = "CASE " + " ".join(f"WHEN {{x}} = '{a}' AND {{y}} = '{b}' THEN {v}" for a, row in op.AFFINITY.items() for b, v in row.items()) + " ELSE {other} END"
_REL = _BASE + f""", rel AS (
  SELECT u.a, u.b, (SELECT count(*) FROM e WHERE least(src, dst) = u.a AND greatest(src, dst) = u.b) AS direct, sh.shared, coalesce(aa.score, 0.0) AS neighbours,
    ({_AFFINITY.format(x='p.type', y='q.type', other=0.5)})::DOUBLE AS affinity
  FROM u JOIN sh USING (a, b) LEFT JOIN aa USING (a, b) LEFT JOIN n p ON p.id = u.a LEFT JOIN n q ON q.id = u.b),
rr AS (SELECT *, direct * 3.0 + shared * 4.0 + neighbours * 1.5 + affinity AS relevance FROM rel)
"""
_ALL = _BASE + f""", ap AS (SELECT nb.n AS m, nb.id, o.id AS other FROM nb JOIN nb o ON o.n = nb.n AND o.id <> nb.id),
ca AS (SELECT ap.id, ap.other, sum(1 / ln(greatest(dg.degree, 2))) AS score FROM ap JOIN dg ON dg.id = ap.m GROUP BY ALL),
dd AS (SELECT id, other, count(*) AS direct FROM (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e) GROUP BY ALL),
ra AS (
  SELECT p.id, q.id AS other, coalesce(dd.direct, 0) * 3.0 + len(list_intersect(coalesce(p.sources, []), coalesce(q.sources, []))) * 4.0 + coalesce(ca.score, 0.0) * 1.5
    + ({_AFFINITY.format(x='p.type', y='q.type', other=0.5)})::DOUBLE AS relevance
  FROM n p JOIN n q ON p.id <> q.id LEFT JOIN dd ON dd.id = p.id AND dd.other = q.id LEFT JOIN ca ON ca.id = p.id AND ca.other = q.id)
"""
_HASH = "pmod(cast(conv(substring(md5(id), 1, 6), 16, 10) as bigint), 50) = 0"
_HASH_SQL = "('0x' || substr(md5(id), 1, 6))::BIGINT % 50 = 0"


def resolve_links(spark, sf_dir):
    return links(spark, sf_dir).distinct()


def link_dedupe(spark, sf_dir):
    return op.undirected(links(spark, sf_dir))


def link_counts(spark, sf_dir):
    return op.link_counts(nodes(spark, sf_dir), links(spark, sf_dir))


def link_counts_pairs(spark, sf_dir):
    return op.link_counts(nodes(spark, sf_dir), links(spark, sf_dir), once_per_pair=True)


def degree(spark, sf_dir):
    return op.degrees(nodes(spark, sf_dir), op.directed(links(spark, sf_dir)))


def _graph(spark, sf_dir):
    """Nodes, directed and undirected edges; the edges are used several times and written once."""
    edges = materialize(op.directed(links(spark, sf_dir)), "edges")
    return nodes(spark, sf_dir), edges, edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _written(spark, sf_dir):
    """Nodes and resolved links, for queries that read them several times; and the edges as in ``_graph``. All are written once."""
    n = materialize(nodes(spark, sf_dir), "nodes")
    found = materialize(_resolved(n), "links")
    edges = materialize(op.directed(found), "edges")
    return n, found, edges, edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def shared_sources(spark, sf_dir):
    n, _, pairs = _graph(spark, sf_dir)
    return op.shared_sources(pairs, n).where("shared > 0").select("a", "b", F.col("shared").cast("bigint"))


def adamic_adar(spark, sf_dir):
    n, edges, pairs = _graph(spark, sf_dir)
    return op.adamic_adar(pairs, edges, op.degrees(n, edges)).select("a", "b", "common", F.round("score", 6).alias("score"))


def relevance_edges(spark, sf_dir):
    n, edges, pairs = _graph(spark, sf_dir)
    found = op.relevance(pairs, n, edges)
    return found.select("a", "b", "direct", F.col("shared").cast("bigint").alias("shared"), F.round("neighbours", 6).alias("neighbours"), "affinity", F.round("relevance", 6).alias("relevance"))


def related_topk(spark, sf_dir):
    n, edges, pairs = _graph(spark, sf_dir)
    return op.related(op.relevance(pairs, n, edges)).select("id", "other", F.round("relevance", 6).alias("relevance"), "rank")


def related_all(spark, sf_dir):
    """The five most related of all other nodes for every node; ``related_topk`` ranks linked pairs only, as its SQL does."""
    n, edges, _ = _graph(spark, sf_dir)
    return op.related_nodes(n, n, edges).select("id", "other", F.round("relevance", 6).alias("relevance"), "rank")


def two_hop_related(spark, sf_dir):
    n, edges, _ = _graph(spark, sf_dir)
    return op.two_hop_related(n.where(_HASH), n, edges).select("id", "other", F.round("score", 6).alias("score"), "rank")


def orphans(spark, sf_dir):
    n = nodes(spark, sf_dir)
    reached = links(spark, sf_dir).where("dst is not null").select(F.col("dst").alias("id"))
    return n.where(~op.structural(F.col("id"))).select("id").join(reached, "id", "left_anti")


def no_outlinks(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return n.where(~op.structural(F.col("id"))).select("id").join(links(spark, sf_dir).select(F.col("src").alias("id")), "id", "left_anti")


def broken_links(spark, sf_dir):
    return links(spark, sf_dir).where("dst is null").select("src", "raw").distinct()


def _labels(n: DataFrame) -> DataFrame:
    """Communities by page type, which SQL can follow; null types are one."""
    return n.select("id", F.coalesce("type", F.lit("other")).alias("community"))


def _weighted(n: DataFrame, edges: DataFrame) -> DataFrame:
    """Relevance of each linked pair: a, b, weight; written. Numbers stand for ids and sources, since the rows of common neighbours are many."""
    # A node's number ascends with its id, so that pairs keep their order.
    no = materialize(n.select("id").orderBy("id").select("id", F.monotonically_increasing_id().alias("no")), "numbered")
    named = n.select("id", F.explode("sources").alias("source")).where("source is not null").distinct()
    source = materialize(named.select("source").distinct().select("source", F.monotonically_increasing_id().alias("s")), "sources")
    sources = named.join(source, "source").groupBy("id").agg(F.collect_list("s").alias("sources"))
    small = materialize(no.join(n.select("id", "type"), "id").join(sources, "id", "left").select(F.col("no").alias("id"), "type", "sources"), "small")
    ends = edges.join(no.select(F.col("id").alias("src"), F.col("no").alias("x")), "src").join(no.select(F.col("id").alias("dst"), F.col("no").alias("y")), "dst")
    steps = materialize(ends.select(F.col("x").alias("src"), F.col("y").alias("dst")), "steps")
    pairs = materialize(steps.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "pairs")
    found = op.relevance(pairs, small, steps).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("relevance").alias("weight"))
    found = found.join(no.select(F.col("id").alias("a"), F.col("no").alias("x")), "x").join(no.select(F.col("id").alias("b"), F.col("no").alias("y")), "y")
    return materialize(found.select("a", "b", "weight"), "weighted")


def _detected(n: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities by modularity, and the weights they come from; both written."""
    weighted = _weighted(n, edges)
    return materialize(op.communities(n, weighted), "communities"), weighted


def _stats(n, found, labels, pairs):
    counts = op.link_counts(n, found)
    stats = op.community_stats(labels, pairs, counts)
    return stats.select("community", "nodes", "inner_edges", F.round("cohesion", 6).alias("cohesion"), "top_nodes")


def community_stats(spark, sf_dir):
    n, _, pairs = _graph(spark, sf_dir)
    return _stats(n, links(spark, sf_dir), _labels(n), pairs)


def community_stats_detected(spark, sf_dir):
    n, found, edges, pairs = _written(spark, sf_dir)
    return _stats(n, found, _detected(n, edges)[0], pairs)


def _described(n, found, labels):
    return n.select("id", "type").join(labels, "id").join(op.link_counts(n, found), "id")


def surprising(spark, sf_dir):
    n, edges, pairs = _graph(spark, sf_dir)
    weighted = op.relevance(pairs, n, edges).select("a", "b", F.round("relevance", 6).alias("weight"))
    return op.surprising_edges(weighted, _described(n, links(spark, sf_dir), _labels(n)), 50)


def surprising_detected(spark, sf_dir):
    n, found, edges, _ = _written(spark, sf_dir)
    labels, weighted = _detected(n, edges)
    described = materialize(_described(n, found, labels), "described")
    return op.surprising_edges(weighted.select("a", "b", F.round("weight", 6).alias("weight")), described, 50)


def bridges(spark, sf_dir):
    n, _, pairs = _graph(spark, sf_dir)
    return op.bridges(pairs, _labels(n), 20)


def bridges_detected(spark, sf_dir):
    n, _, edges, pairs = _written(spark, sf_dir)
    return op.bridges(pairs, _detected(n, edges)[0], 20)


def isolated(spark, sf_dir):
    n = nodes(spark, sf_dir)
    few = op.link_counts(n, links(spark, sf_dir)).where("links <= 1").join(n.select("id", "type"), "id")
    return few.where("coalesce(type, '') <> 'overview' and id not in ('index', 'log')").select("id", "links")


def graph_filter(spark, sf_dir):
    n, _, pairs = _graph(spark, sf_dir)
    counts = op.link_counts(n, links(spark, sf_dir))
    kept = n.where("coalesce(type, '') <> 'query'").where(~op.structural(F.col("id"))).join(counts.where("links between 1 and 40"), "id")
    return op.visible_edges(pairs, kept)


def graph_search(spark, sf_dir):
    n, _, pairs = _graph(spark, sf_dir)
    text = F.lower(F.concat_ws(" ", "title", "id", "type"))
    return op.visible_edges(pairs, n.where(F.contains(text, F.lit("source")) & F.contains(text, F.lit("of"))))


def communities(spark, sf_dir):
    n, _, edges, _ = _written(spark, sf_dir)
    return op.communities(n, _weighted(n, edges))


QUERIES = {
    f.__name__: f
    for f in (
        resolve_links, link_dedupe, link_counts, link_counts_pairs, degree, shared_sources, adamic_adar, relevance_edges, related_topk, related_all, two_hop_related,
        orphans, no_outlinks, broken_links, community_stats, community_stats_detected, surprising, surprising_detected, bridges, bridges_detected, isolated, graph_filter, graph_search, communities,
    )
}
_DESCRIBED = ", t AS (SELECT n.id, n.type, coalesce(n.type, 'other') AS community, lc.links FROM n JOIN lc USING (id))"
_DISTANT = " OR ".join(f"(x.type = '{a}' AND y.type = '{b}') OR (x.type = '{b}' AND y.type = '{a}')" for a, b in op.DISTANT_TYPES)
SQL = {
    "resolve_links": _BASE + "SELECT DISTINCT src, raw, dst FROM l",
    "link_dedupe": _BASE + "SELECT a, b FROM u",
    "link_counts": _BASE + "SELECT id, links FROM lc",
    "link_counts_pairs": _BASE + "SELECT n.id, count(x.i) AS links FROM n LEFT JOIN (SELECT a AS i FROM u UNION ALL SELECT b FROM u) x ON x.i = n.id GROUP BY n.id",
    "degree": _BASE + "SELECT id, degree FROM dg",
    "shared_sources": _BASE + "SELECT a, b, shared::BIGINT AS shared FROM sh WHERE shared > 0",
    "adamic_adar": _BASE + "SELECT a, b, common, round(score, 6) AS score FROM aa",
    "relevance_edges": _REL + "SELECT a, b, direct, shared::BIGINT AS shared, round(neighbours, 6) AS neighbours, affinity, round(relevance, 6) AS relevance FROM rr",
    "related_topk": _REL + ", w AS (SELECT a AS id, b AS other, relevance FROM rr UNION ALL SELECT b, a, relevance FROM rr) SELECT id, other, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY id ORDER BY round(relevance, 6) DESC, other)::INT AS rank FROM w QUALIFY rank <= 5",
    "related_all": _ALL + "SELECT id, other, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY id ORDER BY round(relevance, 6) DESC, other)::INT AS rank FROM ra QUALIFY rank <= 5",
    "two_hop_related": _BASE + f""",
q AS (SELECT id FROM n WHERE {_HASH_SQL}), st AS (SELECT src AS id, dst AS n FROM e UNION ALL SELECT dst, src FROM e),
o1 AS (SELECT q.id, st.n FROM q JOIN st USING (id)), ss AS (SELECT DISTINCT id, source FROM (SELECT id, unnest(sources) AS source FROM n) WHERE source IS NOT NULL),
p AS (SELECT id, n AS other, 3.0 AS s FROM o1 UNION ALL SELECT o1.id, st.n, 1.5 FROM o1 JOIN st ON st.id = o1.n WHERE st.n <> o1.id
  UNION ALL SELECT q.id, y.id, 4.0 FROM q JOIN ss x ON x.id = q.id JOIN ss y ON y.source = x.source AND y.id <> q.id),
b AS (SELECT id, other, sum(s) AS base FROM p GROUP BY ALL),
z AS (SELECT b.id, other, (base * ({_AFFINITY.format(x='x.type', y='y.type', other=1.0)}))::DOUBLE AS score FROM b JOIN n x ON x.id = b.id JOIN n y ON y.id = b.other)
SELECT id, other, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, other)::INT AS rank FROM z QUALIFY rank <= 5""",
    "orphans": _BASE + f"SELECT id FROM n WHERE lower(id) NOT IN {op.STRUCTURAL} AND id NOT IN (SELECT dst FROM l WHERE dst IS NOT NULL)",
    "no_outlinks": _BASE + f"SELECT id FROM n WHERE lower(id) NOT IN {op.STRUCTURAL} AND id NOT IN (SELECT src FROM l)",
    "broken_links": _BASE + "SELECT DISTINCT src, raw FROM l WHERE dst IS NULL",
    "community_stats": _BASE + _DESCRIBED + """
SELECT c.community, c.nodes, coalesce(i.k, 0) AS inner_edges, round(CASE WHEN c.nodes > 1 THEN coalesce(i.k, 0) / (c.nodes * (c.nodes - 1) / 2) ELSE 0.0 END, 6)::DOUBLE AS cohesion, top.t AS top_nodes
FROM (SELECT community, count(*) AS nodes FROM t GROUP BY 1) c
LEFT JOIN (SELECT x.community, count(*) AS k FROM u JOIN t x ON x.id = u.a JOIN t y ON y.id = u.b WHERE x.community = y.community GROUP BY 1) i USING (community)
LEFT JOIN (SELECT community, string_agg(id, ',' ORDER BY links DESC, id) AS t FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY community ORDER BY links DESC, id) <= 5) GROUP BY 1) top USING (community)""",
    "surprising": _REL + _DESCRIBED + f""",
s AS (SELECT a, b, (x.community <> y.community)::INT * 3 + CASE WHEN x.type IS NOT DISTINCT FROM y.type THEN 0 WHEN {_DISTANT} THEN 2 ELSE 1 END
  + (least(x.links, y.links) <= 2 AND greatest(x.links, y.links) >= 0.5 * (SELECT greatest(max(links), 1) FROM t))::INT * 2 + (round(relevance, 6) > 0 AND round(relevance, 6) < 2)::INT AS score
  FROM rr JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE lower(a) NOT IN ('index', 'log', 'overview') AND lower(b) NOT IN ('index', 'log', 'overview'))
SELECT a, b, score::INT AS score FROM s WHERE score >= 3 ORDER BY score DESC, a, b LIMIT 50""",
    "bridges": _BASE + _DESCRIBED + "SELECT nb.id, count(DISTINCT t.community) AS communities FROM nb JOIN t ON t.id = nb.n WHERE lower(nb.id) NOT IN ('index', 'log', 'overview') GROUP BY nb.id HAVING communities >= 3 ORDER BY communities DESC, nb.id LIMIT 20",
    "isolated": _BASE + "SELECT id, links FROM lc JOIN n USING (id) WHERE links <= 1 AND coalesce(type, '') <> 'overview' AND id NOT IN ('index', 'log')",
    "graph_filter": _BASE + f", k AS (SELECT id FROM n JOIN lc USING (id) WHERE coalesce(type, '') <> 'query' AND lower(id) NOT IN {op.STRUCTURAL} AND links BETWEEN 1 AND 40) SELECT a, b FROM u WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)",
    "graph_search": _BASE + ", k AS (SELECT id FROM n WHERE contains(lower(concat_ws(' ', title, id, type)), 'source') AND contains(lower(concat_ws(' ', title, id, type)), 'of')) SELECT a, b FROM u WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)",
}
