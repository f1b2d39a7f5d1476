"""Search queries over documents, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.search import chunk_snippet, counted_phrase, counted_score, counted_snippet, counted_tokens, query_tokens, snippet
from loreweave.functions.text import strip_frontmatter
from loreweave.operators import search as op
from loreweave.storage import table

QUERY = "Sparse index of the shared heading?"
PHRASE = "shared index"
RARE_QUERY = "kiln sextants"
TOKENS = query_tokens(QUERY)

_TITLE = r"^---\r?\n(?:[^\n]*\n)*?title:[ \t]*\"?([^\"\r\n]*)"
_HEADING = r"(?:^|\n)# ([^\r\n]+)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the title from the frontmatter, else the first heading, else the key."""
    text = F.coalesce("text", F.lit(""))
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in (_TITLE, _HEADING)]
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), stem.alias("stem"), F.coalesce(*found, F.replace(stem, F.lit("-"), F.lit(" "))).alias("title"), F.col("text").alias("content"))


_PAGES_SQL = f"""
p AS (
  SELECT doc_id AS key, 'doc-' || doc_id AS stem, coalesce(text, '') AS content,
    coalesce(nullif(trim(regexp_extract(coalesce(text, ''), '{_TITLE}', 1)), ''), nullif(trim(regexp_extract(coalesce(text, ''), '{_HEADING}', 1)), ''), 'doc ' || doc_id) AS title
  FROM documents)"""


def _contains_sql(column: str, tokens: list[str] = TOKENS) -> str:
    return " + ".join(f"contains({column}, '{t}')::INT" for t in tokens)


_SCORED_SQL = f"""
WITH {_PAGES_SQL},
l AS (SELECT key, title, stem, lower(title) || ' ' || stem AS t, lower(content) AS c FROM p),
s AS (
  SELECT key, title, {_contains_sql('t')} AS title_tokens, {_contains_sql('c')} AS content_tokens,
    least((length(c) - length(replace(c, '{{phrase}}', ''))) // {{width}}, 10) AS phrase_hits,
    contains(t, '{{phrase}}') AS in_title, stem = '{{phrase}}' AS exact FROM l),
r AS (
  SELECT key, title, title_tokens::INT AS title_tokens, content_tokens::INT AS content_tokens, phrase_hits::INT AS phrase_hits,
    (200 * exact::INT + 50 * in_title::INT + 20 * phrase_hits + 5 * title_tokens + content_tokens)::DOUBLE AS score,
    title_tokens > 0 OR in_title AS title_match FROM s)
""".format(phrase="sparse index of the shared heading", width=len("sparse index of the shared heading"))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = op.keyword_hits(pages(spark, sf_dir), QUERY)
    return op.ranked(hits, "score", "key", 20).select("key", "title", "score", "title_match", "rank")


def token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyword_hits(pages(spark, sf_dir), QUERY).select("key", "title_tokens", "content_tokens", "phrase_hits", "score")


def phrase_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyword_hits(pages(spark, sf_dir), PHRASE).where("phrase_hits > 0").select("key", "phrase_hits")


def keyword_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where(F.contains(F.lower("content"), F.lit(PHRASE))).select("key", snippet(F.col("content"), PHRASE).alias("snippet"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the first chunk that has one: one row."""
    chunks = table(spark, sf_dir, "wiki_chunks").where(F.size("embedding") == 64)
    return list(chunks.orderBy("chunk_id").select("embedding").first()[0])


def _near(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return op.nearest_chunks(table(spark, sf_dir, "wiki_chunks"), _query_vector(spark, sf_dir), k)


_NEAR_SQL = """
q AS (SELECT CAST(embedding AS DOUBLE[64]) AS e FROM wiki_chunks WHERE len(embedding) = 64 ORDER BY chunk_id LIMIT 1),
d AS (
  SELECT DISTINCT chunk_id, page_id, chunk_index, chunk_text, heading_path, 1 / (1 + array_distance(CAST(embedding AS DOUBLE[64]), (SELECT e FROM q)) ** 2) AS score
  FROM wiki_chunks WHERE len(embedding) = 64),
n AS (SELECT * FROM d ORDER BY score DESC, chunk_id LIMIT 60)"""
_BLEND_SQL = "b AS (SELECT page_id, max(score) + least(0.3 * (sum(score) - max(score)), greatest(0.0, 1 - max(score))) AS score, count(*) AS chunks FROM n GROUP BY page_id)"


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("chunk_id", "page_id", "chunk_index", F.round("score", 6).alias("score"))


def page_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.blended_pages(_near(spark, sf_dir)).select("page_id", F.round("score", 6).alias("score"), "chunks")


def matched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.best_chunks(_near(spark, sf_dir)).select("page_id", "place", "chunk_id")


def vector_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wiki_chunks").distinct().select("chunk_id", chunk_snippet(F.col("chunk_text"), F.col("heading_path")).alias("snippet"))


def _lists(spark: SparkSession, sf_dir: str, query: str = QUERY) -> tuple[DataFrame, DataFrame]:
    titles = table(spark, sf_dir, "wiki_pages").select("page_id", "title").distinct()
    keyword = op.page_token_hits(titles, table(spark, sf_dir, "wiki_chunks"), query)
    return keyword, op.ranked(op.blended_pages(_near(spark, sf_dir)), "score", "page_id", 20)


def _lists_sql(tokens: list[str] = TOKENS) -> str:
    return f"""
WITH {_NEAR_SQL}, {_BLEND_SQL},
c AS (SELECT page_id, {' + '.join(f"max(contains(lower(chunk_text), '{t}')::INT)" for t in tokens)} AS s FROM wiki_chunks GROUP BY page_id),
t AS (SELECT page_id, max({_contains_sql("lower(coalesce(title, ''))", tokens)}) AS s FROM wiki_pages GROUP BY page_id),
k AS (SELECT page_id, (5 * coalesce(t.s, 0) + coalesce(c.s, 0))::DOUBLE AS score FROM t FULL JOIN c USING (page_id) WHERE 5 * coalesce(t.s, 0) + coalesce(c.s, 0) > 0),
kr AS (SELECT page_id, row_number() OVER (ORDER BY score DESC, page_id) AS r FROM k),
vr AS (SELECT page_id, row_number() OVER (ORDER BY score DESC, page_id) AS r FROM b QUALIFY r <= 20)
"""


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.fused(*_lists(spark, sf_dir), 20)
    return found.select("page_id", F.round("score", 9).alias("score"), "keyword_rank", "vector_rank")


def vector_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword, vector = _lists(spark, sf_dir, RARE_QUERY)
    title = table(spark, sf_dir, "wiki_pages").groupBy("page_id").agg(F.max("title").alias("title"))
    return vector.join(keyword, "page_id", "left_anti").join(title, "page_id", "left").select("page_id", "title", F.col("rank").alias("vector_rank"))


def _counted(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Pages with a score in the dialect that counts occurrences in titles and bodies."""
    rows = pages(spark, sf_dir).select("key", "stem", "title", strip_frontmatter(F.coalesce("content", F.lit(""))).alias("body"))
    score = counted_score(F.lower("stem"), F.lower("title"), F.lower("body"), query)
    return rows.select("key", "stem", "title", "body", *[c.alias(n) for n, c in score.items()]).where("score > 0")


def counted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = op.ranked(_counted(spark, sf_dir, QUERY), "score", "key", 20)
    return best.select("key", "title", "score", "title_match", counted_snippet(F.col("body"), QUERY).alias("snippet"), "rank")


def counted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, PHRASE).select("key", "score", "title_match", counted_snippet(F.col("body"), PHRASE).alias("snippet"))


def hybrid_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the best twenty of either list in three modes: both lists, one without hits in the pages, one without a vector."""
    keyword, vector = _lists(spark, sf_dir)
    ranked = op.ranked(keyword, "score", "page_id", 20)
    none = vector.where("false")
    modes = {"hybrid": (ranked, vector), "vector": (ranked.where("false"), vector), "keyword": (ranked, none)}
    made = []
    for mode, (words, near) in modes.items():
        both = words.select("page_id", F.col("rank").alias("k")).join(near.select("page_id", F.col("rank").alias("v")), "page_id", "full")
        score = F.coalesce(1.0 / (60.0 + F.col("k")), F.lit(0.0)) + F.coalesce(1.0 / (60.0 + F.col("v")), F.lit(0.0))
        made.append(op.ranked(both.withColumn("score", F.round(score * 1000, 6)), "score", "page_id", 20).select(F.lit(mode).alias("mode"), "page_id", "score", "rank"))
    return made[0].unionByName(made[1]).unionByName(made[2])


QUERIES = {f.__name__: f for f in (counted_search, counted_scores, hybrid_modes, keyword_search, token_score, phrase_count, keyword_snippets, vector_topk, page_blend, matched_chunks, vector_snippets, hybrid_rrf, vector_only)}
_BODY = r"regexp_replace(content, '^---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|$)', '')"


def _counted_sql(query: str) -> str:
    tokens, phrase = counted_tokens(query), counted_phrase(query)
    count = lambda c, t: f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}"
    titles, bodies = (" + ".join(count(c, t) for t in tokens) for c in ("lt", "lb"))
    at = f"coalesce({', '.join(f"nullif(strpos(lb, '{a}'), 0)" for a in (phrase, *tokens))})"
    return f"""WITH {_PAGES_SQL}, b AS (SELECT key, stem, title, {_BODY} AS body FROM p), l AS (SELECT *, lower(title) AS lt, lower(body) AS lb, lower(stem) = '{phrase.replace(' ', '-')}' AS exact FROM b),
s AS (SELECT key, title, body, (200 * exact::INT + 5 * ({titles}) + ({bodies}) + 50 * contains(lt, '{phrase}')::INT + 20 * least({count('lb', phrase)}, 10))::DOUBLE AS score, exact OR ({titles}) > 0 OR contains(lt, '{phrase}') AS title_match,
  replace(CASE WHEN {at} IS NULL THEN substr(body, 1, 160) ELSE substr(body, greatest({at} - 60, 1), 200) END, chr(10), ' ') AS snippet FROM l)
"""


SQL = {
    "counted_search": _counted_sql(QUERY) + "SELECT key, title, score, title_match, snippet, row_number() OVER (ORDER BY score DESC, key)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 20",
    "counted_scores": _counted_sql(PHRASE) + "SELECT key, score, title_match, snippet FROM s WHERE score > 0",
    "hybrid_modes": _lists_sql() + """, kk AS (SELECT * FROM kr WHERE r <= 20),
m AS (SELECT 'hybrid' AS mode, page_id, coalesce(1.0 / (60 + kk.r), 0) + coalesce(1.0 / (60 + vr.r), 0) AS score FROM kk FULL JOIN vr USING (page_id)
  UNION ALL SELECT 'vector', page_id, 1.0 / (60 + r) FROM vr UNION ALL SELECT 'keyword', page_id, 1.0 / (60 + r) FROM kk)
SELECT mode, page_id, round(1000 * score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY mode ORDER BY round(1000 * score, 6) DESC, page_id)::INT AS rank FROM m QUALIFY rank <= 20""",
    "keyword_search": _SCORED_SQL + "SELECT key, title, score, title_match, row_number() OVER (ORDER BY score DESC, key)::INT AS rank FROM r WHERE score > 0 QUALIFY rank <= 20",
    "token_score": _SCORED_SQL + "SELECT key, title_tokens, content_tokens, phrase_hits, score FROM r WHERE score > 0",
    "phrase_count": f"SELECT doc_id AS key, least((length(text) - length(replace(lower(text), '{PHRASE}', ''))) // {len(PHRASE)}, 10)::INT AS phrase_hits FROM documents WHERE contains(lower(text), '{PHRASE}')",
    "keyword_snippets": f"""
WITH a AS (SELECT doc_id AS key, text AS t, strpos(lower(text), '{PHRASE}') AS i FROM documents WHERE contains(lower(text), '{PHRASE}')),
b AS (SELECT key, t, greatest(i - 80, 1) AS s, least(i + {len(PHRASE)} + 80, length(t) + 1) AS e FROM a)
SELECT key, CASE WHEN s > 1 THEN '...' ELSE '' END || replace(substr(t, s, e - s), chr(10), ' ') || CASE WHEN e <= length(t) THEN '...' ELSE '' END AS snippet FROM b""",
    "vector_topk": f"WITH {_NEAR_SQL} SELECT chunk_id, page_id, chunk_index, round(score, 6) AS score FROM n",
    "page_blend": f"WITH {_NEAR_SQL}, {_BLEND_SQL} SELECT page_id, round(score, 6) AS score, chunks FROM b",
    "matched_chunks": f"WITH {_NEAR_SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, chunk_id)::INT AS place, chunk_id FROM n QUALIFY place <= 3",
    "vector_snippets": """
WITH a AS (SELECT DISTINCT * FROM wiki_chunks), b AS (
  SELECT chunk_id, replace(trim(chunk_text, ' '), chr(10), ' ') AS t, trim(coalesce(heading_path, ''), ' ') AS h FROM a)
SELECT chunk_id, CASE WHEN coalesce(t, '') = '' THEN '' ELSE CASE WHEN h = '' THEN '' ELSE h || ': ' END || CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '...' ELSE t END END AS snippet FROM b""",
    "hybrid_rrf": _lists_sql() + """
SELECT page_id, round(coalesce(1.0 / (60 + kr.r), 0) + coalesce(1.0 / (60 + vr.r), 0), 9)::DOUBLE AS score, coalesce(kr.r, 0)::INT AS keyword_rank, coalesce(vr.r, 0)::INT AS vector_rank
FROM kr FULL JOIN vr USING (page_id) ORDER BY coalesce(1.0 / (60 + kr.r), 0) + coalesce(1.0 / (60 + vr.r), 0) DESC, page_id LIMIT 20""",
    "vector_only": _lists_sql(query_tokens(RARE_QUERY)) + "SELECT page_id, (SELECT max(title) FROM wiki_pages w WHERE w.page_id = vr.page_id) AS title, r::INT AS vector_rank FROM vr WHERE page_id NOT IN (SELECT page_id FROM kr)",
}
