"""Keyword, vector and hybrid search over page and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.search import page_score, query_tokens, reciprocal_rank, tokens_contained

#: The greatest part that other chunks add to a page's best, and the least chunks fetched.
OTHERS_SHARE, MIN_FETCH = 0.3, 30


def keyword_hits(pages: DataFrame, query: str) -> DataFrame:
    """Pages with a score above 0: key, title, phrase_hits, title_tokens, content_tokens, score, title_match.

    ``pages`` has key, stem, title and content; nulls count as empty texts. A
    query without tokens and phrase finds nothing.
    """
    lower = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("stem", "title", "content")]
    scored = pages.select("key", "title", *[c.alias(n) for n, c in page_score(lower[0], F.concat_ws(" ", lower[1], lower[0]), lower[2], query).items()])
    return scored.where("score > 0")


def ranked(hits: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    """The ``limit`` best with their rank from 1; ties in ascending order of ``tie``."""
    best = hits.orderBy(F.desc(score), tie).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance to a literal vector, in double precision."""
    other = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, other, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def nearest_chunks(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """The max(3k, 30) chunks nearest to a vector, score = 1 / (1 + squared distance).

    Chunks without a vector of the query's length take no part; equal rows count
    once; ties go to the smaller chunk_id.
    """
    sound = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    scored = sound.select("chunk_id", "page_id", "chunk_index", "chunk_text", "heading_path", (1 / (1 + squared_distance(F.col("embedding"), query))).alias("score"))
    # Equal rows lie beside one another in the order, so the best of the keys bound what is fetched, and only those rows lose their repeats.
    most = max(3 * k, MIN_FETCH)
    keys = scored.groupBy("chunk_id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "chunk_id").limit(most).select("chunk_id")
    return scored.join(F.broadcast(keys), "chunk_id", "left_semi").distinct().orderBy(F.desc("score"), "chunk_id").limit(most).select(scored.columns)


def blended_pages(hits: DataFrame) -> DataFrame:
    """Page score of its chunks: the best, and 0.3 of the others' sum as far as it stays under 1."""
    best = hits.groupBy("page_id").agg(F.max("score").alias("best"), F.sum("score").alias("total"), F.count("*").alias("chunks"))
    rest = F.least(F.lit(OTHERS_SHARE) * (F.col("total") - F.col("best")), F.greatest(F.lit(0.0), 1 - F.col("best")))
    return best.select("page_id", (F.col("best") + rest).alias("score"), "chunks")


def best_chunks(hits: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best chunks of each page with their place."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("page_id", "place", "chunk_id", "score")


def page_token_hits(pages: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Keyword score of chunked pages: 5 per token of the title, 1 per token in any chunk."""
    tokens = query_tokens(query)
    found = [F.max(F.contains(F.lower("chunk_text"), F.lit(t)).cast("int")).alias(f"t{i}") for i, t in enumerate(tokens)]
    in_chunks = chunks.groupBy("page_id").agg(*found)
    content = sum((F.coalesce(F.col(f"t{i}"), F.lit(0)) for i in range(len(tokens))), F.lit(0))
    titled = pages.select("page_id", tokens_contained(F.lower(F.coalesce("title", F.lit(""))), tokens).alias("in_title"))
    scored = titled.join(in_chunks, "page_id", "full_outer").select("page_id", (F.coalesce("in_title", F.lit(0)) * 5 + content).cast("double").alias("score"))
    return scored.groupBy("page_id").agg(F.max("score").alias("score")).where("score > 0")


def fused(keyword: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion: page_id, score, keyword_rank, vector_rank; rank 0 means not in that list.

    ``keyword`` holds all hits (page_id, score), ``vector`` a ranked list of at
    most a few hundred pages. Ranks among all keyword hits are needed only for the
    pages of either list's head, so no window over all hits is built: the ranks of
    the vector list's pages are counted against all hits.
    """
    head = ranked(keyword, "score", "page_id", limit + 1).select("page_id", F.col("rank").alias("keyword_rank"))
    known = F.broadcast(vector.select("page_id").join(keyword, "page_id")).alias("v")
    better = (F.col("k.score") > F.col("v.score")) | ((F.col("k.score") == F.col("v.score")) & (F.col("k.page_id") <= F.col("v.page_id")))
    counted = keyword.alias("k").join(known, better).groupBy("v.page_id").agg(F.count("*").cast("int").alias("keyword_rank"))
    ranks = head.unionByName(counted).distinct()
    both = ranks.join(vector.select("page_id", F.col("rank").alias("vector_rank")), "page_id", "full_outer")
    score = reciprocal_rank(F.col("keyword_rank")) + reciprocal_rank(F.col("vector_rank"))
    places = [F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword_rank", "vector_rank")]
    return both.select("page_id", score.alias("score"), *places).orderBy(F.desc("score"), "page_id").limit(limit)
