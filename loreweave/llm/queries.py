"""Queries of the numbered problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.mixing import mix_sources, schedule_deviation
from loreweave.llm.near_duplicates import Shape, near_duplicate_classes, near_duplicate_groups, near_duplicate_pairs
from loreweave.llm.set_join import normal_values, similar_set_pairs
from loreweave.llm.splitting import oversized_places, split_texts
from loreweave.llm.tokens import count_tokens, encode
from loreweave.llm.vector_neighbours import NEAR, exact_neighbours, nearest_neighbours, neighbour_pairs
from loreweave.llm.visual_forms import alike_pairs, visual_forms
from loreweave.storage import table

TITLES = Shape("char", 3, 0.7)
CHUNKS = Shape("word", 2, 0.7)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "wiki_pages").select(F.col("page_id").alias("key"), plain.alias("text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wiki_chunks").select(F.col("chunk_id").alias("key"), F.lower("chunk_text").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of page titles and of chunk texts that are versions of one another."""
    titles = near_duplicate_pairs(_titles(spark, sf_dir), "key", "text", TITLES)
    chunks = near_duplicate_pairs(_chunks(spark, sf_dir), "key", "text", CHUNKS)
    found = titles.select(F.lit("title").alias("kind"), "key_a", "key_b")
    return found.unionByName(chunks.select(F.lit("chunk").alias("kind"), "key_a", "key_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page title and chunk text with the class of its copies and the number of similar classes."""
    titles = near_duplicate_classes(_titles(spark, sf_dir), "key", "text", TITLES)
    chunks = near_duplicate_classes(_chunks(spark, sf_dir), "key", "text", CHUNKS)
    return titles.select(F.lit("title").alias("kind"), "*").unionByName(chunks.select(F.lit("chunk").alias("kind"), "*"))


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its copies and the number of similar ones: five words of any script, similarity 0.8."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return near_duplicate_classes(texts, "doc_id", "text").withColumnRenamed("key", "doc_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages and of chunks that are versions of one another, named by their least key."""
    titles = near_duplicate_groups(_titles(spark, sf_dir), "key", "text", TITLES)
    chunks = near_duplicate_groups(_chunks(spark, sf_dir), "key", "text", CHUNKS)
    return titles.select(F.lit("title").alias("kind"), "key", "group").unionByName(chunks.select(F.lit("chunk").alias("kind"), "key", "group"))


def _value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields as one table: grp is the kind; a field that is joined with itself is on both sides."""
    nodes, pages = table(spark, sf_dir, "retrieval_nodes"), table(spark, sf_dir, "wiki_pages")
    fields = [("tags", pages), *((f, nodes) for f in ("out_links", "in_links", "sources"))]
    # Values are brought to one form before the rows are doubled.
    listed = lambda t, key, field: t.select(F.col(key).alias("key"), normal_values(field).alias("values"))
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    parts = [listed(t, "page_id", f).select(F.lit(f).alias("grp"), both, F.lit(True).alias("both"), "key", "values") for f, t in fields]
    for side, (t, key) in enumerate(((pages, "page_id"), (table(spark, sf_dir, "tag_profiles"), "profile_id"))):
        parts.append(listed(t, key, "tags").select(F.lit("profile").alias("grp"), F.lit(side).alias("side"), F.lit(False).alias("both"), "key", "values"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages, nodes and profiles whose sets of values overlap by 0.7 or more."""
    return similar_set_pairs(_value_sets(spark, sf_dir)).select(F.col("grp").alias("kind"), "key_a", "key_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk pairs with cosine 0.9 or more of which one is among the other's five best."""
    return neighbour_pairs(table(spark, sf_dir, "wiki_chunks"), "chunk_id", "embedding", k=5, min_similarity=0.9, how=NEAR)


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks with the most similar embeddings, however similar, of every fiftieth chunk (by the hash of its id) among all."""
    asks = F.pmod(F.xxhash64("chunk_id"), F.lit(50)) == 0
    return nearest_neighbours(table(spark, sf_dir, "wiki_chunks"), "chunk_id", "embedding", k=5, asks=asks)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks with the most similar embeddings for every chunk, however similar, by comparing all with all."""
    return exact_neighbours(table(spark, sf_dir, "wiki_chunks"), "chunk_id", "embedding", k=5)


def _pieces(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    options = table(spark, sf_dir, "chunk_options").dropDuplicates(["opt_id"])
    bodies = table(spark, sf_dir, "page_bodies").select("item_id", "opt_id", "text")
    bodies = (bodies.distinct() if once else bodies).join(options, "opt_id", "left")
    sizes = {n: F.col(n) for n in ("target_chars", "max_chars", "min_chars", "overlap_chars")}
    return split_texts(bodies, "item_id", "text", sizes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and sections of page bodies that are longer than max_chars."""
    return oversized_places(_pieces(spark, sf_dir), "item_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all page bodies; equal rows are cut once."""
    pieces = _pieces(spark, sf_dir, once=True)
    return pieces.select("item_id", "start_char", "end_char", "text", "heading_path", "is_block", "oversized")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets").select("source", F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    sized = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "tokens")
    return mix_sources(sized, "doc_id", "source", "tokens", targets)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with repeats, in the order of slot and place."""
    return _mix(spark, sf_dir)[0].withColumnRenamed("size", "tokens")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reaches."""
    return _mix(spark, sf_dir)[1].withColumnRenamed("size", "tokens")


def p7_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source ever is from its weight, in blocks, over all slots of the mix."""
    return schedule_deviation(_mix(spark, sf_dir)[0])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and consist of different characters."""
    return alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every document."""
    return visual_forms(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p1_classes": p1_classes, "p1_documents": p1_documents, "p2_found": p2_found, "p3_found": p3_found, "p3_nearest": p3_nearest, "p3_neighbours": p3_neighbours, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_deviation": p7_deviation, "p8_found": p8_found, "p8_forms": p8_forms}
