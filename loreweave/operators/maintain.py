"""Upkeep of a knowledge base: unions, deletions, duplicates, reviews, caches and chunk tables.

All operators take and return DataFrames. Where rows of one key are ordered, the
order has a last, unique column, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import ref_key, source_identity


def union_lists(*lists: Column) -> Column:
    """Members of the lists in order, letter case ignored, the first spelling kept; null lists count as empty."""
    none = F.array().cast("array<string>")
    members = F.filter(F.concat(*[F.coalesce(x, none) for x in lists]), lambda x: x.isNotNull())
    keys = F.transform(members, lambda x: F.lower(x))
    return F.transform(F.array_distinct(keys), lambda k: F.element_at(members, F.array_position(keys, k).cast("int")))


def page_fates(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """What deleting sources does to each page: id, action, kept (its other sources).

    ``pages`` has id and sources, ``gone`` has source. A page without any of them is
    skipped, one with others too is kept without them, else it is deleted.
    Identities are compared with letter case ignored; null members are dropped.
    """
    named = pages.select("id", F.posexplode_outer("sources").alias("place", "source"))
    named = named.withColumn("key", F.lower(source_identity("source", keep_unmatched=True)))
    dead = gone.select(F.lower(source_identity("source", keep_unmatched=True)).alias("key")).where("key is not null").distinct().withColumn("dead", F.lit(True))
    joined = named.join(dead, "key", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    kept = F.filter(F.array_sort(F.collect_list(F.when(~F.col("dead") & F.col("source").isNotNull(), F.struct("place", "source")))), lambda x: x.isNotNull())
    # A page's own list is what is collected, so a group is as long as that list.
    found = joined.groupBy("id").agg(F.max("dead").alias("hit"), kept.alias("kept"))
    action = F.when(~F.col("hit"), "skip").when(F.size("kept") > 0, "keep").otherwise("delete")
    return found.select("id", action.alias("action"), F.transform("kept", lambda x: x["source"]).alias("kept"))


def duplicate_groups(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Pages whose titles have one key: key, pages (sorted ids joined by commas), size, canonical (the first).

    ``known`` holds groups (pages) that were found not to be duplicates. The joined ids
    of a group are one value, whatever its size; ``duplicate_members`` has a row per page.
    """
    keyed = pages.select("id", ref_key("title").alias("key")).where("key <> ''").distinct()
    listed = keyed.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("pages"), F.count("*").alias("size"), F.min("id").alias("canonical"))
    groups = listed.where("size > 1").select("key", "pages", "size", "canonical")
    if known is None:
        return groups
    plain = lambda c: F.array_join(F.array_sort(F.split(F.lower(c), ",")), ",")
    return groups.withColumn("g", plain(F.col("pages"))).join(known.select(plain(F.col("pages")).alias("g")).distinct(), "g", "left_anti").drop("g")


def duplicate_members(pages: DataFrame) -> DataFrame:
    """Each page whose title's key others have too: key, id, size of the group, canonical (its first id)."""
    keyed = pages.select("id", ref_key("title").alias("key")).where("key <> ''").distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("canonical")).where("size > 1")
    return keyed.join(sizes, "key").select("key", "id", "size", "canonical")


def redirects(pages: DataFrame) -> DataFrame:
    """Where links to merged pages lead: old, new (the canonical page of its title key)."""
    keyed = pages.select("id", ref_key("title").alias("key")).where("key <> ''").distinct()
    canonical = keyed.groupBy("key").agg(F.min("id").alias("new"))
    return keyed.join(canonical, "key").where("id <> new").select(F.col("id").alias("old"), "new")


def rewrite_links(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links after the redirects, each once per page, the first place kept: id, place, target, was."""
    led = links.join(moved, links["target"] == moved["old"], "left").select("id", "place", F.coalesce("new", "target").alias("target"), F.col("target").alias("was"))
    first = Window.partitionBy("id", F.lower("target")).orderBy("place")
    return led.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def merge_reviews(reviews: DataFrame) -> DataFrame:
    """Pending reviews of one kind and title key as one: kind, key, first_id, last_id, count, description, projects.

    The newest description that isn't empty holds; ties go to the greater id. Distinct projects are counted.
    """
    last = F.struct(F.col("created_at"), F.col("id"))
    described = F.when(F.coalesce(F.trim("description"), F.lit("")) != "", F.struct("created_at", "id", "description"))
    grouped = reviews.groupBy("kind", "key").agg(
        F.min_by("id", last).alias("first_id"), F.max_by("id", last).alias("last_id"), F.count("*").alias("n"),
        F.max(described).alias("d"), F.countDistinct("project").alias("projects"),
    )
    return grouped.select("kind", "key", "first_id", "last_id", "n", F.col("d.description").alias("description"), "projects")


def sweep_reviews(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """Reviews that the pages settle: id, reason.

    A missing page is settled if its title names a page by id, by id with hyphens,
    or by title; a duplicate is settled if its subject names none any more.
    """
    names = pages.select(F.lower("id").alias("name")).unionByName(pages.where("title is not null").select(F.lower(F.trim("title")).alias("name"))).distinct()
    asked = reviews.select("id", "kind", F.explode(F.array_distinct(F.array("key", F.regexp_replace("key", r"\s+", "-")))).alias("name"))
    found = asked.join(names, "name", "left_semi").select("id").distinct()
    missing = reviews.where("kind = 'missing-page'").join(found, "id", "left_semi").select("id", F.lit("page exists").alias("reason"))
    gone = reviews.where("kind = 'duplicate'").join(found, "id", "left_anti").select("id", F.lit("page is gone").alias("reason"))
    return missing.unionByName(gone)


def cache_misses(now: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Files to process: not in the cache, or with another or an unknown hash: keys, reason."""
    old = cached.select(*keys, F.lower("hash").alias("old"), F.lit(True).alias("known")).dropDuplicates(keys)
    both = now.select(*keys, F.lower("hash").alias("hash")).join(old, keys, "left")
    reason = F.when(F.col("known").isNull(), "new").when(F.col("hash").isNull() | F.col("old").isNull(), "no hash").when(F.col("hash") != F.col("old"), "changed")
    return both.select(*keys, reason.alias("reason")).where("reason is not null")


def changed_imports(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose fingerprint of size and time isn't among the earlier ones."""
    mark = [*keys, "size", "mtime_ms"]
    return now.select(*mark).distinct().join(before.select(*mark).distinct(), mark, "left_anti")


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks with all chunks of the incoming pages replaced; nothing incoming changes nothing."""
    return stored.join(incoming.select("page_id").distinct(), "page_id", "left_anti").unionByName(incoming.select(*stored.columns))


def delete_pages(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks of the other pages; pages without chunks may be among the deleted."""
    return chunks.join(gone.select("page_id").distinct(), "page_id", "left_anti")


def wrong_dimensions(chunks: DataFrame) -> DataFrame:
    """Chunks whose vector hasn't the length of the first chunk's, by chunk_id: chunk_id, length."""
    first = chunks.where("embedding is not null").agg(F.min_by(F.size("embedding"), "chunk_id")).first()[0]
    length = F.coalesce(F.size("embedding"), F.lit(0))
    return chunks.select("chunk_id", F.when(F.col("embedding").isNull(), 0).otherwise(length).alias("length")).distinct().where(F.col("length") != F.lit(first or 0))


def embedding_text(title: Column, heading: Column, text: Column) -> Column:
    """What is embedded of a chunk: title, heading path and text, blank ones left out, a blank line between."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (title, heading, text)]
    return F.concat_ws("\n\n", *parts)


class Oversize(Exception):
    """What an injected model raises for a text that is too long for it."""


#: Halvings of a text that is too long, the length below which none is halved, and pages that aren't embedded.
HALVINGS, LEAST_HALVED, UNEMBEDDED = 3, 64, ("index", "log", "overview", "purpose", "schema")


def _fitted(embed: Callable[[list[str]], list], text: str) -> tuple[list[float] | None, int]:
    """The vector of the longest part that the model takes, and that part's length; None after the last halving."""
    for halving in range(HALVINGS + 1):
        try:
            return embed([text])[0], len(text)
        except Oversize:
            if halving == HALVINGS or len(text) <= LEAST_HALVED:
                return None, len(text)
            text = text[: len(text) // 2]
    return None, len(text)


def embed_chunks(chunks: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """``chunks`` with ``embedding`` and ``embedded_chars`` from an injected model that takes texts in batches.

    The function runs in the tasks. Where it raises :class:`Oversize` for a batch, the batch's texts are tried alone, and
    each that is too long by itself is halved up to three times while it has more than 64 characters. A text that stays
    too long, or for which it gives None, has a null embedding. A null text counts as empty.
    """
    @F.pandas_udf("embedding array<float>, embedded_chars int")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        found: list = []
        for start in range(0, len(texts), batch):
            part = texts.iloc[start : start + batch].fillna("").tolist()
            try:
                found.extend(zip(embed(part), map(len, part)))
            except Oversize:
                found.extend(_fitted(embed, t) for t in part)
        return pd.DataFrame(found, columns=["embedding", "embedded_chars"])

    made = chunks.withColumn("_made", vectors(text))
    return made.select(*chunks.columns, "_made.embedding", "_made.embedded_chars")


def embed_pages(chunks: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], stored: DataFrame | None = None) -> DataFrame:
    """Chunks of all pages but the structural ones, embedded; failed chunks are left out.

    ``stored`` holds earlier chunks of the same columns: those of a page with at least one new vector are replaced, those of
    other pages stay.
    """
    made = embed_chunks(chunks.where(~F.lower("page_id").isin(*UNEMBEDDED)), text, embed).where("embedding is not null")
    return made if stored is None else upsert_chunks(stored, made.select(*stored.columns)).select(*stored.columns)


def merged_groups(pages: DataFrame, members: DataFrame, lists: list[str]) -> DataFrame:
    """One row per group of duplicates: canonical, pages (how many), and each list united over its pages.

    ``pages`` has id and the lists, ``members`` id and canonical. Members of the canonical page come first, then
    those of the others by id; letter case is ignored and the first spelling kept. Members are numbered and united by
    key, so a group of any size is spread; a list is as long as its different members.
    """
    rows = members.select("id", "canonical").distinct().join(pages, "id")
    made = rows.groupBy("canonical").agg(F.countDistinct("id").alias("pages"))
    for name in lists:
        named = rows.select("canonical", "id", F.posexplode(name).alias("place", "member")).where("member is not null")
        first = named.groupBy("canonical", F.lower("member").alias("key")).agg(F.min(F.struct((F.col("id") != F.col("canonical")).alias("other"), "id", "place", "member")).alias("m"))
        listed = first.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["member"]).alias(name))
        made = made.join(listed, "canonical", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return made


def fold_kinds(kinds: Column) -> Column:
    """One kind of change for a file's changes in order.

    A modification makes it modified; created after deleted, or deleted after created, is modified
    too; else the later kind holds. Null for no changes.
    """
    start = F.lit(None).cast("string")
    opposite = lambda a, b: ((a == "deleted") & (b == "created")) | ((a == "created") & (b == "deleted"))
    return F.aggregate(kinds, start, lambda a, b: F.when(F.coalesce(opposite(a, b), F.lit(False)), F.lit("modified")).otherwise(b))


def fill_budget(sizes: Column, budget: int, most: int) -> Column:
    """Places (from 0) of the pages that fit: each is cut to ``most``, one that doesn't fit is passed over."""
    none = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"))

    def add(state: Column, page: Column) -> Column:
        size = F.least(page["size"].cast("bigint"), F.lit(most).cast("bigint"))
        fits = (state["used"] + size) <= budget
        return F.when(fits, F.struct((state["used"] + size).alias("used"), F.concat(state["taken"], F.array(page["place"])).alias("taken"))).otherwise(state)

    placed = F.transform(sizes, lambda s, i: F.struct(i.alias("place"), s.alias("size")))
    return F.aggregate(placed, none, add, lambda s: s["taken"])


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation: conversation, turn, role, content, back (1 is the last)."""
    order = Window.partitionBy("conversation").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def over_limit(requests: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests that have ``limit`` or more others of their key in the ``seconds`` before them, all counted."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return requests.withColumn("recent", F.count("*").over(frame)).where(F.col("recent") > limit)
