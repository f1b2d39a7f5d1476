"""Names that stand for pages, files and images, resolved by equi-joins; of several targets the first by path holds.

Null names resolve to nothing; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.pages import summary_slug
from loreweave.functions.text import frontmatter, list_field, source_identity


def _name(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def pages_by_hit(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Vector hits (page_id, ...) with the path of their page: by its file name or its path below wiki/, without ``.md``, letter case ignored."""
    rel = F.lower(F.regexp_replace(F.regexp_replace(_slashed(F.col("path")), "^wiki/", ""), r"\.md$", ""))
    keys = pages.select("path", F.explode(F.array(_name(rel), rel)).alias("key")).groupBy("key").agg(F.min("path").alias("path"))
    return hits.join(keys, F.lower("page_id") == keys["key"]).drop("key")


def related_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References (id, ref) with the page they name: a path in the project, a file name, or a slug: id, ref, path (null if none)."""
    paths = pages.select("path").where("path like 'wiki/%'").distinct()
    targets = paths.select(F.col("path").alias("key"), "path").unionByName(paths.select(_name(F.col("path")).alias("key"), "path")).groupBy("key").agg(F.min("path").alias("path"))
    named = F.when(F.contains("ref", F.lit("/")) | F.col("ref").endswith(".md"), F.col("ref")).otherwise(F.concat("ref", F.lit(".md")))
    asked = refs.where("ref is not null").distinct().withColumn("key", named)
    return asked.join(targets, "key", "left").select("id", "ref", "path")


def source_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Source references (id, ref) with the file they name: id, ref, path (null if none).

    A path is tried below raw/sources/ and from the project, a bare Markdown name in wiki/sources/ first, any other bare
    name anywhere below raw/sources/.
    """
    paths = files.select("path").distinct()
    below = lambda folder, kind: paths.where(F.col("path").startswith(folder)).select(F.concat(F.lit(kind), _name(F.col("path"))).alias("key"), "path")
    targets = paths.select(F.concat(F.lit("path:"), "path").alias("key"), "path").unionByName(below("wiki/sources/", "wiki:")).unionByName(below("raw/sources/", "raw:"))
    targets = targets.groupBy("key").agg(F.min("path").alias("path"))
    ref = F.regexp_replace(_slashed(F.col("ref")), "^/+", "")
    nested = F.contains("ref", F.lit("/"))
    whole = F.concat(F.lit("path:"), ref)
    ladder = F.when(nested & ref.rlike("^(raw/sources|wiki)/"), F.array(whole)).when(nested, F.array(F.concat(F.lit("path:raw/sources/"), ref), whole))
    ladder = ladder.when(F.col("ref").endswith(".md"), F.array(F.concat(F.lit("wiki:"), "ref"), F.concat(F.lit("raw:"), "ref"))).otherwise(F.array(F.concat(F.lit("raw:"), "ref")))
    asked = refs.where("ref is not null").distinct().select("id", "ref", F.posexplode(ladder).alias("place", "key"))
    found = asked.join(targets, "key", "left").groupBy("id", "ref")
    return found.agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("place"))).alias("path"))


def image_sources(images: DataFrame, files: DataFrame) -> DataFrame:
    """Image addresses (url) with the raw file they were taken from: by the slug of its identity, or its name, in the folder below media/."""
    identity = source_identity("path")
    names = F.array(summary_slug(identity), F.regexp_replace(_name(F.col("path")), r"\.[^.]+$", ""))
    slugs = files.where("path like 'raw/sources/%'").select("path", F.explode(names).alias("slug")).groupBy("slug").agg(F.min("path").alias("path"))
    asked = images.select("url").distinct().withColumn("slug", F.regexp_extract(_slashed(F.col("url")), r"(?:^|/)media/([^/]+)/", 1)).where("slug <> ''")
    return asked.join(slugs, "slug", "left").select("url", "path")


def pages_of_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages (path, text) that belong to source files (name): name, path, how (quoted, summary, listed).

    Quoted: the name stands in quotes anywhere; summary: a page in a folder ``sources`` whose name starts with the file's stem;
    listed: a member of the sources in the frontmatter has that file name. Index, log and overview take no part; letter
    case is ignored. Every way is an equi-join: on what stands between quotes, on the beginnings of a page's name, on the members.
    """
    wanted = sources.select(F.lower(_name(_slashed(F.col("name")))).alias("name")).where("name <> ''").distinct()
    rows = pages.where(~_name(F.col("path")).isin("index.md", "log.md", "overview.md")).select("path", F.lower("text").alias("text"))

    def between(quote: str) -> Column:
        parts = F.split("text", quote)
        return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))

    quoted = rows.where("text is not null").select("path", F.explode(F.array_distinct(F.concat(between('"'), between("'")))).alias("name")).where(F.length("name") <= 255)
    listed = rows.select("path", F.explode(F.transform(list_field(frontmatter("text"), "sources"), lambda s: _name(_slashed(s)))).alias("name"))
    file = F.lower(_name(F.col("path")))
    begun = rows.where(F.col("path").rlike("(^|/)sources/")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length(file)), lambda n: F.substring(file, F.lit(1), n))).alias("stem"))
    stems = wanted.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("stem", F.when(F.col("stem") == "", F.col("name")).otherwise(F.col("stem")))
    parts = [
        quoted.join(wanted, "name").select("name", "path", F.lit("quoted").alias("how")),
        begun.join(stems, "stem").select("name", "path", F.lit("summary").alias("how")),
        listed.join(wanted, "name").select("name", "path", F.lit("listed").alias("how")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def filtered_graph(nodes: DataFrame, edges: DataFrame, text: str | None = None, kind: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes whose id or title contains a text and that are of a type, the first 1 to 1000 by id, and the edges between them."""
    if text:
        nodes = nodes.where(F.contains(F.lower("id"), F.lit(text.lower())) | F.coalesce(F.contains(F.lower("title"), F.lit(text.lower())), F.lit(False)))
    if kind:
        nodes = nodes.where(F.col("type") == kind.lower())
    nodes = nodes.orderBy("id").limit(min(max(limit, 1), 1000))
    ids = F.broadcast(nodes.select("id"))  # 1000 at most
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept


def queue_heads(tasks: DataFrame, queue: str, order: list[str]) -> DataFrame:
    """The first pending task of each queue; queues without one are left out."""
    rest = [c for c in tasks.columns if c != queue]
    pending = tasks.where("status = 'pending'")
    return pending.groupBy(queue).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("t")).select(queue, "t.*")


def queued(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """Tasks (project, path, status, retries, context) after requests (project, path, context).

    A pending or failed task of the path waits again without retries, and keeps its context unless a new one comes; else a
    pending one is added, beside one that is running. Paths are compared with letter case and kind of slashes ignored; one request per path holds.
    """
    key = lambda c: F.lower(_slashed(F.col(c)))
    new = asked.groupBy("project", key("path").alias("key")).agg(F.max(F.struct("path", "context")).alias("m")).select("project", "key", F.col("m.path").alias("asked"), F.col("m.context").alias("more"))
    old = tasks.withColumn("key", key("path"))
    waits = F.col("asked").isNotNull() & F.col("status").isin("pending", "failed")
    kept = old.join(new, ["project", "key"], "left").select(
        "project", F.when(waits, F.col("asked")).otherwise(F.col("path")).alias("path"), F.when(waits, "pending").otherwise(F.col("status")).alias("status"),
        F.when(waits, 0).otherwise(F.col("retries")).alias("retries"), F.when(waits, F.coalesce(F.nullif("more", F.lit("")), F.col("context"))).otherwise(F.col("context")).alias("context"),
    )
    open_ = old.where("status in ('pending', 'failed')").select("project", "key").distinct()
    added = new.join(open_, ["project", "key"], "left_anti").select("project", F.col("asked").alias("path"), F.lit("pending").alias("status"), F.lit(0).alias("retries"), F.col("more").alias("context"))
    return kept.unionByName(added)
