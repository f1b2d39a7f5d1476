"""Upkeep queries: reviews, deletions, duplicates, caches and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions import text as fn
from loreweave.operators import maintain as op
from loreweave.plans.graph import nodes, related_all
from loreweave.plans.snapshots import P4_FOUND, p4_found
from loreweave.plans.text import _KEY
from loreweave.storage import materialize, table
from loreweave.streaming import changes as st



def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "wiki_pages").select(F.col("page_id").alias("id"), "title").distinct()


def _reviews(spark, sf_dir) -> DataFrame:
    head = r"^REVIEW ([a-z-]+) \| ([^\r\n]*)"
    body = F.trim(F.regexp_extract("text", r"^REVIEW [^\r\n]*\r?\n([^\r\n]*)", 1))
    rows = table(spark, sf_dir, "documents").where("text like 'REVIEW %'")
    return rows.select(
        F.col("doc_id").alias("id"), F.regexp_extract("text", head, 1).alias("kind"), fn.review_key(F.regexp_extract("text", head, 2)).alias("key"),
        body.alias("description"), F.col("project_id").alias("project"), "created_at",
    )


def list_union(spark, sf_dir) -> DataFrame:
    """Out-links and in-links of each node as one list."""
    rows = table(spark, sf_dir, "retrieval_nodes").select("page_id", "out_links", "in_links").distinct()
    return rows.select("page_id", F.array_join(op.union_lists(F.col("out_links"), F.col("in_links")), "|").alias("members"))


def page_fate(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir).select("id", "sources")
    gone = n.select(F.explode("sources").alias("source")).where("lower(source) like '%/shared/%'").distinct()
    return op.page_fates(n, gone).select("id", "action", F.array_join("kept", "|").alias("kept"))


def duplicate_titles(spark, sf_dir) -> DataFrame:
    return op.duplicate_groups(_pages(spark, sf_dir))


def duplicate_title_pages(spark, sf_dir) -> DataFrame:
    """The groups of ``duplicate_titles`` with a row per page."""
    return op.duplicate_members(_pages(spark, sf_dir))


def rewritten_links(spark, sf_dir) -> DataFrame:
    n = nodes(spark, sf_dir)
    links = n.select("id", F.posexplode("out_links").alias("place", "target")).where("target is not null")
    moved = op.redirects(n.select("id", "title"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]), "|").alias("targets")  # a page's own links
    return op.rewrite_links(links, moved).groupBy("id").agg(F.count("*").alias("links"), F.sum((F.col("target") != F.col("was")).cast("int")).alias("moved"), listed)


def review_merge(spark, sf_dir) -> DataFrame:
    return op.merge_reviews(_reviews(spark, sf_dir))


def sweep_rules(spark, sf_dir) -> DataFrame:
    return op.sweep_reviews(_reviews(spark, sf_dir), _pages(spark, sf_dir))


def strip_links(spark, sf_dir) -> DataFrame:
    """Bodies without their links to pages that aren't there, by id or title."""
    bodies = table(spark, sf_dir, "page_bodies").select("item_id", "text").where("text is not null").distinct()
    links = bodies.select("item_id", F.explode(fn.wikilinks("text")).alias("target")).select("item_id", fn.ref_key("target").alias("key")).distinct()
    pages = _pages(spark, sf_dir)
    known = pages.select(fn.ref_key("id").alias("key")).unionByName(pages.select(fn.ref_key("title").alias("key"))).where("key is not null").distinct()
    gone = links.join(known, "key", "left_anti").groupBy("item_id").agg(F.collect_set("key").alias("gone"))
    stripped = bodies.join(gone, "item_id")
    text = fn.without_links(F.col("text"), F.col("gone"))
    return stripped.select("item_id", F.size("gone").alias("dead"), F.length(text).alias("chars"), F.md5(text.cast("binary")).alias("hash"))


def _listings(spark, sf_dir) -> DataFrame:
    """The rows of all listings that hold: the latest received of each file."""
    rows = table(spark, sf_dir, "file_snapshots")
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "").alias("path")
    best = F.max(F.struct("received_at", F.lower("hash").alias("hash"), "size", "mtime_ms")).alias("m")
    return rows.select("snapshot_no", "project_id", path, "received_at", "hash", "size", "mtime_ms").groupBy("snapshot_no", "project_id", "path").agg(best).select("snapshot_no", "project_id", "path", "m.hash", "m.size", "m.mtime_ms")


_FILE = ["snapshot_no", "project_id", "path"]


def _with_before(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All listings but the first, and all but the last under the number of the one after it."""
    held = materialize(_listings(spark, sf_dir), "listings")
    after = held.select("snapshot_no").distinct().select((F.col("snapshot_no") - 1).alias("snapshot_no"))
    first = held.agg(F.min("snapshot_no")).first()[0]
    before = held.join(F.broadcast(after), "snapshot_no", "left_semi").withColumn("snapshot_no", F.col("snapshot_no") + 1)
    return held.where(F.col("snapshot_no") > F.lit(first)), before


def ingest_cache_misses(spark, sf_dir) -> DataFrame:
    """Files of every listing that a cache of the one before doesn't hold."""
    return op.cache_misses(*_with_before(spark, sf_dir), _FILE)


def import_changes(spark, sf_dir) -> DataFrame:
    return op.changed_imports(*_with_before(spark, sf_dir), _FILE)


def rescan_prefilter(spark, sf_dir) -> DataFrame:
    """Files whose size or time moved since the listing before, and how many of them differ in hash."""
    now, before = _with_before(spark, sf_dir)
    old = before.select(*_FILE, F.col("hash").alias("h"), F.col("size").alias("s"), F.col("mtime_ms").alias("m"))
    moved = now.join(old, _FILE).where("size <> s or mtime_ms <> m")
    return moved.groupBy("snapshot_no", "project_id").agg(F.count("*").alias("moved"), F.sum((~F.col("hash").eqNullSafe(F.col("h"))).cast("int")).alias("changed"))


def coalesced_changes(spark, sf_dir) -> DataFrame:
    """One kind of change per file over all listings; at most one change per listing is folded."""
    names = F.when(F.col("change") == "added", "created").when(F.col("change") == "removed", "deleted").otherwise("modified")
    changes = p4_found(spark, sf_dir).select("project_id", "path", F.struct("snapshot_no", names.alias("kind")).alias("c"))
    folded = changes.groupBy("project_id", "path").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return folded.select("project_id", "path", op.fold_kinds(F.transform("c", lambda x: x["kind"])).alias("kind"), F.size("c").alias("changes"))


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks ingested by the middle of the table's time, and those that came later."""
    chunks = table(spark, sf_dir, "wiki_chunks").select("chunk_id", "page_id", "chunk_index", "chunk_text", "ingested_at").distinct()
    low, high = chunks.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    middle = F.lit(low + (high - low) / 2) if low else F.current_timestamp()
    return chunks.where(F.col("ingested_at") <= middle), chunks.where(F.col("ingested_at") > middle)


def chunk_upsert(spark, sf_dir) -> DataFrame:
    stored, late = _stored(spark, sf_dir)
    return op.upsert_chunks(stored, late).groupBy("page_id").agg(F.count("*").alias("chunks"), F.max("ingested_at").alias("latest"))


def chunk_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "wiki_chunks").groupBy("page_id").agg(F.countDistinct("chunk_id").alias("chunks"))


def chunk_deletes(spark, sf_dir) -> DataFrame:
    chunks = table(spark, sf_dir, "wiki_chunks").select("chunk_id", "page_id").distinct()
    gone = table(spark, sf_dir, "wiki_pages").where("lower(trim(page_type)) = 'query'").select("page_id")
    return op.delete_pages(chunks, gone)


def wrong_dimensions(spark, sf_dir) -> DataFrame:
    return op.wrong_dimensions(table(spark, sf_dir, "wiki_chunks"))


def embedding_texts(spark, sf_dir) -> DataFrame:
    titles = table(spark, sf_dir, "wiki_pages").groupBy("page_id").agg(F.max("title").alias("title"))
    chunks = table(spark, sf_dir, "wiki_chunks").select("chunk_id", "page_id", "heading_path", "chunk_text").distinct().join(titles, "page_id", "left")
    return chunks.select("chunk_id", F.md5(op.embedding_text(F.col("title"), F.col("heading_path"), F.col("chunk_text")).cast("binary")).alias("hash"))


def _length_model(texts: list[str]) -> list[list[float]]:
    """Stands for a model: a vector of the text's length; 120 characters at most, and no vector for texts with a question mark."""
    if max(map(len, texts), default=0) > 120:
        raise op.Oversize
    return [None if "?" in t else [float(len(t))] for t in texts]


def embedded_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of all pages but the structural ones as a model of short texts takes them; pages without any vector keep what is stored."""
    chunks = table(spark, sf_dir, "wiki_chunks").select("chunk_id", "page_id", "chunk_text").distinct()
    stored = chunks.select("chunk_id", "page_id", F.lit(-1).alias("embedded_chars"))
    return op.embed_pages(chunks, "chunk_text", _length_model, stored)


def merged_duplicates(spark, sf_dir) -> DataFrame:
    """Groups of pages of one title as one page, with the tags of all."""
    tags = table(spark, sf_dir, "wiki_pages").groupBy(F.col("page_id").alias("id")).agg(F.max("tags").alias("tags"))
    made = op.merged_groups(tags, op.duplicate_members(_pages(spark, sf_dir)), ["tags"])
    return made.select("canonical", "pages", F.array_join("tags", "|").alias("tags"))


def clip_union(spark, sf_dir) -> DataFrame:
    """Clips by address; of several the one received first holds."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "received_at", F.regexp_extract("text", r"(https?://[^\s]+)", 1).alias("url")).where("url <> ''")
    return rows.groupBy("url").agg(F.min_by("doc_id", F.struct("received_at", "doc_id")).alias("doc_id"), F.count("*").alias("n"))


def project_changes(spark, sf_dir) -> DataFrame:
    """Files of the listings as changes by their full path, as a watcher of each project reports them."""
    root = F.concat(F.lit("/srv/"), "project_id")
    files = table(spark, sf_dir, "file_snapshots").select("project_id", F.concat(F.lit("\\SRV\\"), "project_id", F.lit("/"), F.regexp_replace("path", r"^\./", "")).alias("path")).distinct()
    return st.project_changes(files, root, excluded_ext=("pdf",)).select("project_id", "rel").distinct().groupBy("project_id").agg(F.count("*").alias("files"), F.min("rel").alias("first"), F.max("rel").alias("last"))


def queue_summary(spark, sf_dir) -> DataFrame:
    kinds = ["signup", "view", "click", "purchase", "error"]
    counted = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return counted.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def _turns(spark, sf_dir) -> DataFrame:
    lines = F.regexp_extract_all("text", F.lit(r"(?md)^((?:user|assistant): [^\r\n]*)"), F.lit(1))
    turns = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conversation"), F.posexplode(lines).alias("turn", "line"))
    return turns.select("conversation", "turn", F.regexp_extract("line", "^([a-z]+): ", 1).alias("role"), F.regexp_replace("line", "^[a-z]+: ", "").alias("content"))


def chat_last_messages(spark, sf_dir) -> DataFrame:
    return op.last_messages(_turns(spark, sf_dir), 4)


def chat_saved_messages(spark, sf_dir) -> DataFrame:
    """The last hundred messages, which the reference keeps of each conversation."""
    return op.last_messages(_turns(spark, sf_dir), 100)


def page_budgets(spark, sf_dir) -> DataFrame:
    """For every node, which of its five most related pages fit 6000 characters, each cut to 2500."""
    sizes = table(spark, sf_dir, "wiki_chunks").select("page_id", "chunk_id", F.length("chunk_text").alias("n")).distinct().groupBy("page_id").agg(F.sum("n").alias("size"))
    near = related_all(spark, sf_dir).join(sizes.withColumnRenamed("page_id", "other"), "other", "left")
    ranked = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", F.coalesce("size", F.lit(0)).alias("size")))).alias("c"))
    taken = op.fill_budget(F.transform("c", lambda x: x["size"]), 6000, 2500)
    return ranked.select("id", F.array_join(F.transform(taken, lambda i: F.element_at("c", i + 1)["other"]), ",").alias("taken"))


def rate_limit(spark, sf_dir) -> DataFrame:
    return op.over_limit(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", 3600, 2).select("event_id", "recent")


QUERIES = {
    f.__name__: f
    for f in (
        list_union, page_fate, duplicate_titles, duplicate_title_pages, rewritten_links, review_merge, sweep_rules, strip_links, ingest_cache_misses, import_changes, rescan_prefilter,
        coalesced_changes, chunk_upsert, chunk_counts, chunk_deletes, wrong_dimensions, embedding_texts, embedded_chunks, merged_duplicates, clip_union, project_changes, queue_summary, chat_last_messages, chat_saved_messages, page_budgets, rate_limit,
    )
}

_NODES = """n AS (SELECT page_id AS id, m.title AS title, m.sources AS sources, m.out_links AS out_links FROM (
  SELECT page_id, max(struct_pack(title, type := lower(trim(page_type, ' ')), sources, out_links)) AS m FROM retrieval_nodes GROUP BY page_id))"""
_REF = r"CASE WHEN regexp_matches(lower(replace({0}, '\', '/')), '(?s)^(.*?/)?raw/sources/') THEN regexp_extract(replace({0}, '\', '/'), '(?is)^(?:.*?/)?raw/sources/(.*)$', 1) ELSE replace({0}, '\', '/') END"
_REVIEWS = rf"""rv AS (
  SELECT doc_id AS id, regexp_extract(text, '^REVIEW ([a-z-]+) \| ([^\r\n]*)', 1) AS kind,
    trim(regexp_replace(regexp_replace(lower(regexp_extract(text, '^REVIEW ([a-z-]+) \| ([^\r\n]*)', 2)), '^({'|'.join(fn.REVIEW_PREFIXES)})[:：]\s*', ''), '\s+', ' ', 'g'), ' ') AS key,
    trim(regexp_extract(text, '^REVIEW [^\r\n]*\r?\n([^\r\n]*)', 1), ' ') AS description, project_id AS project, created_at
  FROM documents WHERE text LIKE 'REVIEW %')"""
_LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
_LISTING = r"""li AS (SELECT no, project_id, path, m.hash AS hash, m.size AS size, m.mtime_ms AS mtime_ms FROM (
  SELECT snapshot_no AS no, project_id, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, arg_max(struct_pack(hash := lower(hash), size, mtime_ms), struct_pack(received_at, h := coalesce(lower(hash), ''), size, mtime_ms)) AS m
  FROM file_snapshots GROUP BY ALL))"""
_MIDDLE = "(SELECT min(ingested_at) + (max(ingested_at) - min(ingested_at)) / 2 FROM wiki_chunks)"
SQL = {
    "list_union": """WITH a AS (SELECT DISTINCT page_id, list_filter(list_concat(coalesce(out_links, []), coalesce(in_links, [])), lambda x: x IS NOT NULL) AS m FROM retrieval_nodes),
b AS (SELECT page_id, x, min(i) AS i FROM (SELECT page_id, lower(unnest(m)) AS x, generate_subscripts(m, 1) AS i FROM a) GROUP BY ALL)
SELECT a.page_id, coalesce(string_agg(a.m[b.i], '|' ORDER BY b.i), '') AS members FROM a LEFT JOIN b USING (page_id) GROUP BY a.page_id, a.m""",
    "page_fate": f"""WITH {_NODES}, s AS (SELECT id, unnest(sources) AS source, generate_subscripts(sources, 1) AS i FROM n),
k AS (SELECT id, source, i, lower({_REF.format('source')}) AS key FROM s), g AS (SELECT DISTINCT key FROM k WHERE source IS NOT NULL AND lower(source) LIKE '%/shared/%'),
j AS (SELECT k.*, g.key IS NOT NULL AS dead FROM k LEFT JOIN g USING (key)),
f AS (SELECT n.id, coalesce(bool_or(dead), false) AS hit, coalesce(string_agg(source, '|' ORDER BY i) FILTER (NOT dead AND source IS NOT NULL), '') AS kept FROM n LEFT JOIN j USING (id) GROUP BY n.id)
SELECT id, CASE WHEN NOT hit THEN 'skip' WHEN kept <> '' THEN 'keep' ELSE 'delete' END AS action, kept FROM f""",
    "duplicate_titles": f"WITH a AS (SELECT DISTINCT page_id AS id, {_KEY.format('title')} AS key FROM wiki_pages) SELECT key, string_agg(id, ',' ORDER BY id) AS pages, count(*) AS size, min(id) AS canonical FROM a WHERE key <> '' GROUP BY key HAVING count(*) > 1",
    "duplicate_title_pages": f"WITH a AS (SELECT DISTINCT page_id AS id, {_KEY.format('title')} AS key FROM wiki_pages) SELECT key, id, count(*) OVER (PARTITION BY key) AS size, min(id) OVER (PARTITION BY key) AS canonical FROM a WHERE key <> '' QUALIFY size > 1",
    "rewritten_links": f"""WITH {_NODES}, k AS (SELECT id, {_KEY.format('title')} AS key FROM n), c AS (SELECT key, min(id) AS new FROM k WHERE key <> '' GROUP BY key),
r AS (SELECT id AS old, new FROM k JOIN c USING (key) WHERE id <> new), l AS (SELECT id, unnest(out_links) AS t, generate_subscripts(out_links, 1) AS i FROM n),
w AS (SELECT l.id, i, t AS was, coalesce(new, t) AS target FROM l LEFT JOIN r ON r.old = l.t WHERE t IS NOT NULL),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id, lower(target) ORDER BY i) = 1)
SELECT id, count(*) AS links, sum((target <> was)::INT)::BIGINT AS moved, string_agg(target, '|' ORDER BY i) AS targets FROM f GROUP BY id""",
    "review_merge": f"WITH {_REVIEWS} SELECT kind, key, arg_min(id, (created_at, id)) AS first_id, arg_max(id, (created_at, id)) AS last_id, count(*) AS n, arg_max(description, (created_at, id)) FILTER (description <> '') AS description, count(DISTINCT project) AS projects FROM rv GROUP BY kind, key",
    "sweep_rules": f"""WITH {_REVIEWS}, nm AS (SELECT lower(page_id) AS name FROM wiki_pages UNION SELECT lower(trim(title, ' ')) FROM wiki_pages WHERE title IS NOT NULL),
f AS (SELECT id FROM rv WHERE key IN (SELECT name FROM nm) OR regexp_replace(key, '\\s+', '-', 'g') IN (SELECT name FROM nm))
SELECT id, CASE kind WHEN 'duplicate' THEN 'page is gone' ELSE 'page exists' END AS reason FROM rv WHERE (kind = 'missing-page' AND id IN (SELECT id FROM f)) OR (kind = 'duplicate' AND id NOT IN (SELECT id FROM f))""",
    "strip_links": rf"""WITH b AS (SELECT DISTINCT item_id, text FROM page_bodies WHERE text IS NOT NULL),
l AS (SELECT item_id, unnest(regexp_extract_all(text, '(\[\[[^\]|]+(?:\|[^\]]*)?\]\])', 1)) AS link FROM b),
k AS (SELECT item_id, link, regexp_extract(link, '{_LINK}', 1) AS target, regexp_extract(link, '\|([^\]]*)\]\]$', 1) AS alias FROM l),
d AS (SELECT item_id, link, {_KEY.format('target')} AS key, length(link) - length(CASE WHEN alias <> '' THEN alias ELSE target END) AS less FROM k),
g AS (SELECT item_id, count(DISTINCT key) AS dead, sum(less) AS less, list(DISTINCT link ORDER BY link) AS links FROM d WHERE key NOT IN (SELECT {_KEY.format('page_id')} FROM wiki_pages UNION ALL SELECT {_KEY.format('title')} FROM wiki_pages WHERE title IS NOT NULL) GROUP BY item_id)
SELECT item_id, dead::INT AS dead, (length(text) - less)::INT AS chars, md5(list_reduce(links, lambda s, x: replace(s, x, coalesce(nullif(regexp_extract(x, '\|([^\]]*)\]\]$', 1), ''), regexp_extract(x, '{_LINK}', 1))), text)) AS hash FROM b JOIN g USING (item_id)""",
    "ingest_cache_misses": f"""WITH {_LISTING}, j AS (SELECT a.no, a.project_id, a.path, a.hash, b.hash AS old, b.path IS NOT NULL AS known FROM (SELECT * FROM li WHERE no > (SELECT min(no) FROM li)) a LEFT JOIN (SELECT * REPLACE (no + 1 AS no) FROM li) b USING (no, project_id, path))
SELECT no AS snapshot_no, project_id, path, CASE WHEN NOT known THEN 'new' WHEN hash IS NULL OR old IS NULL THEN 'no hash' ELSE 'changed' END AS reason FROM j WHERE NOT known OR hash IS NULL OR old IS NULL OR hash <> old""",
    "import_changes": f"WITH {_LISTING} SELECT no AS snapshot_no, project_id, path, size, mtime_ms FROM li WHERE no > (SELECT min(no) FROM li) EXCEPT SELECT no + 1, project_id, path, size, mtime_ms FROM li",
    "rescan_prefilter": f"WITH {_LISTING} SELECT a.no AS snapshot_no, project_id, count(*) AS moved, sum((a.hash IS DISTINCT FROM b.hash)::INT)::BIGINT AS changed FROM li a JOIN (SELECT * REPLACE (no + 1 AS no) FROM li) b USING (no, project_id, path) WHERE a.size <> b.size OR a.mtime_ms <> b.mtime_ms GROUP BY a.no, project_id",
    "coalesced_changes": f"""WITH c AS (SELECT snapshot_no AS n, project_id, path, CASE change WHEN 'added' THEN 'created' WHEN 'removed' THEN 'deleted' ELSE 'modified' END AS kind FROM ({P4_FOUND}))
SELECT project_id, path, list_reduce(list(kind ORDER BY n), lambda a, b: CASE WHEN (a = 'deleted' AND b = 'created') OR (a = 'created' AND b = 'deleted') THEN 'modified' ELSE b END) AS kind, count(*)::INT AS changes FROM c GROUP BY project_id, path""",
    "chunk_upsert": f"""WITH c AS (SELECT DISTINCT chunk_id, page_id, chunk_index, chunk_text, ingested_at FROM wiki_chunks), late AS (SELECT * FROM c WHERE ingested_at > {_MIDDLE}),
u AS (SELECT * FROM c WHERE ingested_at <= {_MIDDLE} AND page_id NOT IN (SELECT page_id FROM late) UNION ALL SELECT * FROM late)
SELECT page_id, count(*) AS chunks, max(ingested_at) AS latest FROM u GROUP BY page_id""",
    "chunk_counts": "SELECT page_id, count(DISTINCT chunk_id) AS chunks FROM wiki_chunks GROUP BY page_id",
    "chunk_deletes": "SELECT DISTINCT chunk_id, page_id FROM wiki_chunks WHERE page_id NOT IN (SELECT page_id FROM wiki_pages WHERE lower(trim(page_type, ' ')) = 'query')",
    "wrong_dimensions": "SELECT DISTINCT chunk_id, coalesce(len(embedding), 0)::INT AS length FROM wiki_chunks WHERE coalesce(len(embedding), 0) <> (SELECT len(embedding) FROM wiki_chunks WHERE embedding IS NOT NULL ORDER BY chunk_id LIMIT 1)",
    "embedding_texts": "SELECT DISTINCT chunk_id, md5(concat_ws(chr(10) || chr(10), nullif(trim(t.title, ' '), ''), nullif(trim(heading_path, ' '), ''), nullif(trim(chunk_text, ' '), ''))) AS hash FROM wiki_chunks LEFT JOIN (SELECT page_id, max(title) AS title FROM wiki_pages GROUP BY page_id) t USING (page_id)",
    "embedded_chunks": r"""WITH c AS (SELECT DISTINCT chunk_id, page_id, coalesce(chunk_text, '') AS t FROM wiki_chunks),
h AS (SELECT *, CASE WHEN length(t) <= 120 THEN t WHEN length(t) // 2 <= 120 THEN substr(t, 1, length(t) // 2) WHEN length(t) // 2 // 2 <= 120 THEN substr(t, 1, length(t) // 2 // 2) WHEN length(t) // 2 // 2 // 2 <= 120 THEN substr(t, 1, length(t) // 2 // 2 // 2) END AS s FROM c),
n AS (SELECT chunk_id, page_id, length(s)::INT AS embedded_chars FROM h WHERE s IS NOT NULL AND NOT contains(s, '?') AND lower(page_id) NOT IN ('index', 'log', 'overview', 'purpose', 'schema'))
SELECT * FROM n UNION ALL SELECT chunk_id, page_id, -1 FROM c WHERE page_id NOT IN (SELECT page_id FROM n)""",
    "merged_duplicates": f"""WITH a AS (SELECT DISTINCT page_id AS id, {_KEY.format('title')} AS key FROM wiki_pages), g AS (SELECT id, min(id) OVER (PARTITION BY key) AS canonical, count(*) OVER (PARTITION BY key) AS n FROM a WHERE key <> ''),
t AS (SELECT page_id AS id, max(tags) AS tags FROM wiki_pages GROUP BY page_id), m AS (SELECT DISTINCT id, canonical FROM g WHERE n > 1),
u AS (SELECT canonical, m.id, unnest(tags) AS x, generate_subscripts(tags, 1) AS i FROM m JOIN t USING (id)),
f AS (SELECT * FROM u WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical, lower(x) ORDER BY (id <> canonical), id, i) = 1)
SELECT canonical, count(DISTINCT m.id) AS pages, coalesce((SELECT string_agg(x, '|' ORDER BY (id <> f.canonical), id, i) FROM f WHERE f.canonical = m.canonical), '') AS tags FROM m GROUP BY canonical""",
    "clip_union": "SELECT url, arg_min(doc_id, (received_at, doc_id)) AS doc_id, count(*) AS n FROM (SELECT doc_id, received_at, regexp_extract(text, '(https?://[^\\s]+)', 1) AS url FROM documents) WHERE url <> '' GROUP BY url",
    "project_changes": r"""WITH a AS (SELECT DISTINCT project_id, replace(regexp_replace(path, '^\./', ''), '\', '/') AS q FROM file_snapshots), b AS (SELECT *, lower(q) AS p, regexp_replace(lower(q), '^.*/', '') AS n FROM a)
SELECT project_id, count(*) AS files, min(q) AS first, max(q) AS last FROM (SELECT DISTINCT project_id, q FROM b WHERE NOT contains('/' || p, '/.store/') AND NOT starts_with(p, 'wiki/media/') AND NOT p LIKE '%.ds_store' AND n NOT IN ('thumbs.db', 'desktop.ini')
  AND CASE WHEN starts_with(q, 'raw/sources/') THEN n NOT LIKE '%.pdf' ELSE q IN ('purpose.md', 'schema.md') OR (starts_with(q, 'wiki/') AND q LIKE '%.md') END) GROUP BY project_id""",
    "queue_summary": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("signup", "view", "click", "purchase", "error")) + " FROM events GROUP BY user_id",
    "chat_last_messages": r"""WITH a AS (SELECT doc_id AS conversation, regexp_extract_all(text, '(?m)^((?:user|assistant): [^\r\n]*)', 1) AS l FROM documents),
b AS (SELECT conversation, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS turn FROM a)
SELECT conversation, turn::INT AS turn, regexp_extract(line, '^([a-z]+): ', 1) AS role, regexp_replace(line, '^[a-z]+: ', '') AS content, (row_number() OVER (PARTITION BY conversation ORDER BY turn DESC))::INT AS back FROM b QUALIFY back <= 4""",
    "chat_saved_messages": r"""WITH a AS (SELECT doc_id AS conversation, regexp_extract_all(text, '(?m)^((?:user|assistant): [^\r\n]*)', 1) AS l FROM documents),
b AS (SELECT conversation, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS turn FROM a)
SELECT conversation, turn::INT AS turn, regexp_extract(line, '^([a-z]+): ', 1) AS role, regexp_replace(line, '^[a-z]+: ', '') AS content, (row_number() OVER (PARTITION BY conversation ORDER BY turn DESC))::INT AS back FROM b QUALIFY back <= 100""",
    "rate_limit": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events QUALIFY recent > 2",
}
