"""Queries over names: titles, slugs, safe paths, languages, and what references lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import names as fn
from loreweave.functions.pages import summary_slug
from loreweave.functions.text import source_identity
from loreweave.operators import resolve as op
from loreweave.plans import graph, search, text
from loreweave.storage import table


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def document_languages(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", fn.language_name("lang").alias("language"))
    return rows.select("doc_id", "language", fn.language_about("language").alias("a")).select("doc_id", "language", "a.*")


def query_files(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "wiki_pages").select("page_id", "title", "updated_at").where("title is not null").distinct()
    return pages.select("page_id", "title", fn.query_slug("title").alias("slug"), fn.query_file("title", "updated_at").alias("file"))


def safe_paths(spark, sf_dir) -> DataFrame:
    """Paths of the listings, and the same with characters that have to go."""
    paths = table(spark, sf_dir, "file_snapshots").select("path").distinct()
    odd = F.replace("path", F.lit("an"), F.lit("a?n"))
    both = paths.select("path", F.explode(F.array(F.col("path"), odd, F.concat(F.lit("../con."), "path"))).alias("asked")).select("asked").distinct()
    return both.select("asked", fn.safe_relative_path("asked").alias("safe"))


def graph_titles(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fn.graph_title("text", name).alias("title"))


def pages_by_title(spark, sf_dir) -> DataFrame:
    """The first document of every title, letter case ignored."""
    found = graph_titles(spark, sf_dir).select(F.lower("title").alias("title"), "doc_id")
    return found.groupBy("title").agg(F.min("doc_id").alias("doc_id"))


def image_contexts(spark, sf_dir) -> DataFrame:
    """Addresses in documents as images, with what stands around them."""
    shown = F.regexp_replace("text", r"(https?://[^\s()\[\]]+)", r"![a picture]($1)")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(fn.image_contexts(shown)).alias("n", "i"))
    return rows.select("doc_id", "n", "i.alt", "i.url", "i.place", _md5(F.concat("i.before", F.lit("|"), "i.after")).alias("around"))


def trimmed_indexes(spark, sf_dir) -> DataFrame:
    cut = fn.trimmed_index("text", search.TOKENS, 600)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(cut).alias("chars"), _md5(cut).alias("hash"))


def vector_pages(spark, sf_dir) -> DataFrame:
    """Pages of the chunks nearest to a vector."""
    hits = search._near(spark, sf_dir).groupBy("page_id").agg(F.round(F.max("score"), 6).alias("score"))
    return op.pages_by_hit(hits, table(spark, sf_dir, "wiki_pages").select("path")).select("page_id", "path", "score")


def related_pages(spark, sf_dir) -> DataFrame:
    """Out-links as slugs, as file names and as paths."""
    links = graph.nodes(spark, sf_dir).select("id", F.explode("out_links").alias("ref")).where("ref is not null").distinct()
    forms = F.array("ref", F.concat("ref", F.lit(".md")), F.concat(F.lit("wiki/concepts/"), "ref", F.lit(".md")))
    return op.related_pages(links.select("id", F.explode(forms).alias("ref")), table(spark, sf_dir, "wiki_pages"))


def source_files(spark, sf_dir) -> DataFrame:
    """Sources of nodes as they are and by their bare name, and the files of all listings."""
    refs = graph.nodes(spark, sf_dir).select("id", F.explode("sources").alias("ref")).where("ref is not null")
    files = table(spark, sf_dir, "file_snapshots").select("path").distinct()
    some = files.where("path like 'raw/sources/%'").select(F.lit("file").alias("id"), F.explode(F.array("path", F.regexp_replace("path", "^.*/", ""), F.regexp_replace("path", "^raw/sources/", ""))).alias("ref"))
    return op.source_files(refs.unionByName(some), files)


def image_sources(spark, sf_dir) -> DataFrame:
    """Images in the media folder of each raw file, by its slug and by its stem."""
    files = table(spark, sf_dir, "file_snapshots").select("path").where("path like 'raw/sources/%'").distinct()
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]+$", "")
    urls = files.select(F.explode(F.array(F.concat(F.lit("media/"), summary_slug(source_identity("path")), F.lit("/img-1.png")), F.concat(F.lit("/srv/wiki/media/"), stem, F.lit("/img-2.png")))).alias("url"))
    return op.image_sources(urls, files)


def pages_of_sources(spark, sf_dir) -> DataFrame:
    """Documents and pages that belong to the source files which documents name."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("wiki/notes/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    pages = docs.unionByName(table(spark, sf_dir, "wiki_pages").select("path", F.lit(None).cast("string").alias("text")).distinct())
    named = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"([a-z]+\.(?:pdf|md|docx))"), F.lit(1))).alias("name"))
    ids = table(spark, sf_dir, "wiki_pages").where("page_id like 'source-%'").select(F.concat(F.substring("page_id", 1, 9), F.lit(".pdf")).alias("name"))
    return op.pages_of_sources(pages, named.unionByName(ids))


def graph_api(spark, sf_dir) -> DataFrame:
    """Edges between the first 200 concepts whose id or title contains a text."""
    n, edges, _ = graph._graph(spark, sf_dir)
    return op.filtered_graph(n, edges, "An", "concept", 200)[1].select("src", "dst")


def _tasks(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type").isin("click", "view"), "pending").when(F.col("event_type") == "error", "failed").otherwise("processing")
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", "ts", status.alias("status"))


def queue_heads(spark, sf_dir) -> DataFrame:
    """The first pending task of each user."""
    return op.queue_heads(_tasks(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "ts")


def queue_upserts(spark, sf_dir) -> DataFrame:
    """Tasks after requests for every changed file: users' last tasks, and requests by the users of the other half."""
    last = _tasks(spark, sf_dir).groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    path = F.concat(F.lit("Raw/"), F.col("user_id").cast("string"))
    project = (F.col("user_id") % 7).alias("project")
    tasks = last.select(project, path.alias("path"), "status", F.lit(2).alias("retries"), F.lit("old").alias("context"))
    more = table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("user_id")).distinct()
    asked = more.select(project, F.lower(path).alias("path"), F.when(F.col("user_id") % 3 == 0, "new").otherwise("").alias("context"))
    return op.queued(tasks, asked)


QUERIES = {
    f.__name__: f
    for f in (
        document_languages, query_files, safe_paths, graph_titles, pages_by_title, image_contexts, trimmed_indexes, vector_pages, related_pages, source_files, image_sources,
        pages_of_sources, graph_api, queue_heads, queue_upserts,
    )
}

_CODES = "CASE lower(trim(lang, ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fn.LANGUAGE_CODES.items()) + " ELSE trim(lang, ' ') END"
_HTML = {v: k for k, v in fn.LANGUAGE_CODES.items()} | fn.OTHER_CODES
_GRAPH_TITLE = r"""coalesce(nullif(trim(regexp_extract(text, '(?s)\A---\n(?:.*?\n)??title:[ \t]*["'']?([^\r\n]+?)["'']?[ \t]*(?:\r?\n|\z)', 1), ' '), ''), nullif(trim(regexp_extract(text, '(?m)^#[ \t]+([^\r\n]+)', 1), ' '), ''), 'doc ' || doc_id)"""
_HASH36 = "substr(lower(to_base(CASE WHEN q = '' THEN 2166136261 ELSE list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(q, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) END, 36)), 1, 6)"
_RAW_IDENTITY = r"CASE WHEN regexp_matches(lower(path), '(?s)^(.*?/)?raw/sources/') THEN regexp_extract(path, '(?is)^(?:.*?/)?raw/sources/(.*)$', 1) ELSE regexp_replace(path, '^.*/', '') END"
_STATUS = "CASE WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'processing' END"
SQL = {
    "document_languages": f"""WITH a AS (SELECT doc_id, {_CODES} AS language FROM documents)
SELECT doc_id, language, CASE language {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _HTML.items())} END AS html, CASE WHEN language IN ('Arabic', 'Persian', 'Hebrew') THEN 'rtl' ELSE 'ltr' END AS direction,
  CASE {' '.join(f"WHEN language IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in fn.FAMILIES.items())} ELSE 'latin' END AS family FROM a""",
    "query_files": r"""WITH a AS (SELECT DISTINCT page_id, title, updated_at, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(title), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g') AS s FROM wiki_pages WHERE title IS NOT NULL),
b AS (SELECT page_id, title, updated_at, coalesce(nullif(substr(lower(regexp_replace(regexp_replace(s, '-+', '-', 'g'), '^-|-$', '', 'g')), 1, 50), ''), 'query') AS slug FROM a)
SELECT page_id, title, slug, slug || strftime(updated_at, '-%Y-%m-%d-%H%M%S.md') AS file FROM b""",
    "graph_titles": f"SELECT doc_id, {_GRAPH_TITLE} AS title FROM documents WHERE text IS NOT NULL",
    "pages_by_title": f"SELECT lower({_GRAPH_TITLE}) AS title, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "safe_paths": rf"""WITH p AS (SELECT DISTINCT path FROM file_snapshots), a AS (SELECT DISTINCT unnest([path, replace(path, 'an', 'a?n'), '../con.' || path]) AS asked FROM p),
b AS (SELECT asked, replace(asked, '\', '/') AS q, list_filter(string_split(replace(asked, '\', '/'), '/'), lambda s: s NOT IN ('', '.', '..')) AS s FROM a),
c AS (SELECT *, list_transform(list_transform(s, lambda x: coalesce(nullif(trim(regexp_replace(regexp_replace(x, '[<>:"|?*\x00-\x1f]', '_', 'g'), '[. ]+$', ''), ' '), ''), '_')), lambda x: CASE WHEN regexp_matches(x, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)') THEN '_' || x ELSE x END) AS t FROM b),
d AS (SELECT asked, array_to_string(s, '/') AS was, array_to_string(t, '/') AS now, {_HASH36} AS mark FROM c)
SELECT asked, CASE WHEN was = '' THEN '_' WHEN was = now THEN now WHEN regexp_matches(now, '[^/]\.[^./]*$') THEN regexp_replace(now, '(\.[^./]*)$', '-' || mark || '\1') ELSE now || '-' || mark END AS safe FROM d""",
    "image_contexts": r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(https?://[^\s()\[\]]+)', '![a picture](\1)', 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, t, regexp_extract_all(t, '!\[[^\]]*\]\([^)\s]+\)') AS m, regexp_split_to_array(t, '!\[[^\]]*\]\([^)\s]+\)') AS s FROM a),
c AS (SELECT doc_id, t, m, s, unnest(m) AS i, generate_subscripts(m, 1) AS k FROM b),
d AS (SELECT doc_id, t, i, k, (list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS place FROM c)
SELECT doc_id, (k - 1)::INT AS n, regexp_extract(i, '!\[([^\]]*)\]', 1) AS alt, regexp_extract(i, '\]\(([^)]*)\)', 1) AS url, place, md5(substr(t, greatest(place - 150, 0) + 1, place - greatest(place - 150, 0)) || '|' || substr(t, place + length(i) + 1, 150)) AS around FROM d""",
    "trimmed_indexes": f"""WITH a AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda s: starts_with(s, '##') OR {' OR '.join(f"contains(lower(s), '{t}')" for t in search.TOKENS)}) AS r FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, list_reduce(r, lambda s, x: CASE WHEN s.n + length(x) + 1 <= 600 THEN {{'n': s.n + length(x) + 1, 'k': list_append(s.k, x)}} ELSE s END, {{'n': 0::BIGINT, 'k': []::VARCHAR[]}}).k AS k FROM a),
c AS (SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN length(array_to_string(k, chr(10))) < length(text) THEN array_to_string(k, chr(10)) || chr(10) || chr(10) || '[...index trimmed...]' ELSE array_to_string(k, chr(10)) END AS t FROM b)
SELECT doc_id, length(t)::INT AS chars, md5(t) AS hash FROM c""",
    "vector_pages": f"WITH {search._NEAR_SQL}, p AS (SELECT path, lower(regexp_replace(regexp_replace(path, '^wiki/', ''), '\\.md$', '')) AS rel FROM wiki_pages), k AS (SELECT key, min(path) AS path FROM (SELECT regexp_replace(rel, '^.*/', '') AS key, path FROM p UNION ALL SELECT rel, path FROM p) GROUP BY key) SELECT page_id, path, round(max(score), 6) AS score FROM n JOIN k ON k.key = lower(page_id) GROUP BY page_id, path",
    "related_pages": graph._BASE + """, f AS (SELECT DISTINCT id, unnest([x, x || '.md', 'wiki/concepts/' || x || '.md']) AS ref FROM (SELECT id, unnest(out_links) AS x FROM n) WHERE x IS NOT NULL),
p AS (SELECT path, regexp_replace(path, '^.*/', '') AS name FROM wiki_pages WHERE path LIKE 'wiki/%')
SELECT id, ref, CASE WHEN contains(ref, '/') THEN (SELECT min(path) FROM p WHERE p.path = ref) ELSE (SELECT min(path) FROM p WHERE p.name = CASE WHEN ref LIKE '%.md' THEN ref ELSE ref || '.md' END) END AS path FROM f""",
    "source_files": graph._BASE + r""", x AS (SELECT DISTINCT path, regexp_replace(path, '^.*/', '') AS name FROM file_snapshots),
f AS (SELECT id, ref FROM (SELECT id, unnest(sources) AS ref FROM n) WHERE ref IS NOT NULL UNION SELECT 'file', unnest([path, name, regexp_replace(path, '^raw/sources/', '')]) FROM x WHERE path LIKE 'raw/sources/%'),
g AS (SELECT id, ref, regexp_replace(replace(ref, '\', '/'), '^/+', '') AS r FROM f)
SELECT id, ref, CASE WHEN contains(ref, '/') AND regexp_matches(r, '^(raw/sources|wiki)/') THEN (SELECT min(path) FROM x WHERE path = r)
  WHEN contains(ref, '/') THEN coalesce((SELECT min(path) FROM x WHERE path = 'raw/sources/' || r), (SELECT min(path) FROM x WHERE path = r))
  WHEN ref LIKE '%.md' THEN coalesce((SELECT min(path) FROM x WHERE name = ref AND path LIKE 'wiki/sources/%'), (SELECT min(path) FROM x WHERE name = ref AND path LIKE 'raw/sources/%'))
  ELSE (SELECT min(path) FROM x WHERE name = ref AND path LIKE 'raw/sources/%') END AS path FROM g""",
    "pages_of_sources": rf"""WITH d AS (SELECT 'wiki/notes/doc-' || doc_id || '.md' AS path, lower(text) AS t, doc_id FROM documents), w AS (SELECT DISTINCT path, regexp_replace(lower(path), '^.*/', '') AS file FROM wiki_pages WHERE path IS NOT NULL),
s AS (SELECT DISTINCT lower(name) AS name FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+\.(?:pdf|md|docx)')) AS name FROM documents UNION ALL SELECT substr(page_id, 1, 9) || '.pdf' FROM wiki_pages WHERE page_id LIKE 'source-%')),
f AS (SELECT path, doc_id, unnest(string_split({text._list_sql('sources').replace('regexp_extract(f,', f"regexp_extract({text._front_sql('t')},")}, '|')) AS m FROM d)
SELECT name, path, 'quoted' AS how FROM s JOIN d ON contains(t, chr(34) || name || chr(34)) OR contains(t, '''' || name || '''')
UNION SELECT name, path, 'listed' FROM s JOIN f ON regexp_replace(replace(m, '\', '/'), '^.*/', '') = name
UNION SELECT name, path, 'summary' FROM s JOIN w ON regexp_matches(path, '(^|/)sources/') AND starts_with(file, regexp_replace(name, '\.[^.]*$', '')) AND file NOT IN ('index.md', 'log.md', 'overview.md')""",
    "graph_api": graph._BASE + ", c AS (SELECT id FROM n WHERE type = 'concept' AND (contains(lower(id), 'an') OR contains(lower(title), 'an')) ORDER BY id LIMIT 200) SELECT src, dst FROM e WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)",
    "queue_heads": f"SELECT user_id, event_id, ts FROM events WHERE {_STATUS} = 'pending' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "queue_upserts": f"""WITH t AS (SELECT user_id % 7 AS project, 'Raw/' || user_id AS path, arg_max({_STATUS}, (ts, event_id)) AS status, user_id FROM events GROUP BY user_id),
a AS (SELECT DISTINCT (user_id * 2) % 7 AS project, 'raw/' || user_id * 2 AS path, CASE WHEN (user_id * 2) % 3 = 0 THEN 'new' ELSE '' END AS context, user_id * 2 AS u FROM events)
SELECT t.project, CASE WHEN w THEN a.path ELSE t.path END AS path, CASE WHEN w THEN 'pending' ELSE status END AS status, CASE WHEN w THEN 0 ELSE 2 END AS retries, CASE WHEN w AND context = 'new' THEN 'new' ELSE 'old' END AS context
FROM (SELECT t.*, a.u IS NOT NULL AND status IN ('pending', 'failed') AS w FROM t LEFT JOIN a ON a.u = t.user_id) t LEFT JOIN a ON a.u = t.user_id
UNION ALL SELECT project, path, 'pending', 0, context FROM a WHERE u NOT IN (SELECT user_id FROM t WHERE status IN ('pending', 'failed'))""",
}
