"""Parsing queries over documents, bodies, titles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions import language
from loreweave.functions import text as fn
from loreweave.storage import table

_FRONT = r"^---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|$)"


def _front_sql(text: str) -> str:
    return f"regexp_extract({text}, '{_FRONT}', 1)"


def frontmatter_fields(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", fn.frontmatter("text").alias("front"), "text").where("front <> ''")
    lists = {n: F.array_join(fn.list_field(F.col("front"), n), "|") for n in ("tags", "sources")}
    return rows.select("doc_id", fn.scalar_field(F.col("front"), "title").alias("title"), F.lower(fn.scalar_field(F.col("front"), "type")).alias("type"), *[c.alias(n) for n, c in lists.items()])


def stripped_bodies(spark, sf_dir) -> DataFrame:
    body = fn.strip_frontmatter("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(body).cast("bigint").alias("chars"), F.md5(body.cast("binary")).alias("hash"))


def wikilinks(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "page_bodies").select("item_id", "text").distinct()
    return rows.select("item_id", F.explode(fn.wikilinks("text")).alias("target")).groupBy("item_id", "target").agg(F.count("*").alias("n"))


def image_refs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "page_bodies").select("item_id", "text").distinct()
    return rows.select("item_id", F.explode(fn.image_urls("text")).alias("url"))


def headings(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "page_bodies").select("item_id", "text").distinct()
    return rows.select("item_id", F.explode(fn.headings("text")).alias("heading")).groupBy("item_id", "heading").agg(F.count("*").alias("n"))


def ref_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "wiki_pages").select("page_id", "title").distinct().select("page_id", "title", fn.ref_key("title").alias("key"), fn.valid_page_id("page_id").alias("valid"))


def review_keys(spark, sf_dir) -> DataFrame:
    """Review documents by kind and key of their first line."""
    first = F.regexp_extract("text", r"^REVIEW ([a-z-]+) \| ([^\r\n]*)", 2)
    kind = F.regexp_extract("text", r"^REVIEW ([a-z-]+) \| ([^\r\n]*)", 1)
    return table(spark, sf_dir, "documents").where("text like 'REVIEW %'").select("doc_id", kind.alias("kind"), fn.review_key(first).alias("key"))


def source_identities(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "retrieval_nodes").select("page_id", F.explode("sources").alias("raw")).where("raw is not null").distinct()
    return raw.select("page_id", "raw", fn.source_identity("raw").alias("identity"), fn.source_identity("raw", keep_unmatched=True).alias("reference"))


def file_categories(spark, sf_dir) -> DataFrame:
    files = table(spark, sf_dir, "file_snapshots").distinct()
    kinds = files.select(fn.file_category("path").alias("category"), fn.ingestable("path").alias("ingestable"), "size")
    return kinds.groupBy("category", "ingestable").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def source_sizes(spark, sf_dir) -> DataFrame:
    """Files of all listings with readable sizes."""
    files = table(spark, sf_dir, "file_snapshots").select("snapshot_no", "project_id", "path", "size").distinct()
    return files.select("snapshot_no", "project_id", "path", "size", fn.format_bytes("size").alias("shown"))


def types_from_path(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "wiki_pages").select("page_id", "path").distinct().select("page_id", fn.type_from_path("path").alias("type"), fn.safe_page_path("path").alias("safe"))


def watched_files(spark, sf_dir) -> DataFrame:
    p = F.col("path")
    seen = fn.watched(p, ("archive", "raw/sources/assets"), ("*draft*", "a?*.html"), ("png",))
    return table(spark, sf_dir, "file_snapshots").select("path").distinct().select("path", seen.alias("watched"), fn.glob_match(p, "raw/*.m?").alias("markdown"))


def clip_slugs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "wiki_pages").select("page_id", "title").where("title is not null").distinct().select("page_id", fn.clip_slug("title").alias("slug"))


def clip_hosts(spark, sf_dir) -> DataFrame:
    """Hosts of the addresses in the second line of clips."""
    url = F.regexp_extract("text", r"(https?://[^\s]+)", 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", url.alias("url")).where("url <> ''")
    return rows.groupBy(fn.hostname("url").alias("host")).agg(F.count("*").alias("clips"))


def detect_languages(spark, sf_dir) -> DataFrame:
    return language.with_language(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "language")


def script_histogram(spark, sf_dir) -> DataFrame:
    counts = language.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.sum(counts[n]).alias(n.lower()) for n in language.SCRIPTS])


def language_guard(spark, sf_dir) -> DataFrame:
    """Documents that don't fit English, and those that don't fit Japanese."""
    samples = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", language.guarded_sample(F.col("text")).alias("sample"))
    rows = language.with_language(samples, "sample")
    fits = [language.language_matches(F.col("sample"), F.col("language"), t).alias(t.lower()) for t in ("English", "Japanese", "Thai")]
    return rows.select("doc_id", *fits)


def greetings(spark, sf_dir) -> DataFrame:
    """Chat turns that only greet, per document."""
    turns = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?md)^user: ([^\r\n]*)"), F.lit(1))).alias("turn"))
    return turns.groupBy("doc_id").agg(F.count("*").alias("turns"), F.sum(fn.is_greeting("turn").cast("int")).alias("greetings"))


def context_budgets(spark, sf_dir) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").where("n_chars is not null").select(F.col("n_chars").alias("size")).distinct()
    return sizes.select("size", *[c.alias(n) for n, c in fn.context_budget("size").items()])


QUERIES = {
    f.__name__: f
    for f in (
        frontmatter_fields, stripped_bodies, wikilinks, image_refs, headings, ref_keys, review_keys, source_identities, file_categories, source_sizes, types_from_path,
        watched_files, clip_slugs, clip_hosts, detect_languages, script_histogram, language_guard, greetings, context_budgets,
    )
}

_KEY = r"regexp_replace(regexp_replace(lower(regexp_replace(replace(trim({}, ' '), '\', '/'), '^.*/', '')), '\.md$', ''), '[\s_-]+', '', 'g')"


def _scalar_sql(name: str) -> str:
    return f"nullif(regexp_replace(trim(regexp_extract(f, '(?m)^{name}:[ \\t]*([^\\r\\n]*)', 1), ' '), '^[\"'']|[\"'']$', '', 'g'), '')"


def _list_sql(name: str) -> str:
    inline = f"string_split(regexp_extract(f, '(?m)^{name}:[ \\t]*\\[([^\\]]*)\\]', 1), ',')"
    block = f"regexp_extract(f, '(?m)^{name}:[ \\t]*\\r?\\n((?:[ \\t]*-[ \\t]+[^\\n]*\\n?)+)', 1)"
    items = f"CASE WHEN {block} <> '' THEN regexp_extract_all({block}, '(?m)^[ \\t]*-[ \\t]+([^\\r\\n]+)', 1) ELSE {inline} END"
    return f"array_to_string(list_filter(list_transform({items}, lambda x: regexp_replace(trim(x, ' '), '^[\"'']|[\"'']$', '', 'g')), lambda x: x <> ''), '|')"


def _category_sql(path: str) -> str:
    ext = f"lower(list_last(string_split({path}, '.')))"
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr(x) for x in names.split())}) THEN '{c}'" for c, names in fn.CATEGORIES.items()) + " ELSE 'unknown' END"


_IDENTITY = r"CASE WHEN regexp_matches(lower(replace(raw, '\', '/')), '(?s)^(.*?/)?raw/sources/') THEN regexp_extract(replace(raw, '\', '/'), '(?is)^(?:.*?/)?raw/sources/(.*)$', 1) ELSE {} END"
_SLASHED = r"replace(raw, '\', '/')"
_NAME = rf"regexp_replace({_SLASHED}, '^.*/', '')"
_TYPES = "CASE " + " ".join(f"WHEN contains(p, '/{d}/') THEN '{t}'" for d, t in fn.TYPE_DIRS.items()) + r" WHEN regexp_matches(p, '(^|/)overview\.md$') THEN 'overview' END"
_BAD = r"(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"


def _count_sql(name: str) -> str:
    return f"len(regexp_extract_all(text, '{language.script_class(name)}'))"


def _language_sql(source: str = "documents") -> str:
    counts = ", ".join(f"{_count_sql(n)} AS {n}" for n in language.SCRIPTS)
    rules = []
    for name, letters, words in language.LATIN:
        parts = [f"regexp_matches(lower(text), '{p}')" for p in (f"[{letters}]" if letters else "", language.word_pattern(words) if words else "") if p]
        rules.append(f"WHEN {' AND '.join(parts)} THEN '{name}'")
    sp = "(' ' || regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ')"
    words_of = lambda words: " + ".join(f"2 * contains({sp}, ' {w} ')::INT" for w in words.split("|"))
    persian = f"(3 * len(regexp_extract_all(text, '[{language.PERSIAN[0]}]')) + len(regexp_extract_all(text, '[{language.PERSIAN[1]}]')) + {words_of(language.PERSIAN[2])})"
    arabic = f"(len(regexp_extract_all(text, '[{language.ARABIC[0]}]')) + {words_of(language.ARABIC[1])})"
    scripts = []
    for n in language.SCRIPTS:
        shown = f"CASE WHEN {persian} >= 3 AND {persian} > {arabic} THEN 'Persian' ELSE 'Arabic' END" if n == "Arabic" else f"'{n}'"
        scripts.append(f"WHEN m >= 2 AND {n} = m THEN {shown}")
    most = f"greatest({', '.join(language.SCRIPTS)})"
    return f"""WITH c AS (SELECT doc_id, text, {counts} FROM {source}), k AS (SELECT *, {most} AS m FROM c),
g AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL WHEN Japanese > 0 AND Chinese > 0 THEN 'Japanese' {' '.join(scripts)} {' '.join(rules)} ELSE 'English' END AS language FROM k)
"""


_SAMPLES = r"""(SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\A.{3}.*?\n---\n', ''), '(?s)```.*?```', '', 'g'), '(?s)\$\$.*?\$\$', '', 'g'), '\$[^$\n]*\$', '', 'g'), 1, 1500) AS text FROM documents WHERE text IS NOT NULL)"""
_GREET = "^(" + "|".join(f"({g})" for g in fn.GREETINGS) + ")$"
_BODIES = "SELECT DISTINCT item_id, text FROM page_bodies"
SQL = {
    "frontmatter_fields": f"WITH a AS (SELECT doc_id, {_front_sql('text')} AS f FROM documents) SELECT doc_id, {_scalar_sql('title')} AS title, lower({_scalar_sql('type')}) AS type, {_list_sql('tags')} AS tags, {_list_sql('sources')} AS sources FROM a WHERE f <> ''",
    "stripped_bodies": f"SELECT doc_id, length(regexp_replace(text, '{_FRONT}', '')) AS chars, md5(regexp_replace(text, '{_FRONT}', '')) AS hash FROM documents WHERE text IS NOT NULL",
    "wikilinks": rf"SELECT item_id, target, count(*) AS n FROM (SELECT item_id, trim(unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)), ' ') AS target FROM ({_BODIES})) GROUP BY ALL",
    "image_refs": rf"SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)\)', 1)) AS url FROM ({_BODIES})",
    "headings": rf"SELECT item_id, heading, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '(?m)^(#{{1,6}} [^\r\n]+)', 1)) AS heading FROM ({_BODIES})) GROUP BY ALL",
    "ref_keys": f"SELECT DISTINCT page_id, title, {_KEY.format('title')} AS key, regexp_matches(page_id, '^[\\p{{L}}\\p{{N}}._-]{{1,256}}$') AS valid FROM wiki_pages",
    "review_keys": rf"SELECT doc_id, regexp_extract(text, '^REVIEW ([a-z-]+) \| ([^\r\n]*)', 1) AS kind, trim(regexp_replace(regexp_replace(lower(regexp_extract(text, '^REVIEW ([a-z-]+) \| ([^\r\n]*)', 2)), '^({'|'.join(fn.REVIEW_PREFIXES)})[:：]\s*', ''), '\s+', ' ', 'g'), ' ') AS key FROM documents WHERE text LIKE 'REVIEW %'",
    "source_identities": f"SELECT DISTINCT page_id, raw, {_IDENTITY.format(_NAME)} AS identity, {_IDENTITY.format(_SLASHED)} AS reference FROM (SELECT page_id, unnest(sources) AS raw FROM retrieval_nodes) WHERE raw IS NOT NULL",
    "file_categories": rf"SELECT {_category_sql('path')} AS category, lower(list_last(string_split(replace(path, '\', '/'), '.'))) IN ({', '.join(repr(x) for x in fn.INGESTABLE)}) AND NOT regexp_matches(replace(path, '\', '/'), '(^|/)\.[^/]*$') AND NOT regexp_matches(replace(path, '\', '/'), '(^|/)\.cache/') AS ingestable, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM file_snapshots) GROUP BY ALL",
    "source_sizes": "SELECT DISTINCT snapshot_no, project_id, path, size, CASE WHEN size >= 1024 ** 3 THEN printf('%.1f', round(size / 1024 ** 3, 1)) || ' GB' WHEN size >= 1024 ** 2 THEN printf('%.1f', round(size / 1024 ** 2, 1)) || ' MB' WHEN size >= 1024 THEN printf('%.1f', round(size / 1024.0, 1)) || ' KB' ELSE size || ' B' END AS shown FROM file_snapshots",
    "types_from_path": rf"WITH a AS (SELECT DISTINCT page_id, replace(path, '\', '/') AS q, lower(replace(path, '\', '/')) AS p FROM wiki_pages) SELECT page_id, {_TYPES} AS type, coalesce(regexp_matches(q, '^wiki/') AND NOT regexp_matches(q, '//|/$|[ .](/|$)|(^|/)\.') AND NOT regexp_matches(p, '{_BAD}') AND NOT regexp_matches(q, '[\x00-\x1f:*?\"<>|]'), false) AS safe FROM a",
    "watched_files": rf"""WITH a AS (SELECT DISTINCT path, replace(path, '\', '/') AS q, lower(replace(path, '\', '/')) AS p, regexp_replace(lower(replace(path, '\', '/')), '^.*/', '') AS n FROM file_snapshots)
SELECT path, p <> '' AND NOT contains('/' || p, '/.store/') AND NOT starts_with(p, 'wiki/media/') AND NOT p LIKE '%.ds_store' AND n NOT IN ('thumbs.db', 'desktop.ini')
  AND NOT list_contains(string_split(p, '/'), 'archive') AND NOT contains('/' || p, '/raw/sources/assets/') AND NOT regexp_matches(p, '(?s)^.*draft.*$') AND NOT regexp_matches(n, '^.*draft.*$')
  AND NOT regexp_matches(p, '(?s)^a..*\.html$') AND NOT regexp_matches(n, '^a..*\.html$')
  AND (CASE WHEN starts_with(q, 'raw/sources/') THEN n NOT LIKE '%.png' ELSE q IN ('purpose.md', 'schema.md') OR (starts_with(q, 'wiki/') AND q LIKE '%.md') END) AS watched, regexp_matches(lower(path), '(?s)^raw/.*\.m.$') AS markdown FROM a""",
    "clip_slugs": r"SELECT DISTINCT page_id, substr(regexp_replace(regexp_replace(lower(trim(title, ' ')), '[^\p{L}\p{N}\s-]', '', 'g'), '[\s-]+', '-', 'g'), 1, 50) AS slug FROM (SELECT DISTINCT page_id, title FROM wiki_pages WHERE title IS NOT NULL)",
    "clip_hosts": r"SELECT regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, count(*) AS clips FROM (SELECT regexp_extract(text, '(https?://[^\s]+)', 1) AS u FROM documents) WHERE u <> '' GROUP BY 1",
    "detect_languages": _language_sql() + "SELECT doc_id, language FROM g",
    "script_histogram": "SELECT lang, " + ", ".join(f"sum({_count_sql(n)})::BIGINT AS {n.lower()}" for n in language.SCRIPTS) + " FROM documents GROUP BY lang",
    "language_guard": _language_sql(_SAMPLES) + """SELECT doc_id, length(trim(text, ' ')) < 20 OR language NOT IN ('Chinese', 'Traditional Chinese', 'Japanese', 'Korean', 'Arabic', 'Persian', 'Hindi', 'Thai', 'Hebrew') AS english,
  length(trim(text, ' ')) < 20 OR language IN ('Chinese', 'Traditional Chinese', 'Japanese', 'Korean') AS japanese, length(trim(text, ' ')) < 20 OR language = 'Thai' AS thai FROM g""",
    "greetings": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^user: ([^\r\n]*)', 1)) AS t FROM documents),
c AS (SELECT doc_id, lower(trim(regexp_replace(trim(t, ' '), '[\s!！。.?？~，,、;；:：]+$', ''), ' ')) AS t FROM t)
SELECT doc_id, count(*) AS turns, sum((length(t) <= 20 AND regexp_matches(t, '{_GREET.replace(chr(39), chr(39) * 2)}'))::INT)::BIGINT AS greetings FROM c GROUP BY doc_id""",
    "context_budgets": "WITH a AS (SELECT DISTINCT n_chars AS size FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT size, (CASE WHEN size > 0 THEN size ELSE 204800 END)::BIGINT AS w FROM a) SELECT size, w AS max_ctx, floor(w * 0.15)::BIGINT AS response_reserve, floor(w * 0.05)::BIGINT AS index_budget, floor(w * 0.5)::BIGINT AS page_budget, least(floor(w * 0.5), greatest(5000, floor(floor(w * 0.5) * 0.3)))::BIGINT AS max_page_size FROM b",
}
