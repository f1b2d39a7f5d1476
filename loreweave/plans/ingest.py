"""Queries over what a model answers: the tables' texts in the marked forms that a model is asked for, parsed, repaired and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import ingest as fn
from loreweave.functions.text import frontmatter, list_field, source_identity
from loreweave.plans import graph, text
from loreweave.storage import table


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def file_blocks(spark, sf_dir) -> DataFrame:
    """Each body as a file block, behind it one with a path outside the wiki."""
    rows = table(spark, sf_dir, "page_bodies").select("item_id", "page_id", "text").where("text is not null").distinct()
    stream = F.concat(F.lit("Here you are\n---FILE: wiki/notes/"), "page_id", F.lit(".md ---\n"), "text", F.lit("\n--- end file ---\n---FILE: ../notes.md---\nx\n---END FILE---\n"))
    found = rows.select("item_id", F.posexplode(fn.file_blocks(stream)).alias("place", "b"))
    return found.select("item_id", "place", "b.path", "b.verdict", _md5(F.col("b.content")).alias("hash"))


def _reviews(spark, sf_dir, head: str, end: str) -> DataFrame:
    """Review documents in the form of marked blocks."""
    rows = table(spark, sf_dir, "documents").where("text like 'REVIEW %'").select("doc_id", "text")
    return rows.select("doc_id", F.concat(F.regexp_replace("text", r"^REVIEW ([a-z-]+) \| ([^\r\n]*)\r?\n", head), F.lit(end)).alias("answer"))


def review_blocks(spark, sf_dir) -> DataFrame:
    rows = _reviews(spark, sf_dir, "---REVIEW: $1 | $2 ---\n", "\nSEARCH: a | | b c\n---END REVIEW---")
    found = rows.select("doc_id", F.explode(fn.review_blocks("answer")).alias("b"))
    lists = [F.array_join(f"b.{n}", "|").alias(n) for n in ("options", "pages", "searches")]
    return found.select("doc_id", "b.kind", "b.title", _md5(F.col("b.description")).alias("description"), *lists)


def lint_blocks(spark, sf_dir) -> DataFrame:
    rows = _reviews(spark, sf_dir, "---LINT: $1 | Warning | $2 ---\n", "\n---END LINT---")
    found = rows.select("doc_id", F.explode(fn.lint_blocks("answer")).alias("b"))
    return found.select("doc_id", "b.severity", "b.title", _md5(F.col("b.detail")).alias("detail"), F.array_join("b.pages", "|").alias("pages"))


def _wiki(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text like '---%'").select("doc_id", "project_id", "created_at", "text")


def sanitised_pages(spark, sf_dir) -> DataFrame:
    """Pages with a fence around them, a key before them, or bare links in their lists, made sound again."""
    bare = F.regexp_replace("text", r"tags: \[([a-z]+), ([a-z]+)\]", r"tags: [[$1]], [[$2]]")
    spoilt = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```yaml\n"), bare, F.lit("\n```\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("frontmatter:\n"), bare)).otherwise(bare)
    return _wiki(spark, sf_dir).select("doc_id", _md5(fn.sanitised(spoilt)).alias("hash"))


def located_frontmatter(spark, sf_dir) -> DataFrame:
    """Pages behind some lines, or in a fence."""
    n = F.col("doc_id") % 4
    moved = F.when(n == 0, F.col("text")).when(n == 1, F.concat(F.lit("Sure:\n\n"), "text")).when(n == 2, F.concat(F.lit("```yaml\n"), "text")).otherwise(F.concat(F.lit("1\n2\n3\n4\n5\n6\n"), "text"))
    found = _wiki(spark, sf_dir).select("doc_id", fn.located_frontmatter(moved).alias("f"))
    return found.select("doc_id", "f.place", _md5(F.col("f.front")).alias("front"), _md5(F.col("f.body")).alias("body"))


def written_fields(spark, sf_dir) -> DataFrame:
    """Pages with a tag added and a field that they lack."""
    tags = F.concat(list_field(frontmatter("text"), "tags"), F.array(F.lit('a "b"')))
    rows = _wiki(spark, sf_dir).withColumn("text", fn.write_list("text", "tags", tags)).withColumn("text", fn.write_list("text", "related", F.array("project_id")))
    return rows.select("doc_id", _md5(F.col("text")).alias("hash"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Each page with the one before it in its project as the stored page."""
    order = Window.partitionBy("project_id").orderBy("created_at", "doc_id")
    return _wiki(spark, sf_dir).select("doc_id", F.col("text").alias("new"), F.lag("text").over(order).alias("old"))


def united_fields(spark, sf_dir) -> DataFrame:
    return fn.unite_fields(_pairs(spark, sf_dir).where("old is not null"), "new", "old").select("doc_id", _md5(F.col("new")).alias("hash"))


def page_merges(spark, sf_dir) -> DataFrame:
    """Pages merged into the one before them, by a model that appends the new page to the stored one, or loses its body for one document in three."""
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: other\ntype: query\n---\n"), F.substring("new", 1, 20))).otherwise(F.concat(F.lit("---\ntitle: other\ntype: query\n---\n"), "old", "new"))
    merged = fn.merge_pages(_pairs(spark, sf_dir).withColumn("answer", answer), "new", "old", "answer", "2026-01-01", "page")
    front = frontmatter("page")
    fields = [F.regexp_extract(front, rf"(?md)^{n}:[ \t]*([^\r\n]*)", 1).alias(n) for n in ("title", "type", "updated")]
    return merged.select("doc_id", *fields, F.size(list_field(front, "tags")).alias("tags"), (F.length("page") > F.length("new")).alias("grown"))


def write_routes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "file_snapshots").select(F.regexp_replace("path", r"^\./", "").alias("path")).distinct().select("path", fn.write_route("path").alias("route"))


def canonical_sources(spark, sf_dir) -> DataFrame:
    """Sources of each node with its first one in canonical spelling."""
    n = graph.nodes(spark, sf_dir).where("size(sources) > 0 and sources[0] is not null")
    identity = source_identity(F.lower(F.element_at("sources", 1)), keep_unmatched=True)
    return n.select("id", F.array_join(fn.canonical_sources(F.col("sources"), identity), "|").alias("sources"))


def duplicate_answers(spark, sf_dir) -> DataFrame:
    """What a model that names pages of one title as duplicates answers, with words and a fence around it."""
    pages = table(spark, sf_dir, "wiki_pages").where("title is not null").groupBy("title").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    group = F.struct(F.array("a", "b").alias("slugs"), F.lit('same "title" {').alias("reason"), F.when(F.length("title") % 2 == 0, "high").otherwise("sure").alias("confidence"))
    answer = F.concat(F.lit("Sure!\n```json\n"), F.to_json(F.struct(F.array(group).alias("groups"))), F.lit("\n```\nAnything else? {no}"))
    found = pages.select("title", F.explode(fn.duplicate_answer(answer)).alias("g"))
    return found.select("title", F.array_join("g.slugs", "|").alias("slugs"), "g.reason", "g.confidence")


def reasoning_chars(spark, sf_dir) -> DataFrame:
    """Lengths of chat turns as the reasoning of a stream; quotes in them are escaped."""
    turns = F.transform(F.regexp_extract_all("text", F.lit(r"(?md)^assistant: ([^\r\n]*)"), F.lit(1)), lambda x: F.regexp_replace(x, r'(["\\])', r"\\$1"))
    lines = F.array_join(F.transform(turns, lambda x: F.concat(F.lit('data: {"reasoning_content": "'), x, F.lit('"}'))), "\n")
    rows = table(spark, sf_dir, "documents").where("source = 'chat' and text is not null")
    return rows.select("doc_id", fn.reasoning_chars(lines).alias("chars"))


def linked_terms(spark, sf_dir) -> DataFrame:
    """Pages with links on the first mention of titles' first words: one word links to the least page whose title starts with it."""
    first = F.regexp_extract("title", r"^([A-Z][a-z]{4,})", 1)
    names = table(spark, sf_dir, "wiki_pages").select("page_id", first.alias("term")).where("term <> ''").groupBy("term").agg(F.min("page_id").alias("target"))
    pages = _wiki(spark, sf_dir)
    words = pages.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{4,})"), F.lit(1)))).alias("term")).join(names, "term")
    links = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "target"))).alias("links"))
    made = pages.join(links, "doc_id").select("doc_id", F.size("links").alias("links"), fn.linked_terms("text", F.col("links")).alias("page"))
    return made.select("doc_id", "links", F.size(F.regexp_extract_all("page", F.lit(r"(\[\[)"), F.lit(1))).alias("made"), _md5(F.col("page")).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        file_blocks, review_blocks, lint_blocks, sanitised_pages, located_frontmatter, written_fields, united_fields, page_merges, write_routes, canonical_sources,
        duplicate_answers, reasoning_chars, linked_terms,
    )
}

_WIKI = "w AS (SELECT doc_id, project_id, created_at, text FROM documents WHERE text LIKE '---%')"
_SAFE = r"""(regexp_matches(q, '^wiki/') AND NOT regexp_matches(q, '//|/$|[ .](/|$)|(^|/)\.') AND NOT regexp_matches(q, '[\x00-\x1f<>:"|?*]')
  AND NOT regexp_matches(q, '(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)'))"""


def _first_only(text: str, name: str) -> str:
    return rf"regexp_replace({text}, '(?s)\A((?:.*?\n)??){name}:[^\r\n]*', '\1')"


def _reviews_sql(head: str, end: str) -> str:
    return rf"a AS (SELECT doc_id, regexp_replace(text, '^REVIEW ([a-z-]+) \| ([^\r\n]*)\r?\n', '{head}' || chr(10)) || chr(10) || '{end}' AS t FROM documents WHERE text LIKE 'REVIEW %')"


def _trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '\A\s+|\s+\z', '', 'g')"


def _lists_sql(text_sql: str, name: str) -> str:
    return f"string_split({text._list_sql(name).replace('regexp_extract(f,', f'regexp_extract({text_sql},')}, '|')"


_FRONT_RE = r"(?s)\A(---\r?\n)(.*?)(\r?\n---.*)\z"


def _write_sql(page: str, name: str, values: str) -> str:
    front = f"regexp_extract({page}, '{_FRONT_RE}', 2)"
    line = f"'{name}: [' || array_to_string(list_transform({values}, lambda v: '\"' || replace(v, '\"', '\\\"') || '\"'), ', ') || ']'"
    inline, dashed = rf"(?m)^{name}:[ \t]*\[[^\]]*\]", rf"(?m)^{name}:[ \t]*\n(?:[ \t]+-[ \t]+[^\n]+\n?)+"
    put = lambda field: f"replace({front}, regexp_extract({front}, '{field}'), {line})"
    made = f"CASE WHEN regexp_matches({front}, '{inline}') THEN {put(inline)} WHEN regexp_matches({front}, '{dashed}') THEN {put(dashed)} ELSE {front} || chr(10) || {line} END"
    return f"CASE WHEN regexp_matches({page}, '{_FRONT_RE}') THEN regexp_extract({page}, '{_FRONT_RE}', 1) || {made} || regexp_extract({page}, '{_FRONT_RE}', 3) ELSE {page} END"


_UNITE = "list_transform(list_distinct(list_transform({0} || {1}, lambda s: lower(s))), lambda k: ({0} || {1})[list_position(list_transform({0} || {1}, lambda s: lower(s)), k)])"


def _field_values(page: str, name: str) -> str:
    return f"coalesce(list_filter(string_split({text._list_sql(name)}, '|'), lambda s: s <> ''), [])".replace("regexp_extract(f,", f"regexp_extract({text._front_sql(page)},")


def _step_sql(source: str, page: str, old: str, name: str, as_: str) -> str:
    """One CTE that unites one field: the old page's members first, in their order."""
    return f"""{as_} AS (SELECT * EXCLUDE ({page}), CASE WHEN len(o) > 0 AND m <> n THEN {_write_sql(page, name, 'm')} ELSE {page} END AS {page}
FROM (SELECT *, list_transform(list_filter(list_zip(o || n, range(1, len(o || n) + 1)), lambda z: list_position(list_transform(o || n, lambda s: lower(s)), lower(z[1])) = z[2]), lambda z: z[1]) AS m
  FROM (SELECT *, {_field_values(old, name)} AS o, {_field_values(page, name)} AS n FROM (SELECT * FROM {source})))
)"""


SQL = {
    "file_blocks": rf"""WITH a AS (SELECT DISTINCT item_id, replace('Here you are' || chr(10) || '---FILE: wiki/notes/' || page_id || '.md ---' || chr(10) || text || chr(10) || '--- end file ---' || chr(10) || '---FILE: ../notes.md---' || chr(10) || 'x' || chr(10) || '---END FILE---' || chr(10), chr(13) || chr(10), chr(10)) AS t FROM page_bodies WHERE text IS NOT NULL),
l AS (SELECT item_id, t, string_split(t, chr(10)) AS ls FROM a),
k AS (SELECT item_id, t, ls, list_transform(ls, lambda s: {{'run': regexp_extract(s, '^\s{{0,3}}(```+|~~~+)', 1), 'shut': regexp_matches(s, '(?i)^---\s*END\s+FILE\s*---\s*$'), 'open': CASE WHEN regexp_matches(s, '(?i)^---\s*FILE:\s*(.+?)\s*---\s*$') THEN trim(regexp_extract(s, '(?i)^---\s*FILE:\s*(.+?)\s*---\s*$', 1), ' ') END}}) AS m FROM l),
f AS (SELECT item_id, ls, list_reduce(list_transform(range(0, len(ls)), lambda i: {{'i': i, 'x': m[i + 1]}}), lambda s, e:
    CASE WHEN s.path IS NULL THEN CASE WHEN e.x.open IS NOT NULL THEN {{'path': e.x.open, 'at': e.i + 1, 'fence': '', 'width': 0::BIGINT, 'out': s.out}} ELSE s END
    WHEN e.x.run <> '' THEN CASE WHEN s.fence = '' THEN {{'path': s.path, 'at': s.at, 'fence': e.x.run[1], 'width': length(e.x.run), 'out': s.out}}
      WHEN s.fence = e.x.run[1] AND length(e.x.run) >= s.width THEN {{'path': s.path, 'at': s.at, 'fence': '', 'width': 0::BIGINT, 'out': s.out}} ELSE s END
    WHEN e.x.shut AND s.fence = '' THEN {{'path': NULL::VARCHAR, 'at': 0::BIGINT, 'fence': '', 'width': 0::BIGINT, 'out': list_append(s.out, {{'path': s.path, 'a': s.at, 'b': e.i}})}} ELSE s END,
    {{'path': NULL::VARCHAR, 'at': 0::BIGINT, 'fence': '', 'width': 0::BIGINT, 'out': []::STRUCT(path VARCHAR, a BIGINT, b BIGINT)[]}}) AS r FROM k),
o AS (SELECT item_id, ls, CASE WHEN r.path IS NULL THEN r.out ELSE list_append(r.out, {{'path': r.path, 'a': r.at, 'b': -1::BIGINT}}) END AS b FROM f),
u AS (SELECT item_id, ls, unnest(b) AS b, generate_subscripts(b, 1) - 1 AS place FROM o), v AS (SELECT *, replace(b.path, '\', '/') AS q FROM u)
SELECT item_id, place::INT AS place, b.path AS path, CASE WHEN b.b < 0 THEN 'unclosed' WHEN b.path = '' THEN 'empty path' WHEN NOT {_SAFE} THEN 'unsafe path' ELSE 'ok' END AS verdict,
  md5(array_to_string(ls[b.a + 1 : CASE WHEN b.b < 0 THEN len(ls) ELSE b.b END], chr(10))) AS hash FROM v""",
    "review_blocks": rf"""WITH {_reviews_sql(r'---REVIEW: \1 | \2 ---', 'SEARCH: a | | b c')}, b AS (SELECT doc_id, unnest(regexp_extract_all(t || chr(10) || '---END REVIEW---', '(?s)---REVIEW:\s*\w[\w-]*\s*\|\s*[^\r\n]+?\s*---\r?\n.*?---END REVIEW---')) AS x FROM a),
c AS (SELECT doc_id, lower(regexp_extract(x, '(?s)---REVIEW:\s*(\w[\w-]*)\s*\|', 1)) AS k, trim(regexp_extract(x, '---REVIEW:[^|]*\|\s*([^\r\n]+?)\s*---\r?\n', 1), ' ') AS title, {_trimmed("regexp_extract(x, '(?s)---REVIEW:[^|]*[|][^\r\n]+?---\r?\n(.*?)---END REVIEW---', 1)")} AS y FROM b)
SELECT doc_id, CASE WHEN k IN ('contradiction', 'duplicate', 'missing-page', 'suggestion') THEN k ELSE 'confirm' END AS kind, title, md5({_trimmed(_first_only(_first_only(_first_only('y', 'OPTIONS'), 'PAGES'), 'SEARCH'))}) AS description,
  CASE WHEN regexp_matches(y, '(?m)^OPTIONS:') THEN array_to_string(list_transform(string_split(regexp_extract(y, '(?m)^OPTIONS:[ \t]*([^\r\n]+)', 1), '|'), lambda s: trim(s, ' ')), '|') ELSE 'Approve|Skip' END AS options,
  array_to_string(list_filter(list_transform(string_split(nullif(regexp_extract(y, '(?m)^PAGES:[ \t]*([^\r\n]+)', 1), ''), ','), lambda s: trim(s, ' ')), lambda s: s <> ''), '|') AS pages,
  array_to_string(list_filter(list_transform(string_split(nullif(regexp_extract(y, '(?m)^SEARCH:[ \t]*([^\r\n]+)', 1), ''), '|'), lambda s: trim(s, ' ')), lambda s: s <> ''), '|') AS searches FROM c""",
    "lint_blocks": rf"""WITH {_reviews_sql(r'---LINT: \1 | Warning | \2 ---', '---END LINT---')},
c AS (SELECT doc_id, regexp_extract(t, '---LINT:\s*([^\n|]+?)\s*\|', 1) AS k, trim(regexp_extract(t, '---LINT:[^|]*\|[^|]*\|\s*([^\r\n]+?)\s*---\r?\n', 1), ' ') AS title, {_trimmed("regexp_extract(t, '(?s)---LINT:[^|]*[|][^|]*[|][^\r\n]+?---\r?\n(.*?)---END LINT---', 1)")} AS y FROM a WHERE regexp_matches(t, '(?s)---LINT:\s*[^\n|]+?\s*\|\s*[^\n|]+?\s*\|\s*[^\r\n]+?\s*---\r?\n.*?---END LINT---'))
SELECT doc_id, 'warning' AS severity, title, md5('[' || lower(k) || '] ' || {_trimmed(_first_only('y', 'PAGES'))}) AS detail, array_to_string(list_transform(string_split(nullif(regexp_extract(y, '(?m)^PAGES:[ \t]*([^\r\n]+)', 1), ''), ','), lambda s: trim(s, ' ')), '|') AS pages FROM c""",
    # What was spoilt must come out as it was, with lists of links in quotes.
    "sanitised_pages": rf"""WITH {_WIKI}, p AS (SELECT doc_id, regexp_replace(text, 'tags: \[([a-z]+), ([a-z]+)\][ \t\r]*\n', 'tags: ["[[\1]]", "[[\2]]"]' || chr(10)) AS mended, regexp_replace(text, 'tags: \[([a-z]+), ([a-z]+)\]', 'tags: [[\1]], [[\2]]') AS bare FROM w)
SELECT doc_id, md5(CASE WHEN regexp_matches(bare, '(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)') AND regexp_matches(regexp_extract(bare, '(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)', 1), '(?m)^tags: \[\[[a-z]+\]\], \[\[[a-z]+\]\]\s*$') THEN mended ELSE bare END) AS hash FROM p""",
    "located_frontmatter": rf"""WITH {_WIKI}, p AS (SELECT doc_id, text, doc_id % 4 AS n, regexp_matches(text, '(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)') AS has, regexp_extract(text, '(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)', 1) AS f, regexp_extract(text, '(?s)\A---\s*\r?\n.*?\r?\n---\s*(?:\r?\n|\z)(.*)\z', 1) AS b FROM w)
SELECT doc_id, CASE WHEN NOT has OR n = 3 THEN NULL WHEN n = 0 THEN 'start' WHEN n = 1 THEN 'later' ELSE 'fenced' END AS place, CASE WHEN has AND n < 3 THEN md5(f) END AS front,
  md5(CASE WHEN has AND n < 3 THEN b WHEN n = 0 THEN text WHEN n = 1 THEN 'Sure:' || chr(10) || chr(10) || text WHEN n = 2 THEN '```yaml' || chr(10) || text ELSE array_to_string(['1', '2', '3', '4', '5', '6', ''], chr(10)) || text END) AS body FROM p""",
    "written_fields": f"""WITH {_WIKI}, a AS (SELECT doc_id, project_id, {_write_sql('text', 'tags', f"list_append({_field_values('text', 'tags')}, 'a " + chr(34) + "b" + chr(34) + "')")} AS page FROM w)
SELECT doc_id, md5({_write_sql('page', 'related', '[project_id]')}) AS hash FROM a""",
    "united_fields": f"""WITH {_WIKI}, z AS (SELECT doc_id, text AS page, lag(text) OVER (PARTITION BY project_id ORDER BY created_at, doc_id) AS old FROM w),
z0 AS (SELECT *, [] AS o, [] AS n, [] AS m FROM z WHERE old IS NOT NULL), {_step_sql('(SELECT doc_id, page, old FROM z0)', 'page', 'old', 'sources', 's1')},
{_step_sql('(SELECT doc_id, page, old FROM s1)', 'page', 'old', 'tags', 's2')}, {_step_sql('(SELECT doc_id, page, old FROM s2)', 'page', 'old', 'related', 's3')}
SELECT doc_id, md5(page) AS hash FROM s3""",
    "write_routes": r"SELECT DISTINCT p AS path, CASE WHEN p = 'wiki/log.md' OR p LIKE '%/log.md' THEN 'append' WHEN p IN ('wiki/index.md', 'wiki/overview.md') OR p LIKE '%/index.md' OR p LIKE '%/overview.md' THEN 'overwrite' ELSE 'merge' END AS route FROM (SELECT regexp_replace(path, '^\./', '') AS p FROM file_snapshots)",
    "canonical_sources": graph._BASE + rf""", i AS (SELECT id, list_filter(sources, lambda s: s IS NOT NULL) AS s, CASE WHEN regexp_matches(replace(lower(sources[1]), '\', '/'), '^(.*?/)?raw/sources/') THEN regexp_extract(replace(lower(sources[1]), '\', '/'), '^(?:.*?/)?raw/sources/(.*)$', 1) ELSE replace(lower(sources[1]), '\', '/') END AS me FROM n WHERE sources[1] IS NOT NULL),
c AS (SELECT id, list_append(list_transform(s, lambda x: CASE WHEN lower(replace(x, '\', '/')) = me OR (NOT contains(replace(x, '\', '/'), '/') AND lower(x) = regexp_replace(me, '^.*/', '')) THEN me ELSE x END), me) AS v FROM i),
d AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS spot FROM c)
SELECT id, string_agg(x, '|' ORDER BY spot) AS sources FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id, lower(replace(x, '\', '/')) ORDER BY spot) = 1) GROUP BY id""",
    "duplicate_answers": "SELECT title, min(page_id) || '|' || max(page_id) AS slugs, 'same \"title\" {' AS reason, CASE WHEN length(title) % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM wiki_pages WHERE title IS NOT NULL GROUP BY title",
    "reasoning_chars": r"""SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?m)^assistant: ([^\r\n]*)', 1), lambda x: length(regexp_replace(x, '(["\\])', '\\\1', 'g')))), 0)::INT AS chars FROM documents WHERE source = 'chat' AND text IS NOT NULL""",
}
