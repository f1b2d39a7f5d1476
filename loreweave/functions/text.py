"""Column expressions over page texts, names, paths and titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ref_key(name: str | Column) -> Column:
    """Key under which names of one page agree: last path segment, no ``.md``, lower case, no blanks, hyphens, underscores."""
    leaf = F.regexp_replace(F.replace(F.trim(_col(name)), F.lit("\\"), F.lit("/")), "^.*/", "")
    return F.regexp_replace(F.regexp_replace(F.lower(leaf), r"\.md$", ""), r"[\s_-]+", "")


#: Openings of review titles that say only what kind of review it is.
REVIEW_PREFIXES = ("missing[ -]?page", "duplicate[ -]?page", "possible[ -]?duplicate", "缺失页面", "缺少页面", "重复页面", "疑似重复")


def review_key(title: str | Column) -> Column:
    """Review titles that mean the same: without their opening, one blank between words, lower case."""
    opening = f"^({'|'.join(REVIEW_PREFIXES)})[:：]\\s*"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(title)), opening, ""), r"\s+", " "))


def source_identity(path: str | Column, keep_unmatched: bool = False) -> Column:
    """Path below ``raw/sources/``; elsewhere the file name, or the whole path if unmatched ones are kept."""
    plain = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    inside = F.regexp_extract(plain, r"(?is)^(?:.*?/)?raw/sources/(.*)$", 1)
    matched = F.lower(plain).rlike(r"(?s)^(.*?/)?raw/sources/")
    return F.when(matched, inside).otherwise(plain if keep_unmatched else F.regexp_replace(plain, "^.*/", ""))


def source_matches(target: Column, references: Column) -> Column:
    """Whether any of the references names the source: the same identity, letter case ignored; null references name none.

    A bare name fits a target in a folder in no case, so a file of that name elsewhere keeps its references; two bare
    names fit when they are equal.
    """
    keys = F.transform(F.filter(references, lambda r: r.isNotNull()), lambda r: F.lower(source_identity(r, keep_unmatched=True)))
    return F.coalesce(F.array_contains(keys, F.lower(target)), F.lit(False))


#: Extensions of each category of files.
CATEGORIES = {
    "markdown": "md mdx",
    "text": "txt rtf log",
    "code": "js jsx ts tsx py rs go java c cpp h hpp rb php swift kt scala sh bash zsh sql r lua css scss less html htm xml svg vue svelte toml ini cfg conf dockerfile makefile",
    "image": "png jpg jpeg gif webp bmp ico tiff tif avif heic heif",
    "video": "mp4 webm mov avi mkv flv wmv m4v",
    "audio": "mp3 wav ogg flac aac m4a wma",
    "pdf": "pdf",
    "document": "doc docx xls xlsx ppt pptx odt ods odp pages numbers key epub",
    "data": "json jsonl csv tsv yaml yml ndjson",
}
#: Extensions that can be ingested, and directories of each page type.
INGESTABLE = "md mdx txt rtf pdf doc docx ppt pptx xls xlsx odt ods odp csv json html htm xml yaml yml".split()
TYPE_DIRS = {
    "entities": "entity", "concepts": "concept", "sources": "source", "queries": "query", "comparisons": "comparison",
    "synthesis": "synthesis", "findings": "finding", "thesis": "thesis", "methodology": "methodology",
}


def extension(path: str | Column) -> Column:
    """What follows the last dot, or the whole name without one, in lower case."""
    return F.lower(F.element_at(F.split(_col(path), r"\."), -1))


def file_category(path: str | Column) -> Column:
    ext = extension(path)
    value = F.lit("unknown")
    for category, names in CATEGORIES.items():
        value = F.when(ext.isin(*names.split()), F.lit(category)).otherwise(value)
    return value


def ingestable(path: str | Column) -> Column:
    """Supported extension, no dot file, not in a cache folder."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return extension(p).isin(*INGESTABLE) & ~p.rlike(r"(^|/)\.[^/]*$") & ~p.rlike(r"(^|/)\.cache/")


def type_from_path(path: str | Column) -> Column:
    """Page type by directory, else overview by name, else null."""
    p = F.lower(F.replace(_col(path), F.lit("\\"), F.lit("/")))
    value = F.when(p.rlike(r"(^|/)overview\.md$"), F.lit("overview"))
    for name, kind in reversed(TYPE_DIRS.items()):
        value = F.when(p.rlike(f"/{name}/"), F.lit(kind)).otherwise(value)
    return value


def format_bytes(size: str | Column) -> Column:
    """Whole bytes below 1024, else KB, MB or GB with one decimal."""
    n = _col(size)
    steps = [(F.lit(1024.0**p), unit) for p, unit in ((1, "KB"), (2, "MB"), (3, "GB"))]
    text = F.concat(n.cast("string"), F.lit(" B"))
    for step, unit in steps:
        text = F.when(n >= step, F.concat(F.format_string("%.1f", n / step), F.lit(f" {unit}"))).otherwise(text)
    return text


_LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def wikilinks(text: str | Column) -> Column:
    """Targets of all links in order, trimmed, without their alias; repeats are kept; null for a null text."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(_LINK), F.lit(1)), lambda x: F.trim(x))


def image_urls(text: str | Column) -> Column:
    """Distinct image addresses in order; those with white space are passed over."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))


def headings(text: str | Column) -> Column:
    """Heading lines of all six levels, as written."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?md)^(#{1,6} [^\r\n]+)"), F.lit(1))


_FRONT = r"^---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|$)"


def frontmatter(text: str | Column) -> Column:
    """Lines between the first two ``---`` lines, empty without them."""
    return F.regexp_extract(_col(text), _FRONT, 1)


def strip_frontmatter(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), _FRONT, "")


def scalar_field(front: Column, name: str) -> Column:
    """Value of a one-line field without its quotes; null if missing or empty."""
    value = F.trim(F.regexp_extract(front, f"(?md)^{name}:[ \\t]*([^\\r\\n]*)", 1))
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def list_field(front: Column, name: str) -> Column:
    """Members of a field in brackets, or of the dashed lines below it; empty if missing."""
    inline = F.regexp_extract(front, f"(?md)^{name}:[ \\t]*\\[([^\\]]*)\\]", 1)
    block = F.regexp_extract(front, f"(?md)^{name}:[ \\t]*\\r?\\n((?:[ \\t]*-[ \\t]+[^\\n]*\\n?)+)", 1)
    dashed = F.regexp_extract_all(block, F.lit(r"(?md)^[ \t]*-[ \t]+([^\r\n]+)"), F.lit(1))
    members = F.when(block != "", dashed).otherwise(F.split(inline, ","))
    return F.filter(F.transform(members, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def clip_slug(title: str | Column) -> Column:
    """File name part of a title: letters, digits and hyphens in lower case, at most 50 characters."""
    plain = F.regexp_replace(F.lower(F.trim(_col(title))), r"[^\p{L}\p{N}\s-]", "")
    return F.substring(F.regexp_replace(plain, r"[\s-]+", "-"), 1, 50)


def valid_page_id(page_id: str | Column) -> Column:
    """1 to 256 letters, digits, dots, underscores and hyphens."""
    return F.coalesce(_col(page_id).rlike(r"^[\p{L}\p{N}._-]{1,256}$"), F.lit(False))


def hostname(url: str | Column) -> Column:
    """Host of an address without ``www.``, user and port; null if it has none. Hosts may hold any letters."""
    host = F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def glob_match(path: Column, pattern: str) -> Column:
    """Whether the whole path matches ``*`` and ``?``, letter case ignored."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower(path).rlike(f"(?s)^{body}$")


#: Files and folders that a watcher never reports; a knowledge base keeps its own data in ``.store``.
UNWATCHED_NAMES, UNWATCHED = ("thumbs.db", "desktop.ini"), r"(^|/)\.store/|^wiki/media/|\.ds_store$"


def watched(
    path: Column, excluded_dirs: tuple[str, ...] = (), excluded_globs: tuple[str, ...] = (), excluded_ext: tuple[str, ...] = (), included_ext: tuple[str, ...] = ()
) -> Column:
    """Files a watcher reports: sources by their extension, else Markdown of the wiki and its two guides.

    Excluded are folders (by name, or by path if they have a slash), globs on the whole path or the name, and among
    sources extensions, or all but the included ones if there are any.
    """
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.lower(plain)
    name, parts = F.regexp_replace(p, "^.*/", ""), F.split(p, "/")
    kept = (p != "") & ~p.rlike(UNWATCHED) & ~name.isin(*UNWATCHED_NAMES)
    for d in excluded_dirs:
        d = d.lower().strip("/")
        kept = kept & ~(F.contains(F.concat(F.lit("/"), p), F.lit(f"/{d}/")) if "/" in d else F.array_contains(parts, d))
    for g in excluded_globs:
        kept = kept & ~glob_match(p, g) & ~glob_match(name, g)
    ext = F.when(F.contains(name, F.lit(".")), extension(name)).otherwise("")
    plain_ext = lambda names: [e.lower().lstrip(".") for e in names]
    source = ~ext.isin(*plain_ext(excluded_ext)) if excluded_ext else F.lit(True)
    if included_ext:
        source = source & ext.isin(*plain_ext(included_ext))
    return kept & F.when(plain.startswith("raw/sources/"), source).otherwise(plain.isin("purpose.md", "schema.md") | plain.rlike(r"(?s)^wiki/.*\.md$"))


def safe_page_path(path: str | Column) -> Column:
    """Relative path below wiki/ whose segments are sound names everywhere: not empty, without control or reserved characters, no dot before or blank behind, no device's name."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    shape = p.rlike("^wiki/") & ~p.rlike(r"//|/\z|[ .](/|\z)|(^|/)\.") & ~p.rlike(r"[\x00-\x1f<>:\"|?*]")
    return F.coalesce(shape & ~F.lower(p).rlike(r"(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|\z)"), F.lit(False))


def context_budget(size: str | Column) -> dict[str, Column]:
    """Characters for answer, index, pages and one page, from a context size (204800 without one)."""
    whole = F.when(_col(size) > 0, _col(size)).otherwise(F.lit(204_800)).cast("bigint")
    pages = F.floor(whole * 0.5)
    return {
        "max_ctx": whole,
        "response_reserve": F.floor(whole * 0.15),
        "index_budget": F.floor(whole * 0.05),
        "page_budget": pages,
        "max_page_size": F.least(pages, F.greatest(F.lit(5000).cast("bigint"), F.floor(pages * 0.3))),
    }


#: Messages that only greet.
GREETINGS = (
    "(hi|hello|hey|yo|sup|howdy|hiya|heya|hullo)( there| y'all| you| folks| everyone)?",
    "good (morning|afternoon|evening|day|night)",
    "(what'?s up|wassup|whaddup)",
    "greetings",
    "(你好|您好|大家好|嗨|哈喽|哈啰|哈囉|哈罗|喂)[啊呀吖呢么呗哦哈]?",
    "(早|早啊|早安|早上好|中午好|下午好|晚上好|晚安)[啊呀吖呢么呗哦哈]?",
    "在吗|在嗎|在不在|有人吗|有人嗎|有人在吗|有人在嗎",
    "こんにちは|こんばんは|おはよう|おはようございます|やあ|どうも|はじめまして",
    "안녕|안녕하세요|안녕하십니까",
    "hola|bonjour|salut|coucou|hallo|servus|hej|hejsan|ciao|saluton|ola|olá|privet|привет",
)


def is_greeting(text: str | Column) -> Column:
    """At most 20 characters that greet, punctuation at the end ignored."""
    plain = F.lower(F.trim(F.regexp_replace(F.trim(_col(text)), r"[\s!！。.?？~，,、;；:：]+$", "")))
    return F.coalesce((F.length(plain) <= 20) & plain.rlike(f"^({'|'.join(f'({g})' for g in GREETINGS)})$"), F.lit(False))


def without_links(text: Column, gone: Column) -> Column:
    """Text whose links to the ref keys in the array ``gone`` are replaced by their alias or target.

    Each link is found by its own replacement, so the work is one pass per link of a text.
    """
    links = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[\[[^\]|]+(?:\|[^\]]*)?\]\])"), F.lit(1)))
    dead = F.filter(links, lambda x: F.array_contains(gone, ref_key(F.regexp_extract(x, _LINK, 1))))
    shown = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"\|([^\]]*)\]\]$", 1), F.lit("")), F.regexp_extract(x, _LINK, 1))
    return F.aggregate(dead, text, lambda acc, x: F.replace(acc, x, shown(x)))
