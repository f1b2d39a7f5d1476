"""Column expressions that rewrite pages: fields, links, listings, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions.text import _col, frontmatter, list_field, ref_key, scalar_field, strip_frontmatter

#: Start and factor of the 32-bit FNV-1a hash, and the greatest length of a summary's slug.
FNV_START, FNV_FACTOR, SLUG_LENGTH = 0x811C9DC5, 0x01000193, 120

#: Stores that an import never enters, formats that often hold settings, and the largest file that it takes.
INTERNAL, SETTINGS, IMPORT_LIMIT = r"(^|/)(\.store-imported|\.store)(/|$)", ("json", "yaml", "yml", "xml"), 100 * 1024 * 1024
#: Words of an answer that a text was too long.
OVERSIZE = ("too long", "maximum context", "max_tokens", "max tokens", "context length", "token limit", "exceeds", "input length")


def stable_hash(text: str | Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as a whole number; null for null."""
    units = F.regexp_extract_all(F.hex(F.encode(_col(text), "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(FNV_START).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_FACTOR).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def percent_encoded(text: Column) -> Column:
    """Characters other than letters, digits and ``-_.~`` of ASCII as percent codes of their UTF-8 bytes."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A")


def summary_slug(identity: str | Column) -> Column:
    """Slug of a source's summary page: its stem, or for nested paths each part with its length and the hash in base 36."""
    stem = F.regexp_replace(_col(identity), r"\.[^/.]+$", "")
    parts = F.filter(F.transform(F.split(stem, "/"), lambda p: F.trim(p)), lambda p: p != "")
    coded = F.transform(parts, lambda p: F.concat(F.length(percent_encoded(p)).cast("string"), F.lit("-"), percent_encoded(p)))
    mark = F.lower(F.conv(stable_hash(identity).cast("string"), 10, 36))
    nested = F.concat(F.array_join(coded, "--"), F.lit("--"), mark)
    short = F.substring(F.array_join(coded, "--"), F.lit(1), SLUG_LENGTH - 2 - F.length(mark))
    short = F.regexp_replace(F.regexp_replace(short, "%[0-9A-F]?$", ""), "-+$", "")
    cut = F.concat(F.when(short == "", F.lit("source")).otherwise(short), F.lit("--"), mark)
    whole = F.when(F.length(nested) <= SLUG_LENGTH, nested).otherwise(cut)
    return F.when(F.size(parts) > 1, whole).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("source")))


def set_scalar(text: str | Column, name: str, value: Column) -> Column:
    """Page with a frontmatter field set: its line replaced, or added at the end of the block; unchanged without one."""
    text = _col(text)
    front, line = frontmatter(text), F.concat(F.lit(f"{name}: "), value)
    field = f"(?md)^{name}:[ \\t]*[^\\r\\n]*"
    literal = F.regexp_replace(line, r"([\\$])", r"\\$1")
    changed = F.when(front.rlike(field), F.regexp_replace(front, F.lit(field), literal)).otherwise(F.concat(front, line, F.lit("\n")))
    return F.when(front == "", text).otherwise(F.concat(F.lit("---\n"), changed, F.lit("---\n"), strip_frontmatter(text)))


def linked_markdown(text: str | Column) -> Column:
    """Wiki links as Markdown links to fragments outside fences and inline code."""
    pieces = F.regexp_extract_all(_col(text), F.lit(r"(?s)(```.*?(?:```|$)|`[^`\n]*`|[^`]+|`)"), F.lit(1))

    def shown(piece: Column) -> Column:
        named = F.regexp_replace(piece, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2](#$1)")
        return F.when(piece.startswith("`"), piece).otherwise(F.regexp_replace(named, r"\[\[([^\]|]+)\]\]", "[$1](#$1)"))

    return F.array_join(F.transform(pieces, shown), "")


def clean_listing(text: str | Column, gone: Column) -> Column:
    """A listing without the entries (``- [[page]]``) whose first link has a key in the array ``gone``."""
    entry = r"^\s*[-*]\s*\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
    kept = F.filter(F.split(_col(text), "\n"), lambda x: ~(x.rlike(entry) & F.array_contains(gone, ref_key(F.regexp_extract(x, entry, 1)))))
    return F.array_join(kept, "\n")


def entity_summary(text: str | Column, slug: Column) -> Column:
    """slug, type, title, description of at most 200 characters and tags; null without frontmatter."""
    text = _col(text)
    front = frontmatter(text)
    first = F.regexp_extract(strip_frontmatter(text), r"(?md)^([^#\s][^\r\n]*)", 1)
    about = F.substring(F.coalesce(scalar_field(front, "description"), F.nullif(F.trim(first), F.lit(""))), 1, 200)
    made = F.struct(slug.alias("slug"), F.coalesce(scalar_field(front, "type"), F.lit("unknown")).alias("type"), F.coalesce(scalar_field(front, "title"), slug).alias("title"), about.alias("description"), list_field(front, "tags").alias("tags"))
    return F.when(front != "", made)


def import_skipped(path: str | Column, size: str | Column) -> Column:
    """Files of a project that a scheduled import passes over: its stores, its own wiki, its cache, dot files, formats that often hold settings, and files above the limit."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    inner = p.rlike(INTERNAL) | p.rlike(r"^(wiki|raw/sources/\.cache)(/|$)") | p.rlike(r"(^|/)\.[^/]*$")
    settings = F.lower(p).rlike(rf"\.({'|'.join(SETTINGS)})$")
    return F.coalesce(inner | settings | (_col(size) > IMPORT_LIMIT), F.lit(False))


def oversize_error(status: str | Column, message: str | Column) -> Column:
    """Whether an answer says that the text was too long, by its status or its words."""
    return F.coalesce((_col(status) == 413) | F.lower(_col(message)).rlike("|".join(OVERSIZE)), F.lit(False))


__all__ = [
    "clean_listing", "entity_summary", "import_skipped", "linked_markdown", "oversize_error", "percent_encoded", "set_scalar", "stable_hash", "summary_slug",
]
