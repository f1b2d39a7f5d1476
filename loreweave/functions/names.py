"""Column expressions over names: titles, file names, safe paths, languages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loreweave.functions.pages import stable_hash
from loreweave.functions.text import _col

#: Names of languages by their code.
LANGUAGE_CODES = {
    "en": "English", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "fr": "French", "de": "German", "es": "Spanish", "pt": "Portuguese", "it": "Italian", "nl": "Dutch",
    "ru": "Russian", "ar": "Arabic", "fa": "Persian", "he": "Hebrew", "th": "Thai", "vi": "Vietnamese", "hi": "Hindi", "bn": "Bengali", "tr": "Turkish", "pl": "Polish",
    "cs": "Czech", "ro": "Romanian", "hu": "Hungarian", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish", "id": "Indonesian", "el": "Greek",
}
#: Codes of further languages, codes that name a script too, and the languages of each direction and script family.
OTHER_CODES = {
    "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Gujarati": "gu", "Punjabi": "pa", "Burmese": "my", "Khmer": "km", "Lao": "lo", "Georgian": "ka",
    "Armenian": "hy", "Amharic": "am", "Tibetan": "bo", "Sinhala": "si", "Swahili": "sw", "Chinese": "zh-Hans", "Traditional Chinese": "zh-Hant",
}
RIGHT_TO_LEFT = ("Arabic", "Persian", "Hebrew")
FAMILIES = {
    "arabic": ("Arabic", "Persian"),
    "cjk": ("Chinese", "Traditional Chinese", "Japanese", "Korean"),
    "other": ("Hebrew", "Thai", "Hindi", "Bengali", "Tamil", "Telugu", "Kannada", "Malayalam", "Gujarati", "Punjabi", "Burmese", "Khmer", "Lao", "Georgian", "Armenian", "Amharic", "Tibetan", "Sinhala"),
}
#: Device names that no file may have, and the longest slug of a query.
DEVICES, QUERY_SLUG = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)", 50


def language_name(code: str | Column) -> Column:
    """Name of a language by its code, letter case and outer blanks ignored; other values without outer blanks."""
    plain = F.trim(_col(code))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(plain)), plain)


def language_about(name: str | Column) -> Column:
    """Code for pages, writing direction and script family of a language; unknown ones have no code, left to right and Latin."""
    name = _col(name)
    codes = {v: k for k, v in LANGUAGE_CODES.items()} | OTHER_CODES
    family = F.lit("latin")
    for kind, names in FAMILIES.items():
        family = F.when(name.isin(*names), kind).otherwise(family)
    html = F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), name)
    return F.struct(html.alias("html"), F.when(name.isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr").alias("direction"), family.alias("family"))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function gives."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def query_slug(title: str | Column) -> Column:
    """Letters, digits and single hyphens of a title in lower case, at most 50; ``query`` without any. Only titles beyond ASCII are normalised."""
    title = _col(title)
    plain = F.coalesce(_compatible(F.when(title.rlike(r"[^\x00-\x7f]"), title)), title)
    slug = F.regexp_replace(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\s+", "-")
    slug = F.regexp_replace(F.regexp_replace(slug, r"[^\p{L}\p{N}-]", ""), "-+", "-")
    slug = F.substring(F.lower(F.regexp_replace(slug, "^-|-$", "")), 1, QUERY_SLUG)
    return F.when(slug == "", "query").otherwise(slug)


def query_file(title: str | Column, at: str | Column) -> Column:
    """File name of a saved query: slug, date and time (UTC)."""
    return F.concat(query_slug(title), F.date_format(_col(at), "'-'yyyy-MM-dd'-'HHmmss'.md'"))


def safe_relative_path(path: str | Column) -> Column:
    """A path whose segments are sound everywhere; one that had to be changed gets six characters of the path's hash before its extension."""
    plain = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", ".", ".."))

    def sound(part: Column) -> Column:
        kept = F.trim(F.regexp_replace(F.regexp_replace(part, r'[<>:"|?*\x00-\x1f]', "_"), r"[. ]+\z", ""))
        kept = F.when(kept == "", "_").otherwise(kept)
        return F.when(kept.rlike(DEVICES), F.concat(F.lit("_"), kept)).otherwise(kept)

    joined = F.array_join(F.transform(parts, sound), "/")
    mark = F.substring(F.lower(F.conv(stable_hash(plain).cast("string"), 10, 36)), 1, 6)
    marked = F.when(joined.rlike(r"[^/]\.[^./]*\z"), F.regexp_replace(joined, r"(\.[^./]*)\z", F.concat(F.lit("-"), mark, F.lit("$1")))).otherwise(F.concat(joined, F.lit("-"), mark))
    return F.when(F.size(parts) == 0, "_").when(joined == F.array_join(parts, "/"), joined).otherwise(marked)


def graph_title(text: str | Column, name: str | Column) -> Column:
    """Title of a page in the graph: the frontmatter's, else the first heading of the first level, else the file name with blanks for hyphens."""
    text = _col(text)
    field = F.nullif(F.trim(F.regexp_extract(text, r"(?s)\A---\n(?:.*?\n)??title:[ \t]*[\"']?([^\r\n]+?)[\"']?[ \t]*(?:\r?\n|\z)", 1)), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?md)^#[ \t]+([^\r\n]+)", 1)), F.lit(""))
    return F.coalesce(field, heading, F.replace(F.regexp_replace(_col(name), r"\.md\z", ""), F.lit("-"), F.lit(" ")))


def image_contexts(text: str | Column, around: int = 150) -> Column:
    """Images in order with alt, url, place (from 0) and what stands up to ``around`` characters before and after."""
    text = _col(text)
    image = r"!\[([^\]]*)\]\(([^)\s]+)\)"
    found, between = F.regexp_extract_all(text, F.lit(image), F.lit(0)), F.split(text, image)
    start = F.array().cast("array<int>")
    places = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), start, lambda acc, i: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(F.try_element_at(found, i - 1)), F.lit(0)) + F.length(F.try_element_at(between, i)))))

    def shown(image_text: Column, i: Column) -> Column:
        at = F.element_at(places, i + 1)
        end = at + F.length(image_text)
        before = F.substring(text, F.greatest(at - around, F.lit(0)) + 1, at - F.greatest(at - around, F.lit(0)))
        return F.struct(F.regexp_extract(image_text, image, 1).alias("alt"), F.regexp_extract(image_text, image, 2).alias("url"), at.alias("place"), before.alias("before"), F.substring(text, end + 1, F.lit(around)).alias("after"))

    return F.when(F.size(found) > 0, F.transform(found, shown)).otherwise(F.array().cast("array<struct<alt:string,url:string,place:int,before:string,after:string>>"))


def trimmed_index(text: str | Column, tokens: list[str], budget: int) -> Column:
    """An index that is longer than the budget, cut to its headings and the lines with a token, as far as they fit; a line that doesn't fit is passed over."""
    text = _col(text)
    lines = F.split(text, "\n")
    relevant = F.filter(lines, lambda s: s.startswith("##") | F.exists(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), lambda t: F.contains(F.lower(s), t)))
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        fits = s["size"] + F.length(line) + 1 <= budget
        return F.struct((s["size"] + F.when(fits, F.length(line) + 1).otherwise(0)).alias("size"), F.when(fits, F.concat(s["kept"], F.array(s["i"]))).otherwise(s["kept"]).alias("kept"), (s["i"] + 1).alias("i"))

    kept = F.aggregate(relevant, start, step, lambda s: s["kept"])
    cut = F.array_join(F.transform(kept, lambda i: F.element_at(relevant, i + 1)), "\n")
    return F.when(F.length(text) <= budget, text).otherwise(F.when(F.length(cut) < F.length(text), F.concat(cut, F.lit("\n\n[...index trimmed...]"))).otherwise(cut))
