"""Column expressions for what a model answers when it is asked to write pages: marked blocks, their repair, and the merge into stored pages.

Texts are cut into lines once; only the few lines that mean something are folded over, and
blocks are slices of the lines, so the work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.pages import set_scalar
from loreweave.functions.text import _col, frontmatter, list_field, safe_page_path, scalar_field, strip_frontmatter
from loreweave.operators.maintain import union_lists

#: Lines that open and close a file block, and that open or close a code fence.
OPENER, CLOSER, FENCE = r"(?i)^---\s*FILE:\s*(.+?)\s*---\s*$", r"(?i)^---\s*END\s+FILE\s*---\s*$", r"^\s{0,3}(```+|~~~+)"
#: Kinds of reviews (others count as confirm) and the choices of a review that names none.
REVIEW_KINDS, DEFAULT_OPTIONS = ("contradiction", "duplicate", "missing-page", "suggestion"), ("Approve", "Skip")
#: List fields whose members are united, fields that keep their stored value, and the least share of the longer body that a merge must keep.
UNION_FIELDS, LOCKED_FIELDS, LEAST_BODY = ("sources", "tags", "related"), ("type", "title", "created"), 0.7

_OPEN = "struct<path:string,start:int,fence:string,width:int,blocks:array<struct<path:string,start:int,stop:int>>>"


def file_blocks(text: str | Column) -> Column:
    """File blocks in order: path, content, verdict (ok, unclosed, empty path, unsafe path); null for a null text.

    A closing line inside a code fence is content. A block without a closing line takes all
    lines to the end and is unclosed. Line ends become line feeds.
    """
    lines = F.split(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), "\n")
    marks = F.transform(lines, lambda s, i: F.struct(i.alias("i"), F.regexp_extract(s, FENCE, 1).alias("run"), s.rlike(CLOSER).alias("closes"), F.when(s.rlike(OPENER), F.trim(F.regexp_extract(s, OPENER, 1))).alias("path")))
    marks = F.filter(marks, lambda m: (m["run"] != "") | m["closes"] | m["path"].isNotNull())
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("path"), F.lit(0).alias("start"), F.lit("").alias("fence"), F.lit(0).alias("width"), F.array().cast("array<struct<path:string,start:int,stop:int>>").alias("blocks"))

    def state(path: Column, at: Column, fence: Column, width: Column, blocks: Column) -> Column:
        return F.struct(path.alias("path"), at.alias("start"), fence.alias("fence"), width.alias("width"), blocks.alias("blocks")).cast(_OPEN)

    def step(s: Column, m: Column) -> Column:
        opened = state(m["path"], m["i"] + 1, F.lit(""), F.lit(0), s["blocks"])
        fenced = state(s["path"], s["start"], F.substring(m["run"], 1, 1), F.length(m["run"]), s["blocks"])
        bare = state(s["path"], s["start"], F.lit(""), F.lit(0), s["blocks"])
        done = F.concat(s["blocks"], F.array(F.struct(s["path"].alias("path"), s["start"].alias("start"), m["i"].alias("stop"))))
        closed = state(none, F.lit(0), F.lit(""), F.lit(0), done)
        ends = (s["fence"] == F.substring(m["run"], 1, 1)) & (F.length(m["run"]) >= s["width"])
        inside = F.when(m["run"] != "", F.when(s["fence"] == "", fenced).when(ends, bare).otherwise(s)).when(m["closes"] & (s["fence"] == ""), closed).otherwise(s)
        return F.when(s["path"].isNotNull(), inside).when(m["path"].isNotNull(), opened).otherwise(s)

    def rest(s: Column) -> Column:
        last = F.array(F.struct(s["path"].alias("path"), s["start"].alias("start"), F.lit(-1).alias("stop")))
        return F.when(s["path"].isNotNull(), F.concat(s["blocks"], last)).otherwise(s["blocks"])

    found = F.aggregate(marks, start.cast(_OPEN), step, rest)
    verdict = lambda b: F.when(b["stop"] < 0, "unclosed").when(b["path"] == "", "empty path").when(~safe_page_path(b["path"]), "unsafe path").otherwise("ok")
    size = lambda b: F.when(b["stop"] < 0, F.size(lines)).otherwise(b["stop"]) - b["start"]
    return F.transform(found, lambda b: F.struct(b["path"].alias("path"), F.array_join(F.slice(lines, b["start"] + 1, size(b)), "\n").alias("content"), verdict(b).alias("verdict")))


def _field(body: Column, name: str) -> Column:
    """What follows ``NAME:`` on its first line; null without it."""
    return F.nullif(F.regexp_extract(body, rf"(?md)^{name}:[ \t]*([^\r\n]+)", 1), F.lit(""))


def _without_field(body: Column, name: str) -> Column:
    return F.regexp_replace(body, rf"(?s)\A(.*?)(?<![^\n]){name}:[^\r\n]*", "$1")


def _listed(value: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(value, by), lambda x: F.trim(x)), lambda x: x != "")


def review_blocks(text: str | Column) -> Column:
    """Review blocks in order: kind, title, description, options, pages and searches (null if not named)."""
    block = r"(?s)---REVIEW:\s*(\w[\w-]*)\s*\|\s*([^\r\n]+?)\s*---\r?\n(.*?)---END REVIEW---"
    none = F.array(*[F.lit(x) for x in DEFAULT_OPTIONS])

    def parsed(found: Column) -> Column:
        kind, title, body = (F.regexp_extract(found, block, i) for i in (1, 2, 3))
        kind, body = F.lower(kind), F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
        rest = _without_field(_without_field(_without_field(body, "OPTIONS"), "PAGES"), "SEARCH")
        return F.struct(
            F.when(kind.isin(*REVIEW_KINDS), kind).otherwise("confirm").alias("kind"), F.trim(title).alias("title"), F.regexp_replace(rest, r"^\s+|\s+$", "").alias("description"),
            F.coalesce(F.transform(F.split(_field(body, "OPTIONS"), r"\|"), lambda x: F.trim(x)), none).alias("options"),
            _listed(_field(body, "PAGES"), ",").alias("pages"), _listed(_field(body, "SEARCH"), r"\|").alias("searches"),
        )

    return F.transform(F.regexp_extract_all(_col(text), F.lit(block), F.lit(0)), parsed)


def lint_blocks(text: str | Column) -> Column:
    """Findings of a semantic check in order: severity (warning or info), title, detail behind its kind, pages."""
    block = r"(?s)---LINT:\s*([^\n|]+?)\s*\|\s*([^\n|]+?)\s*\|\s*([^\r\n]+?)\s*---\r?\n(.*?)---END LINT---"

    def parsed(found: Column) -> Column:
        kind, severity, title, body = (F.regexp_extract(found, block, i) for i in (1, 2, 3, 4))
        body = F.regexp_replace(body, r"^\s+|\s+$", "")
        detail = F.concat(F.lit("["), F.lower(F.trim(kind)), F.lit("] "), F.regexp_replace(_without_field(body, "PAGES"), r"^\s+|\s+$", ""))
        return F.struct(
            F.when(F.lower(F.trim(severity)) == "warning", "warning").otherwise("info").alias("severity"), F.trim(title).alias("title"), detail.alias("detail"),
            F.transform(F.split(_field(body, "PAGES"), ","), lambda x: F.trim(x)).alias("pages"),
        )

    return F.transform(F.regexp_extract_all(_col(text), F.lit(block), F.lit(0)), parsed)


#: Fixed value: a field whose value is links without the brackets of a list.
_BARE_LINKS = r"^(\s*[A-Za-z_][\w-]*\s*:\s*)(\[\[[^\]]+\]\](?:\s*,\s*\[\[[^\]]+\]\])+)\s*$"


def repair_link_lists(front: Column) -> Column:
    """Frontmatter lines whose value is several links become lists of quoted links."""

    def repaired(line: Column) -> Column:
        items = F.transform(F.split(F.regexp_extract(line, _BARE_LINKS, 2), ","), lambda x: F.concat(F.lit('"'), F.trim(x), F.lit('"')))
        return F.when(line.rlike(_BARE_LINKS), F.concat(F.regexp_extract(line, _BARE_LINKS, 1), F.lit("["), F.array_join(items, ", "), F.lit("]"))).otherwise(line)

    return F.array_join(F.transform(F.split(front, "\n"), repaired), "\n")


def sanitised(text: str | Column) -> Column:
    """A generated page without a fence around it, without a ``frontmatter:`` line before it, and with its link lists repaired."""
    fenced = r"(?s)\A[ \t]*```(?:yaml|md|markdown)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```[ \t]*\r?\n?\s*\z"
    page = F.regexp_replace(_col(text), fenced, "$1")
    page = F.regexp_replace(page, r"\A[ \t]*frontmatter\s*:\s*\r?\n([ \t]*---\s*\r?\n)", "$1")
    front = r"(?s)\A(---\s*\r?\n)(.*?)(\r?\n---\s*(?:\r?\n|\z).*)\z"
    parts = [F.regexp_extract(page, front, i) for i in (1, 2, 3)]
    return F.when(parts[0] == "", page).otherwise(F.concat(parts[0], repair_link_lists(parts[1]), parts[2]))


def located_frontmatter(text: str | Column) -> Column:
    """A page's frontmatter, even a few lines down or in a fence: place (start, later, fenced), front, body; place null and the whole text as body without one.

    A block later than the sixth line is none. The end of the fence around it belongs to neither.
    """
    text = _col(text)
    first = r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)(.*)\z"
    later = r"(?s)\A(.*?\n)---\s*\r?\n(.*?)\r?\n---\s*(?:\r?\n|\z)(.*)\z"
    prefix = F.regexp_extract(text, later, 1)
    lines = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    fenced = prefix.rlike(r"(?i)\A\s*```(?:yaml|yml)?\s*\r?\n\z")
    body = F.regexp_extract(text, later, 3)
    body = F.when(fenced, F.regexp_replace(body, r"\A\s*```\s*(?:\r?\n|\z)", "")).otherwise(body)
    none = F.lit(None).cast("string")

    def made(place: Column, front: Column, body: Column) -> Column:
        return F.struct(place.alias("place"), front.alias("front"), body.alias("body"))

    return (
        F.when(text.rlike(first), made(F.lit("start"), F.regexp_extract(text, first, 1), F.regexp_extract(text, first, 2)))
        .when((prefix != "") & (lines <= 6), made(F.when(fenced, "fenced").otherwise("later"), F.regexp_extract(text, later, 2), body))
        .otherwise(made(none, none, text))
    )


_BLOCK = r"(?s)\A(---\r?\n)(.*?)(\r?\n---.*)\z"


def write_list(text: str | Column, name: str, values: Column) -> Column:
    """A page with a list field set, in brackets and quotes: its line or dashed lines replaced, or a line added; unchanged without frontmatter."""
    text = _col(text)
    head, front, rest = (F.regexp_extract(text, _BLOCK, i) for i in (1, 2, 3))
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"')))
    line = F.concat(F.lit(f"{name}: ["), F.array_join(quoted, ", "), F.lit("]"))
    inline, dashed = rf"(?m)^{name}:[ \t]*\[[^\]]*\]", rf"(?m)^{name}:[ \t]*\n(?:[ \t]+-[ \t]+[^\n]+\n?)+"
    # The first place only: what stands before it, the new line, and what comes after.
    placed = lambda field: F.concat(F.element_at(F.split(front, field, 2), 1), line, F.element_at(F.split(front, field, 2), 2))
    made = F.when(front.rlike(inline), placed(inline)).when(front.rlike(dashed), placed(dashed)).otherwise(F.concat(front, F.lit("\n"), line))
    return F.when(head == "", text).otherwise(F.concat(head, made, rest))


def unite_field(page: Column, old: Column, name: str) -> Column:
    """The page with one list field united with the old page's, whose members come first; it stays if the old page has none."""
    before, now = list_field(frontmatter(old), name), list_field(frontmatter(page), name)
    united = union_lists(before, now)
    return F.when((F.size(before) > 0) & (united != now), write_list(page, name, united)).otherwise(page)


def unite_fields(pages: DataFrame, page: str, old: str, names: tuple[str, ...] = UNION_FIELDS) -> DataFrame:
    """``pages`` with the list fields of the column ``page`` united with those of ``old``, one column step per field."""
    for name in names:
        pages = pages.withColumn(page, F.when(F.col(old).isNull(), F.col(page)).otherwise(unite_field(F.col(page), F.col(old), name)))
    return pages


def merge_pages(pages: DataFrame, new: str, old: str, by_model: str, today: str, into: str) -> DataFrame:
    """``pages`` with the generated page merged into the stored one.

    Without a stored page the new one holds, equal ones stay. List fields are united. If the bodies differ,
    ``by_model``, the merged page of an injected model, is taken if it has frontmatter and a body of at least
    0.7 of the longer one: with the stored type, title and date of creation, the lists united again, and the
    date of the update. Else the new page with united lists holds. A null answer of the model counts as none.
    """
    rows = unite_fields(pages.withColumn("_united", F.col(new)), "_united", old)
    bodies = {"_body_old": old, "_body_new": "_united", "_body_made": by_model}
    rows = rows.withColumns({name: strip_frontmatter(c) for name, c in bodies.items()})
    trimmed = [F.regexp_replace(b, r"^\s+|\s+$", "") for b in ("_body_old", "_body_new")]
    least = F.greatest(F.length("_body_old"), F.length("_body_new")) * LEAST_BODY
    rows = rows.withColumn("_taken", F.coalesce((frontmatter(by_model) != "") & (F.length("_body_made") >= least), F.lit(False)))
    rows = rows.withColumn("_made", F.col(by_model))
    for name in LOCKED_FIELDS:
        kept = scalar_field(frontmatter(old), name)
        rows = rows.withColumn("_made", F.when(kept.isNotNull(), set_scalar("_made", name, kept)).otherwise(F.col("_made")))
    rows = unite_fields(rows, "_made", "_united").withColumn("_made", set_scalar("_made", "updated", F.lit(today)))
    same = trimmed[0] == trimmed[1]
    merged = F.when(F.coalesce(F.col(old), F.lit("")) == "", F.col(new)).when(F.col(new) == F.col(old), F.col(old)).when(same, F.col("_united"))
    rows = rows.withColumn(into, merged.when(F.col("_taken"), F.col("_made")).otherwise(F.col("_united")))
    return rows.drop("_united", "_made", "_taken", *bodies)


def write_route(path: str | Column) -> Column:
    """What writing a page does: append to a log, overwrite a listing, merge into any other."""
    p = _col(path)
    return F.when(p.rlike(r"(^wiki|/)/?log\.md$"), "append").when(p.rlike(r"(^wiki|/)/?(index|overview)\.md$"), "overwrite").otherwise("merge")


def canonical_sources(sources: Column, identity: Column) -> Column:
    """A page's sources with this one in its canonical spelling, added if missing, each once whatever its case or slashes."""
    plain = lambda s: F.lower(F.replace(s, F.lit("\\"), F.lit("/")))
    name = F.lower(F.regexp_replace(identity, "^.*/", ""))
    same = lambda s: (plain(s) == plain(identity)) | (~F.contains(plain(s), F.lit("/")) & (plain(s) == name))
    members = F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isNotNull())
    spelled = F.concat(F.transform(members, lambda s: F.when(same(s), identity).otherwise(s)), F.array(identity))
    keys = F.transform(spelled, plain)
    return F.transform(F.array_distinct(keys), lambda k: F.element_at(spelled, F.array_position(keys, k).cast("int")))


def json_object(text: str | Column) -> Column:
    """The first balanced object of braces in a text, whatever stands around it; braces in its strings don't count; null without one."""
    tokens = F.regexp_extract_all(F.regexp_extract(_col(text), r"(?s)(\{.*)", 1), F.lit(r'(?s)(\\.|["{}]|[^\\"{}]+|\\)'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, token: Column) -> Column:
        quoted = F.when(token == '"', ~s["quoted"]).otherwise(s["quoted"])
        move = F.when(s["quoted"], 0).when(token == "{", 1).when(token == "}", -1).otherwise(0)
        depth, n = s["depth"] + move, s["n"] + 1
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), n.alias("n"), F.when((move == -1) & (depth == 0), n).otherwise(0).alias("end")))

    end = F.aggregate(tokens, start, step, lambda s: s["end"])
    return F.when(end > 0, F.array_join(F.slice(tokens, 1, F.greatest(end, F.lit(1))), ""))


def duplicate_answer(text: str | Column) -> Column:
    """Groups that a model names as duplicates: slugs (two or more), reason, confidence (low unless high or medium); empty for an unreadable answer."""
    parsed = F.from_json(json_object(text), "groups array<struct<slugs:array<string>,reason:string,confidence:string>>")["groups"]
    groups = F.filter(F.coalesce(parsed, F.array().cast("array<struct<slugs:array<string>,reason:string,confidence:string>>")), lambda g: F.size(F.filter(g["slugs"], lambda s: s.isNotNull())) >= 2)
    sure = lambda c: F.when(c.isin("high", "medium"), c).otherwise("low")
    return F.transform(groups, lambda g: F.struct(F.filter(g["slugs"], lambda s: s.isNotNull()).alias("slugs"), F.coalesce(g["reason"], F.lit("")).alias("reason"), sure(g["confidence"]).alias("confidence")))


def reasoning_chars(text: str | Column) -> Column:
    """Length of the reasoning fields, as they are escaped, in the lines of a model's stream."""
    found = F.regexp_extract_all(_col(text), F.lit(r'"reasoning(?:_content)?"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))


def linked_terms(text: str | Column, links: Column) -> Column:
    """A page in which the first unlinked occurrence of each term (``links``: term, target) is a link, once per target; the frontmatter stays.

    The alias is left out where the term is the target, letter case ignored.
    """
    text = _col(text)
    front = F.regexp_extract(text, r"(?s)\A(---\n.*?\n---\n)", 1)
    body = F.substring(text, F.length(front) + 1, F.length(text))
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)(\[\[.*?\]\]|\[+(?!\[)|(?:[^\[])+|\[)"), F.lit(1))
    start = F.struct(pieces.alias("pieces"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, link: Column) -> Column:
        term, target = link["term"], link["target"]
        free = F.transform(s["pieces"], lambda p: ~p.startswith("[[") & F.contains(p, term))
        at = F.array_position(free, F.lit(True)).cast("int")
        piece = F.element_at(s["pieces"], F.greatest(at, F.lit(1)))
        i = F.call_function("instr", piece, term)
        link_text = F.when(F.lower(term) == F.lower(target), F.concat(F.lit("[["), term, F.lit("]]"))).otherwise(F.concat(F.lit("[["), target, F.lit("|"), term, F.lit("]]")))
        cut = F.array(F.substring(piece, F.lit(1), i - 1), link_text, F.substring(piece, i + F.length(term), F.length(piece)))
        rest = F.slice(s["pieces"], at + 1, F.size(s["pieces"]))
        made = F.concat(F.slice(s["pieces"], F.lit(1), F.greatest(at - 1, F.lit(0))), cut, rest)
        skipped = F.array_contains(s["done"], F.lower(target)) | (term == "") | (target == "") | (at < 1)
        return F.when(F.coalesce(skipped, F.lit(True)), s).otherwise(F.struct(made.alias("pieces"), F.concat(s["done"], F.array(F.lower(target))).alias("done")))

    made = F.aggregate(F.coalesce(links, F.array().cast("array<struct<term:string,target:string>>")), start, step, lambda s: F.array_join(s["pieces"], ""))
    return F.when(F.size(pieces) > 0, F.concat(front, made)).otherwise(text)
