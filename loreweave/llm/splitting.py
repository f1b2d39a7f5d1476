"""Cutting oversized Markdown texts at natural boundaries.

Stages, each a flat map over rows, so nothing is shuffled and a long text costs
only its own task: a text becomes one row per section (a heading and what
follows it); sections that fit go through as they are; the others are cut by the
first separator of the hierarchy that occurs, paragraph, line, sentence, space,
character, and parts that are still too long by the next. Parts are packed
greedily, and a piece begins with the end of the one before it.

Pieces are slices of the text, so their ranges of code points are exact, and
together they cover the body. Fences and tables stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes where an item has no options.
DEFAULTS = {"target_chars": 1000, "max_chars": 1500, "min_chars": 200, "overlap_chars": 200}

_FRONT = re.compile(r"---[^\S\n]*\n(?:.*\n)*?---[^\S\n]*(?:\n|\Z)")
_MARKED_LINE = re.compile(r"^(?:(?P<fence>`{3,}|~{3,})|(?P<level>#{1,6})[^\S\n]+(?P<title>\S.*)|(?P<bar>\|))", re.M)
_TABLE = re.compile(r"(?:\|.*(?:\n|\Z))+")
#: The hierarchy below sections; the last level, single characters, needs no pattern.
_SEPARATORS = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n", r"[.!?][\"')\]]*\s+|[。！？]+[」』”]*\s*", r"\s+")]
_SNAP = [re.compile(p) for p in (r"[.!?][\"')\]]*\s+|[。！？]+[」』”]*\s*|\n", r"\s+")]


@lru_cache(maxsize=64)
def _closing(mark: str) -> re.Pattern:
    return re.compile(f"^{mark}[^\\S\\n]*$", re.M)


def sections(text: str) -> Iterator[tuple[int, int, str, list[tuple[int, int, str]]]]:
    """Start, end, heading path, and the fences and tables (start, end, kind) of each section."""
    front = _FRONT.match(text)
    start = at = front.end() if front else 0
    path: list[tuple[int, str]] = []
    blocks: list[tuple[int, int, str]] = []
    while found := _MARKED_LINE.search(text, at):
        line_end = text.find("\n", found.start())
        after = len(text) if line_end < 0 else line_end + 1
        if found["fence"]:
            close = _closing(found["fence"]).search(text, after) if line_end >= 0 else None
            end = close.end() if close else len(text) - text.endswith("\n")
            blocks.append((found.start(), end, "fence"))
            at = min(end + 1, len(text))
        elif found["bar"]:
            rows = _TABLE.match(text, found.start())
            end = rows.end() - rows[0].endswith("\n")
            if text.find("\n", found.start(), end) >= 0:
                blocks.append((found.start(), end, "table"))
            at = rows.end()
        else:
            if found.start() > start:
                yield start, found.start(), _breadcrumb(path), blocks
            level = len(found["level"])
            path = [*(p for p in path if p[0] < level), (level, found["title"].strip())]
            start, at, blocks = found.start(), after, []
        if at >= len(text):
            break
    if len(text) > start:
        yield start, len(text), _breadcrumb(path), blocks


def _breadcrumb(path: list[tuple[int, str]]) -> str:
    return " > ".join("#" * level + " " + title for level, title in path)


def _parts(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` characters, by the separator hierarchy; separators stay at the end of a part."""
    todo = [(start, end, 0)]
    while todo:
        start, end, level = todo.pop()
        if end - start <= size:
            if end > start:
                yield start, end
        elif level == len(_SEPARATORS):
            for at in range(start, end, size):
                yield at, min(at + size, end)
        else:
            cuts = [start, *(m.end() for m in _SEPARATORS[level].finditer(text, start, end) if m.end() < end), end]
            todo.extend((a, b, level + 1) for a, b in zip(reversed(cuts[:-1]), reversed(cuts[1:])))


def pieces(text: str, blocks: list[tuple[int, int, str]], target: int, most: int, least: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Ranges of the pieces of one section, and whether the piece is a single block."""
    room = max(1, min(target, most - overlap))
    atoms: list[tuple[int, int, bool]] = []
    at = 0
    for start, end, _ in blocks:
        atoms.extend((a, b, False) for a, b in _parts(text, at, start, room))
        atoms.append((start, end, True))
        at = end
    atoms.extend((a, b, False) for a, b in _parts(text, at, len(text), room))

    packed: list[list] = []  # start, end, the end of the last block, holds nothing but a block
    for start, end, block in atoms:
        last = packed[-1] if packed else None
        joined = end - last[0] if last else 0
        small = last and (last[1] - last[0] < least or end - start < least) and joined <= most - overlap
        if last and (joined <= room or small):
            last[1], last[3] = end, False
            if block:
                last[2] = end
        else:
            packed.append([start, end, end if block else start, block])

    found = [(packed[0][0], packed[0][1], packed[0][3])] if packed else []
    for before, (start, end, _, block) in zip(packed, packed[1:]):
        if overlap and not block:
            begin = max(start - overlap, end - most, before[2])
            first, earlier = found[-1][0], found[-2][1] if len(found) > 1 else 0
            if begin <= before[0] and (end - first <= most or earlier >= before[0]):
                # The overlap would hold the whole piece before, so the two are one, with that one's overlap if it fits.
                found.pop()
                begin = first if end - first <= most else before[0]
            elif begin < start:
                # A piece that is two already isn't taken up again; the overlap begins within it.
                begin = max(begin, before[0] + 1)
                begin = next((m.end() for p in _SNAP if (m := p.search(text, begin, start)) and m.end() < start), begin)
            start = min(begin, start)
        found.append((start, end, block))
    return found


_OPTIONS = "target int, most int, least int, overlap int"
_SECTION = f"item string, {_OPTIONS}, section_no int, section_start bigint, section_chars bigint, heading_path string, body string, blocks array<struct<start:bigint,end:bigint,kind:string>>"
_PIECE = "piece array<struct<start:bigint,end:bigint,block:boolean>>"


def _cut_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    names = ["item", "target", "most", "least", "overlap", "section_no", "section_start", "section_chars", "heading_path", "body", "blocks"]
    types = [pa.string(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.string(), pa.string(), kinds]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for item, text, *options in zip(*(batch.column(c).to_pylist() for c in ("item", "text", "target", "most", "least", "overlap"))):
            for no, (start, end, path, blocks) in enumerate(sections(text)):
                whole = [{"start": a - start, "end": b - start, "kind": kind} for a, b, kind in blocks]
                # The line end before the next heading isn't counted; the last section goes to the very end.
                rows.append((item, *options, no, start, end - start - (end < len(text)), path, text[start:end], whole))
                held += end - start
            if held > 4 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("block", pa.bool_())]))
    for batch in batches:
        found = []
        for body, blocks, *sizes in zip(*(batch.column(c).to_pylist() for c in ("body", "blocks", "target", "most", "least", "overlap"))):
            if len(body) <= sizes[0] and not any(b["end"] - b["start"] > sizes[1] for b in blocks):
                found.append([{"start": 0, "end": len(body), "block": False}])
            else:
                cut = pieces(body, [(b["start"], b["end"], b["kind"]) for b in blocks], *sizes)
                found.append([{"start": a, "end": b, "block": block} for a, b, block in cut])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "piece"])


def split_texts(df: DataFrame, key: str, text: str, sizes: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of each text: key, piece_no, start_char, end_char, text, heading_path,
    is_block, oversized, max_chars, section_start, section_chars, in_section.

    ``sizes`` gives target_chars, max_chars, min_chars and overlap_chars as columns
    of ``df``; a null or missing size takes the default, the target is at most the
    maximum, and an overlap that leaves no room is half the target. Every piece is
    at most max_chars long, save fences and tables, which stay whole: is_block
    marks a piece that is just one, oversized one that is longer than max_chars.
    Null and empty texts have no pieces; blank ones have blank pieces. Front matter
    isn't cut and is in no piece. Rows that are equal in key, text and sizes count
    once per row given; other columns are ignored.
    """
    given = sizes or {}
    value = {n: F.coalesce(given.get(n, F.lit(None)).cast("int"), F.lit(d)) for n, d in DEFAULTS.items()}
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"), *[c.alias(n) for n, c in value.items()])
    most = F.greatest(F.col("max_chars"), F.lit(1))
    target = F.greatest(F.least("target_chars", most), F.lit(1))
    overlap = F.greatest(F.when(F.col("overlap_chars") >= F.least(F.col("target_chars"), most), F.floor(target / 2)).otherwise(F.col("overlap_chars")), F.lit(0))
    rows = rows.select("item", "text", target.cast("int").alias("target"), most.alias("most"), F.col("min_chars").alias("least"), overlap.cast("int").alias("overlap"))
    cut = rows.mapInArrow(_cut_sections, _SECTION).mapInArrow(_cut_pieces, f"{_SECTION}, {_PIECE}")
    each = cut.select("*", F.posexplode("piece").alias("in_section", "p"))
    chars = F.col("p.end") - F.col("p.start")
    body = F.expr("substring(body, int(p.start) + 1, int(p.end - p.start))")
    kind = df.schema[key].dataType
    return each.select(
        F.col("item").cast(kind).alias(key),
        (F.col("section_start") + F.col("p.start")).alias("start_char"),
        (F.col("section_start") + F.col("p.end")).alias("end_char"),
        body.alias("text"),
        "heading_path",
        F.col("p.block").alias("is_block"),
        (chars > F.col("most")).alias("oversized"),
        F.col("most").alias("max_chars"),
        "section_start",
        "section_chars",
        "in_section",
    )


def oversized_places(split: DataFrame, key: str) -> DataFrame:
    """Blocks and sections longer than their limit, from the pieces: key, kind, start_char."""
    blocks = F.when(F.col("is_block") & F.col("oversized"), F.struct(F.lit("block").alias("kind"), F.col("start_char")))
    whole = (F.col("in_section") == 0) & (F.col("section_chars") > F.col("max_chars"))
    section = F.when(whole, F.struct(F.lit("section").alias("kind"), F.col("section_start").alias("start_char")))
    return split.select(key, F.explode(F.array_compact(F.array(blocks, section))).alias("p")).select(key, "p.kind", "p.start_char").distinct()
