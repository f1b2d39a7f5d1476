"""Reading pages, source files and office documents; writing the knowledge base's tables.

Readers use Spark's own file sources; office formats are unpacked per file inside
tasks with the standard library.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

#: Extensions whose text can be read, and the bytes above which no hash is taken.
TEXT_EXTENSIONS = ("md", "mdx", "txt", "csv", "json", "html", "htm", "xml", "yaml", "yml")
OFFICE_EXTENSIONS = ("docx", "pptx", "xlsx", "odt", "odp", "ods")
HASH_LIMIT = 32 * 1024 * 1024


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files below a folder: path, name, stem, content. A missing folder is an error of Spark's, an empty one gives no rows."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("stem"), F.col("value").alias("content"))


def list_sources(spark: SparkSession, folder: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS + OFFICE_EXTENSIONS + ("pdf", "doc", "rtf")) -> DataFrame:
    """Files that can be ingested, dot files left out: path, name, size, mtime_ms. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return listed.where(~F.col("name").startswith(".") & F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*extensions))


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """One full listing: path, size, mtime_ms and md5, null above the size limit, whose contents are never loaded."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    columns = ["path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")]
    small = reader.load(folder).where(F.col("length") <= HASH_LIMIT).select(*columns, F.md5("content").alias("hash"))
    large = reader.load(folder).where(F.col("length") > HASH_LIMIT).select(*columns, F.lit(None).cast("string").alias("hash"))
    return small.unionByName(large)


def directory_rows(listing: DataFrame) -> DataFrame:
    """Every file and folder of a listing of relative paths: path, name, depth, is_dir, files (below a folder); dot names are left out."""
    parts = F.split("path", "/")
    above = listing.where(~F.col("path").rlike(r"(^|/)\.")).select(parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    rows = above.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("parts")).alias("is_dir"))
    return rows.groupBy("path", "depth", "is_dir").agg(F.count("*").alias("files")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))


def fresh_cache(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Extracted texts that are at least as new as their file: path, text."""
    both = cached.select("path", "text", F.col("mtime_ms").alias("taken")).join(files.select("path", "mtime_ms"), "path")
    return both.where("taken >= mtime_ms").select("path", "text")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    """Named and numeric entities of the five XML characters, ``&amp;`` last."""
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def article_text(html: Column, most: int = 50_000) -> Column:
    """Readable text of a web page: scripts, styles, navigation and tags out, lines that hold something joined by blank lines."""
    gone = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.split(decode_entities(F.regexp_replace(F.regexp_replace(gone, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n"), r"<[^>]*>", "")), "\n")
    full = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.substring(F.array_join(full, "\n\n"), 1, most)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ET.Element) -> str:
    return "".join(x.text or "" if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "" for x in node.iter())


def _attribute(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def _pipe_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _docx(archive: zipfile.ZipFile) -> str:
    found = []
    for node in ET.fromstring(archive.read("word/document.xml")).find(".//{*}body") or ():
        if _local(node.tag) == "tbl":
            found.append(_pipe_table([[_texts(c) for c in row.findall("{*}tc")] for row in node.findall("{*}tr")]))
        elif _local(node.tag) == "p" and (text := _texts(node).strip()):
            style = next((_attribute(x, "val") for x in node.iter() if _local(x.tag) == "pStyle"), "")
            level = re.match(r"(?i)(?:heading|title)\s*(\d*)", style)
            listed = any(_local(x.tag) == "numPr" for x in node.iter())
            found.append("#" * min(6, int(level[1] or 1)) + " " + text if level else "- " + text if listed else text)
    return "\n\n".join(found)


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((n for n in archive.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def _pptx(archive: zipfile.ZipFile) -> str:
    slides = []
    for no, name in enumerate(_numbered(archive, r"ppt/slides/slide\d+\.xml"), 1):
        lines = [_texts(p).strip() for p in ET.fromstring(archive.read(name)).iter() if _local(p.tag) == "p"]
        slides.append("\n\n".join([f"## Slide {no}", *filter(None, lines)]))
    return "\n\n".join(slides)


def _number(text: str) -> str:
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() else f"{value:.2f}"


def _xlsx(archive: zipfile.ZipFile) -> str:
    names = archive.namelist()
    shared = [_texts(x) for x in ET.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [_attribute(x, "name") for x in ET.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"] if "xl/workbook.xml" in names else []
    found = []
    for no, name in enumerate(_numbered(archive, r"xl/worksheets/sheet\d+\.xml")):
        rows = []
        for row in ET.fromstring(archive.read(name)).iter():
            if _local(row.tag) == "row":
                cells = []
                for c in row:
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), _texts(c))
                    cells.append(shared[int(value)] if _attribute(c, "t") == "s" and value else _number(value))
                rows.append(cells)
        if any(rows):
            found.append(f"## {titles[no] if no < len(titles) else f'Sheet {no + 1}'}\n\n{_pipe_table([r for r in rows if r])}")
    return "\n\n".join(found)


def _odf(archive: zipfile.ZipFile) -> str:
    lines = ["".join(p.itertext()).strip() for p in ET.fromstring(archive.read("content.xml")).iter() if _local(p.tag) in ("p", "h")]
    return "\n".join(filter(None, lines))


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "odt": _odf, "odp": _odf, "ods": _odf}


def office_text(name: str, content: bytes) -> str | None:
    """Markdown of an office file; null for other extensions and broken files."""
    reader = _READERS.get(name.rpartition(".")[2].lower())
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return reader(archive).strip() if reader else None
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError):
        return None


def extract_texts(files: DataFrame) -> DataFrame:
    """Texts of files with path and content (the binaryFile source): path, text; null where none can be read."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [office_text(p, c) for p, c in zip(frame["path"], frame["content"])]
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    name = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    office = files.where(name.isin(*OFFICE_EXTENSIONS)).select("path", "content").mapInPandas(emit, "path string, text string")
    plain = files.where(name.isin(*TEXT_EXTENSIONS)).select("path", F.trim(F.try_validate_utf8("content")).alias("text"))
    other = files.where(~name.isin(*TEXT_EXTENSIONS, *OFFICE_EXTENSIONS)).select("path", F.lit(None).cast("string").alias("text"))
    return office.unionByName(plain).unionByName(other)


def clip_files(clips: DataFrame, day: str) -> DataFrame:
    """File names of received clips: url, name. Of one slug the later ones by url get a counter."""
    from loreweave.functions.text import clip_slug

    slug = F.coalesce(F.nullif(clip_slug("title"), F.lit("")), F.lit("clip"))
    placed = clips.select("url", slug.alias("slug")).withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("url")))
    return placed.select("url", F.concat("slug", F.lit(f"-{day}"), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md")).alias("name"))


def append_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows, in folders of ``by`` if given: logs, histories of pages, chats by conversation."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_index(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Index entries (slug, line) with those new ones whose slug isn't there yet; of equal new slugs the first line."""
    new = entries.groupBy("slug").agg(F.min("line").alias("line")).join(index, "slug", "left_anti")
    return index.select("slug", "line").unionByName(new)


def upsert_rows(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed table after an upsert: of each incoming key the row with the greatest version replaces the stored one."""
    rest = [c for c in stored.columns if c not in keys]
    newest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, F.xxhash64(*rest))).alias("m")).select(*keys, "m.*")
    return stored.join(newest, keys, "left_anti").unionByName(newest.select(*stored.columns))


def web_results(payload: DataFrame, provider: str, limit: int) -> DataFrame:
    """Results of an injected web search in one form: query, title, url, snippet, source; without an address they are dropped.

    ``payload`` has query and body (JSON text).
    """
    item = "struct<title:string,url:string,link:string,content:string,snippet:string,body:string>"
    lists = f"struct<results:array<{item}>,organic_results:array<{item}>,items:array<{item}>>"
    body = F.from_json("body", lists)
    rows = payload.select("query", F.posexplode(F.coalesce(body["results"], body["organic_results"], body["items"])).alias("place", "r"))
    rows = rows.select("query", "place", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce(F.nullif("r.url", F.lit("")), "r.link").alias("url"), F.coalesce("r.content", "r.snippet", "r.body", F.lit("")).alias("snippet"), F.lit(provider).alias("source"))
    order = Window.partitionBy("query").orderBy("place")
    kept = rows.where(F.coalesce("url", F.lit("")) != "").withColumn("n", F.row_number().over(order))
    return kept.where(F.col("n") <= limit).drop("n", "place")


def watch_folder(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of new Markdown files: path, modified, content."""
    reader: DataStreamReader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))
