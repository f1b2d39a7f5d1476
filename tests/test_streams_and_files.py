import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loreweave.sources import files
from loreweave.streaming import changes as st


def test_task_life():
    task = None
    seen = []
    for event in ("created", "modified", "start", "deleted", "done", "start", "failed", "start", "failed", "start", "failed", "modified", "start"):
        task = st.advance(task, event, 1)
        seen.append((task["kind"], task["status"], task["retries"], task["again"]) if task else None)
    assert seen[0] == ("created", "pending", 0, False) and seen[1][0] == "modified"
    assert seen[3] == ("deleted", "processing", 0, True) and seen[4] == ("deleted", "pending", 0, False)
    assert [x[1] for x in seen[6:11:2]] == ["pending", "pending", "failed"]
    assert seen[11] == ("modified", "failed", 3, False) and seen[12][1] == "failed"
    assert st.advance(st.advance(st.advance(None, "created", 1), "start", 2), "done", 3) is None
    assert st.advance(None, "start", 1) is None and st.merge_kind("deleted", "created") == "modified"


def test_allowed_counts_only_passed():
    recent, passed = [], []
    for at in (0, 1, 2, 3, 1001, 1002):
        recent, ok = st.allowed(recent, at, 2, 1000)
        passed.append(ok)
    assert passed == [True, True, False, False, True, True]


def stream_of(spark, tmp_path, rows, schema, batches=2):
    folder = str(tmp_path / "in")
    for i in range(batches):
        spark.createDataFrame(rows[i::batches] if batches > 1 else rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_queue_and_limits(spark, tmp_path):
    rows = [("a", 1, "created"), ("a", 2, "start"), ("b", 1, "created"), ("b", 2, "deleted"), ("a", 3, "done"), ("c", 5, "mark")]
    found = st.drain(st.change_queue(stream_of(spark, tmp_path, rows, "path string, at bigint, event string", 1)), "queue", "update")
    assert {r["path"]: (r["kind"], r["status"]) for r in found.collect()} == {"a": ("created", "done"), "b": ("modified", "pending")}


def test_own_writes_are_silent(spark, tmp_path):
    rows = [("a", 100, "mark"), ("a", 4000, "modified"), ("a", 4101, "modified"), ("b", 1, "created")]
    found = st.drain(st.without_own_writes(stream_of(spark, tmp_path, rows, "path string, at bigint, event string", 1)), "silent")
    assert {(r["path"], r["at"]) for r in found.collect()} == {("a", 4101), ("b", 1)}


def test_rate_limit_across_batches(spark, tmp_path):
    rows = [("u", 0, 1), ("u", 5000, 4), ("u", 1, 2), ("u", 5001, 5), ("u", 2, 3), ("u", 5002, 6)]
    found = st.drain(st.rate_limited(stream_of(spark, tmp_path, rows, "client string, at bigint, request bigint"), 2, 1000), "limit")
    assert found.count() == 6 and found.where("passed").count() == 4


def test_windows_equal_batch(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(t0 + timedelta(minutes=7 * i), "e" if i % 3 else "f") for i in range(50)]
    stream = stream_of(spark, tmp_path, rows, "ts timestamp, event string", 3)
    found = st.drain(st.counts_by_window(stream, "1 hour"), "counts", "complete")
    last = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    batch = spark.createDataFrame(rows, "ts timestamp, event string").groupBy(F.date_trunc("hour", "ts").alias("began"), "event").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in last.select("began", "event", "n").collect()} == {tuple(r) for r in batch.collect()}


def test_debounce_and_once(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [("a", t0, "created"), ("a", t0 + timedelta(milliseconds=100), "modified"), ("a", t0 + timedelta(seconds=9), "deleted"), ("a", t0 + timedelta(hours=1), "created")]
    schema = "path string, ts timestamp, event string"
    found = st.drain(st.debounced(stream_of(spark, tmp_path, rows, schema, 1), late="1 second"), "debounced")
    assert {(r["changes"], r["last"]) for r in found.collect()} >= {(2, "modified"), (1, "deleted")}
    once = st.drain(st.handled_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["path"]), "once")
    assert once.count() == 1


def test_batches_start_with_their_first_change():
    rows = [(0, "created"), (249, "modified"), (250, "deleted"), (600, "created"), (700, "modified")]
    assert st.gathered(None, rows, 250) == ([(0, 2, "modified"), (250, 1, "deleted")], (600, 2, "modified"))
    assert st.gathered((0, 5, "a"), [(10, "b")], 250) == ([], (0, 6, "b")) and st.gathered(None, [], 250) == ([], None)


def test_changes_of_a_project(spark):
    paths = ["/srv/P/raw/sources/a.md", "C:\\srv\\p\\x.md", "\\srv\\p\\wiki\\b.md", "/srv/px/wiki/c.md", "/srv/p/", "/srv/p/wiki/media/d.md", None]
    df = spark.createDataFrame([(x,) for x in paths], "path string").withColumn("kind", F.lit("modified"))
    assert {r["rel"] for r in st.project_changes(df, F.lit("/srv/p/")).collect()} == {"raw/sources/a.md", "wiki/b.md"}


def test_a_folder_is_scanned_again(spark, tmp_path):
    seen = []
    (tmp_path / "a.txt").write_text("x")

    def handle(now, before):
        seen.append((now.count(), before.count()))
        (tmp_path / f"b{len(seen)}.txt").write_text("x")

    query = st.rescanned(spark, lambda: files.file_listing(spark, str(tmp_path)), handle, "1 second")
    for _ in range(60):
        if len(seen) >= 2 or query.exception():
            break
        query.awaitTermination(1)
    query.stop()
    assert seen[0] == (1, 0) and seen[1] == (2, 1)


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>2.0</v></c></row><row><c><v>1.5</v></c></row></sheetData></worksheet>'
    slides = {f"ppt__slides__slide{i}": f"<sld><p><t>slide {i}</t></p></sld>" for i in (10, 2)}
    cases = {
        "a.docx": office(word__document=body), "b.xlsx": office(xl__sharedStrings="<sst><si><t>Name</t></si></sst>", xl__worksheets__sheet1=sheet),
        "c.pptx": office(**slides), "d.odt": office(content="<d><p>one</p><p/><h>two</h></d>"), "e.docx": b"broken", "f.md": b" plain ", "g.pdf": b"x",
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / ".hidden.md").write_text("x")
    read = spark.read.format("binaryFile").load(str(tmp_path))
    found = {r["path"].rpartition("/")[2]: r["text"] for r in files.extract_texts(read).collect()}
    assert found["a.docx"] == "## Head\n\nText\n\n| a\\|b |  |\n| --- | --- |\n| c |  |"
    assert found["b.xlsx"] == "## Sheet 1\n\n| Name | 2 |\n| --- | --- |\n| 1.50 |  |"
    assert found["c.pptx"] == "## Slide 1\n\nslide 2\n\n## Slide 2\n\nslide 10"
    assert found["d.odt"] == "one\ntwo" and found["e.docx"] is None and found["f.md"] == "plain" and found["g.pdf"] is None
    assert {r["name"] for r in files.list_sources(spark, str(tmp_path)).collect()} == set(cases)
    listing = {r["path"].rpartition("/")[2]: r for r in files.file_listing(spark, str(tmp_path)).collect()}
    assert listing["f.md"]["size"] == 7 and len(listing["f.md"]["hash"]) == 32


def test_pages_and_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# A\nline")
    (tmp_path / "b.txt").write_text("x")
    assert [(r["stem"], r["content"]) for r in files.read_pages(spark, str(tmp_path)).collect()] == [("a", "# A\nline")]
    tree = files.directory_rows(spark.createDataFrame([("x/y/a.md",), ("x/b.md",), (".git/c",)], "path string"))
    assert {(r["path"], r["is_dir"], r["files"]) for r in tree.collect()} == {("x", True, 2), ("x/y", True, 1), ("x/y/a.md", False, 1), ("x/b.md", False, 1)}
    watched = files.watch_folder(spark, str(tmp_path))
    assert watched.isStreaming


def test_small_sources(spark):
    html = "<html><script>no</script><nav>no</nav><p>One &amp; <b>two</b></p><div> </div><p>three</p></html>"
    assert spark.createDataFrame([(html,)], "h string").select(files.article_text(F.col("h"))).first()[0] == "One & two\n\nthree"
    clips = spark.createDataFrame([("u1", "A b"), ("u2", "a B"), ("u3", None)], "url string, title string")
    assert {r["url"]: r["name"] for r in files.clip_files(clips, "2025-01-01").collect()} == {"u1": "a-b-2025-01-01.md", "u2": "a-b-2025-01-01-2.md", "u3": "clip-2025-01-01.md"}
    body = '{"organic_results": [{"title": "t", "link": "l", "snippet": "s"}, {"title": "no"}, {"link": "m"}]}'
    payload = spark.createDataFrame([("q", body), ("r", "{}")], "query string, body string")
    assert [(r["url"], r["title"], r["snippet"]) for r in files.web_results(payload, "x", 5).collect()] == [("l", "t", "s"), ("m", "", "")]
    index = spark.createDataFrame([("a", "- a")], "slug string, line string")
    new = spark.createDataFrame([("a", "- other"), ("b", "- b"), ("b", "- c")], "slug string, line string")
    assert {tuple(r) for r in files.append_index(index, new).collect()} == {("a", "- a"), ("b", "- b")}
    stored = spark.createDataFrame([("k", 1, "old"), ("m", 1, "kept")], "key string, version int, value string")
    late = spark.createDataFrame([("k", 2, "new"), ("k", 3, "newer")], "key string, version int, value string")
    assert {tuple(r) for r in files.upsert_rows(stored, late, ["key"], "version").collect()} == {("k", 3, "newer"), ("m", 1, "kept")}
    cached = spark.createDataFrame([("a", "x", 5), ("b", "y", 1)], "path string, text string, mtime_ms bigint")
    now = spark.createDataFrame([("a", 5), ("b", 2)], "path string, mtime_ms bigint")
    assert [tuple(r) for r in files.fresh_cache(cached, now).collect()] == [("a", "x")]


def test_append_by_conversation(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "hi"), ("c2", "ho")], "conversation string, content string")
    files.append_table(rows, str(tmp_path / "chats"), "conversation")
    files.append_table(rows.limit(1), str(tmp_path / "chats"), "conversation")
    assert spark.read.parquet(str(tmp_path / "chats")).count() == 3
