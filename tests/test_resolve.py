from pyspark.sql import functions as F

from loreweave.functions import names
from loreweave.operators import maintain, resolve


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("key", F.lit("clash")) if rows else spark.createDataFrame([], schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names(spark):
    assert column(spark, [" ZH ", "en", "Klingon", "", None], names.language_name) == ["Chinese", "English", "Klingon", "", None]
    about = column(spark, ["Persian", "Traditional Chinese", "Hebrew", "Klingon", None], names.language_about)
    assert [tuple(a) for a in about] == [("fa", "rtl", "arabic"), ("zh-Hant", "ltr", "cjk"), ("he", "rtl", "other"), (None, "ltr", "latin"), (None, "ltr", "latin")]
    titles = ["  A  b--c! ", "Ｆｕｌｌ width", "été à", "???", "", "x" * 60, None]
    assert column(spark, titles, names.query_slug) == ["a-b-c", "full-width", "été-à", "query", "query", "x" * 50, None]
    assert spark.sql("select timestamp'2025-01-02 03:04:05' as t").select(names.query_file(F.lit("A b"), "t")).first()[0] == "a-b-2025-01-02-030405.md"
    found = column(spark, ["a/b.md", "a\\b.md", "../a/./b.md", "a/co?n.md", "con.txt", "x/. ", "", None], names.safe_relative_path)
    assert found[:3] == ["a/b.md"] * 3 and found[6:] == ["_", None]
    assert found[3].startswith("a/co_n-") and found[3].endswith(".md") and found[4].startswith("_con-") and found[5].startswith("x/_-")
    pages = ["---\ntags: []\ntitle: 'T x' \n---\n# H", "text\n## no\n#  Head \n", "plain", "---\nopen"]
    assert column(spark, pages, lambda x: names.graph_title(x, F.lit("my-page.md"))) == ["T x", "Head", "my page", "my page"]


def test_image_contexts(spark):
    text = "ab![x](u.png)cd![](v.png)" + "e" * 200
    found = column(spark, [text, "none", "", None], lambda x: names.image_contexts(x, 5))
    assert [tuple(i) for i in found[0]] == [("x", "u.png", 2, "ab", "cd![]"), ("", "v.png", 15, "ng)cd", "eeeee")]
    assert found[1:3] == [[], []]


def test_trimmed_index(spark):
    text = "## A\n- graph one\n- other\n- graph " + "x" * 50 + "\n## B\n- Graph two"
    cut = column(spark, [text, "short", "", None], lambda x: names.trimmed_index(x, ["graph"], 40))
    assert cut == ["## A\n- graph one\n## B\n- Graph two\n\n[...index trimmed...]", "short", "", None]
    assert column(spark, ["x" * 50], lambda x: names.trimmed_index(x, [], 40)) == ["\n\n[...index trimmed...]"]


def test_pages_and_files(spark):
    pages = table(spark, [("wiki/a/Foo.md",), ("wiki/b/foo.md",), ("wiki/bar.md",), ("wiki/bar.md",)], "path string")
    hits = table(spark, [("FOO", 1.0), ("b/foo", 0.5), ("gone", 0.1), (None, 0.1)], "page_id string, score double").drop("key")
    assert rows(resolve.pages_by_hit(hits, pages)) == [("FOO", 1.0, "wiki/a/Foo.md"), ("b/foo", 0.5, "wiki/b/foo.md")]
    refs = table(spark, [("1", "foo"), ("1", "bar.md"), ("2", "wiki/bar.md"), ("2", "raw/bar.md"), ("3", None)], "id string, ref string").drop("key")
    assert rows(resolve.related_pages(refs, pages)) == [("1", "bar.md", "wiki/bar.md"), ("1", "foo", "wiki/b/foo.md"), ("2", "raw/bar.md", None), ("2", "wiki/bar.md", "wiki/bar.md")]
    files = table(spark, [("raw/sources/a/q.pdf",), ("raw/sources/n.md",), ("wiki/sources/n.md",), ("docs/q.pdf",)], "path string")
    refs = table(spark, [("1", r) for r in ("q.pdf", "n.md", "a/q.pdf", "/docs/q.pdf", "raw/sources/n.md", "wiki/x.md", "gone")], "id string, ref string").drop("key")
    found = {r["ref"]: r["path"] for r in resolve.source_files(refs, files).collect()}
    assert found == {"q.pdf": "raw/sources/a/q.pdf", "n.md": "wiki/sources/n.md", "a/q.pdf": "raw/sources/a/q.pdf", "/docs/q.pdf": "docs/q.pdf", "raw/sources/n.md": "raw/sources/n.md", "wiki/x.md": None, "gone": None}
    images = table(spark, [("media/n/img.png",), ("/w/media/1-a--1-q--zz/i.png",), ("media/gone/i.png",), ("other/i.png",)], "url string")
    found = {r["url"]: r["path"] for r in resolve.image_sources(images, files).collect()}
    assert found["media/n/img.png"] == "raw/sources/n.md" and found["media/gone/i.png"] is None and "other/i.png" not in found
    empty = spark.createDataFrame([], "path string")
    assert resolve.related_pages(refs, empty).where("path is not null").count() == resolve.image_sources(empty.withColumnRenamed("path", "url"), files).count() == 0


def test_pages_of_sources(spark):
    front = "---\nsources:\n  - raw/sources/a/Test.md\n---\n"
    pages = [("wiki/1.md", 'it "is" in "test.md" or'), ("wiki/2.md", front), ("wiki/sources/test-1.md", "x"), ("wiki/3.md", "it's not test.md"), ("wiki/index.md", '"test.md"'), ("wiki/4.md", "'test.md'"), ("wiki/5.md", None)]
    found = resolve.pages_of_sources(table(spark, pages, "path string, text string"), table(spark, [("x/Test.md",), (None,), ("x/test.md",)], "name string"))
    assert rows(found) == [("test.md", "wiki/1.md", "quoted"), ("test.md", "wiki/2.md", "listed"), ("test.md", "wiki/4.md", "quoted"), ("test.md", "wiki/sources/test-1.md", "summary")]


def test_graph_and_queues(spark):
    nodes = table(spark, [("b", "Alpha", "concept"), ("a", None, "concept"), ("alp", "x", "entity")], "id string, title string, type string")
    edges = table(spark, [("a", "b"), ("b", "alp")], "src string, dst string")
    kept, between = resolve.filtered_graph(nodes, edges, "ALP")
    assert [r["id"] for r in kept.collect()] == ["alp", "b"] and [(r["src"], r["dst"]) for r in between.collect()] == [("b", "alp")]
    assert [r["id"] for r in resolve.filtered_graph(nodes, edges, None, "Concept", 0)[0].collect()] == ["a"]
    tasks = spark.createDataFrame([("p", 2, "pending"), ("p", 1, "failed"), ("p", 3, "pending"), ("q", 1, "done")], "queue string, n int, status string")
    assert rows(resolve.queue_heads(tasks, "queue", ["n"])) == [("p", 2, "pending")]
    tasks = spark.createDataFrame([("p", "A\\x", "failed", 3, "old"), ("p", "b", "processing", 1, "old"), ("p", "c", "done", 0, "old")], "project string, path string, status string, retries int, context string")
    asked = spark.createDataFrame([("p", "a/x", ""), ("p", "B", "new"), ("p", "B", "new"), ("q", "c", "")], "project string, path string, context string")
    assert rows(resolve.queued(tasks, asked)) == [("p", "B", "pending", 0, "new"), ("p", "a/x", "pending", 0, "old"), ("p", "b", "processing", 1, "old"), ("p", "c", "done", 0, "old"), ("q", "c", "pending", 0, "")]


def test_embedding_halves_what_is_too_long(spark):
    def model(texts):
        if max(map(len, texts)) > 100:
            raise maintain.Oversize
        return [None if t == "bad" else [float(len(t))] for t in texts]

    chunks = spark.createDataFrame([("a", "p", "x" * 350), ("b", "p", "x" * 900), ("c", "p", "bad"), ("d", "q", None), ("e", "Index", "x"), ("f", "r", "bad")], "chunk_id string, page_id string, text string")
    made = {r["chunk_id"]: (r["embedding"], r["embedded_chars"]) for r in maintain.embed_chunks(chunks, "text", model).collect()}
    assert made == {"a": ([87.0], 87), "b": (None, 112), "c": (None, 3), "d": ([0.0], 0), "e": ([1.0], 1), "f": (None, 3)}
    stored = spark.createDataFrame([("old", "p"), ("kept", "r")], "chunk_id string, page_id string")
    assert rows(maintain.embed_pages(chunks, "text", model, stored)) == [("a", "p"), ("d", "q"), ("kept", "r")]


def test_merged_groups(spark):
    pages = spark.createDataFrame([("a", ["x", "Y", None]), ("b", ["y", "z"]), ("c", None)], "id string, tags array<string>")
    members = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "c"), ("a", "b")], "id string, canonical string")
    assert rows(maintain.merged_groups(pages, members, ["tags"])) == [("b", 2, ["y", "z", "x"]), ("c", 1, [])]
