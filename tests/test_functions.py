import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreweave.functions import language, text
from loreweave.functions.search import chunk_snippet, counted_phrase, counted_score, counted_snippet, counted_tokens, occurrences, query_phrase, query_tokens, search_mode, snippet


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_query_tokens():
    assert query_tokens("What is the Sparse-Index?  a b") == ["index", "sparse"]
    assert query_tokens("默认配置") == sorted({"默认配置", "默认", "认配", "配置", "默", "认", "配", "置"})
    assert query_tokens("配置 的") == ["配置"]
    assert query_tokens("") == []
    assert query_phrase("  “Sparse index?” ") == "sparse index"
    assert [search_mode(0, False), search_mode(2, True), search_mode(0, True)] == ["keyword", "hybrid", "vector"]


@given(st.text(max_size=40))
def test_query_tokens_are_sorted_and_distinct(query):
    tokens = query_tokens(query)
    assert tokens == sorted(set(tokens))
    assert all(not set(t) & set(string.punctuation) for t in tokens)


def test_occurrences_and_snippets(spark):
    assert column(spark, ["aaaa", "", "xaax", None], lambda x: occurrences(x, "aa")) == [2, 0, 1, None]
    long = "x" * 200 + " needle here\nand " + "y" * 200
    found = column(spark, [long, "needle", "nothing at all", ""], lambda x: snippet(x, "needle"))
    assert found[0].startswith("...") and found[0].endswith("...") and "needle here and" in found[0] and len(found[0]) == 6 + 160 + 6
    assert found[1:] == ["needle", "nothing at all", ""]
    rows = spark.createDataFrame([("a\nb", "# H"), ("", "# H"), ("z" * 200, " "), (None, None)], "t string, h string")
    assert [r[0] for r in rows.select(chunk_snippet(F.col("t"), F.col("h"))).collect()] == ["# H: a b", "", "z" * 160 + "...", ""]


def test_names_and_paths(spark):
    assert column(spark, ["wiki/Entities/Foo-Bar.MD", " foo_bar ", "FOO bar", "a\\b c", None], text.ref_key) == ["foobar", "foobar", "foobar", "bc", None]
    assert column(spark, ["Missing page: Two  Words", "缺失页面：名字", "Plain"], text.review_key) == ["two words", "名字", "plain"]
    assert column(spark, ["/p/Raw/Sources/a/b.pdf", "raw/sources/x.md", "dir\\y.md"], text.source_identity) == ["a/b.pdf", "x.md", "y.md"]
    assert column(spark, ["dir/y.md"], lambda x: text.source_identity(x, True)) == ["dir/y.md"]
    assert column(spark, ["a.MD", "b.tar.gz", "Makefile", "c.svg"], text.file_category) == ["markdown", "unknown", "code", "code"]
    assert column(spark, ["a/.x.md", "a/.cache/b.md", "a/b.pdf", "a/b.png"], text.ingestable) == [False, False, True, False]
    assert column(spark, ["wiki/entities/a.md", "wiki/overview.md", "x/y.md"], text.type_from_path) == ["entity", "overview", None]
    assert column(spark, [0, 1023, 1024, 13568, 3 * 1024**3], text.format_bytes, "bigint") == ["0 B", "1023 B", "1.0 KB", "13.3 KB", "3.0 GB"]
    assert column(spark, ["wiki/a.md", "wiki/../a", "/wiki/a", "wiki/con.md", None], text.safe_page_path) == [True, False, False, False, False]
    assert column(spark, ["ab-1._", "", "a b", None], text.valid_page_id) == [True, False, False, False]
    assert column(spark, ["https://www.a.example:80/x", "http://u@ü.example", "nothing"], text.hostname) == ["a.example", "ü.example", None]
    assert column(spark, ["raw/a.md", "RAW/b.mx", "raw/c.txt"], lambda x: text.glob_match(x, "raw/*.m?")) == [True, True, False]
    watched = lambda x: text.watched(x, ("old",), ("*tmp*",), (".png",))
    seen = {"raw/sources/a.md": True, "raw/a.md": False, "raw/sources/old/a.md": False, "raw/sources/x/my-tmp1": False, "raw/sources/p.PNG": False, "wiki/a.md": True, "wiki/a.txt": False, "purpose.md": True, "wiki/media/a.md": False, ".store/a.md": False, "raw/sources/Thumbs.db": False, "raw/sources/noext": True, "": False}
    assert column(spark, list(seen), watched) == list(seen.values())
    assert column(spark, ["raw/sources/a.pdf", "raw/sources/a.md", "raw/sources/a", "wiki/b.md"], lambda x: text.watched(x, included_ext=(".md",))) == [False, True, False, True]
    refs = F.array(F.lit("/p/raw/sources/Papers/Intro.pdf"), F.lit("notes.md"), F.lit(None))
    assert column(spark, ["papers/intro.pdf", "other/intro.pdf", "NOTES.md", "intro.pdf", "b/notes.md"], lambda x: text.source_matches(x, refs)) == [True, False, True, False, False]
    assert column(spark, ["Hello, World!  Yes", "a--b"], text.clip_slug) == ["hello-world-yes", "a-b"]


def test_markdown(spark):
    page = '---\ntitle: "A title"\ntype: Entity\ntags: [a, "b c"]\nrelated:\n  - x\n  - y\n---\n# H\n[[A|b]] and [[ C ]] ![i](u.png) ![j](a b) ![k](u.png)\n## I\n'
    assert column(spark, [page, "no front", None], lambda x: text.scalar_field(text.frontmatter(x), "title")) == ["A title", None, None]
    assert column(spark, [page, ""], lambda x: text.list_field(text.frontmatter(x), "tags")) == [["a", "b c"], []]
    assert column(spark, [page], lambda x: text.list_field(text.frontmatter(x), "related")) == [["x", "y"]]
    assert column(spark, [page, "---\nopen"], text.strip_frontmatter)[1] == "---\nopen"
    assert column(spark, [page, "", None], text.wikilinks) == [["A", "C"], [], None]
    assert column(spark, [page], text.image_urls) == [["u.png"]]
    assert column(spark, [page], text.headings) == [["# H", "## I"]]
    gone = F.array(F.lit("a"))
    assert column(spark, ["[[A|b]] [[a]] [[B]] [[A|b]]"], lambda x: text.without_links(x, gone)) == ["b a [[B]] b"]


def test_greetings(spark):
    said = ["Hi!", "hello there", "你好啊。", "hi, what is x", "", None, "good morning ~"]
    assert column(spark, said, text.is_greeting) == [True, True, True, False, False, False, True]


def test_context_budget(spark):
    rows = spark.createDataFrame([(0,), (10_000,), (204_800,)], "x bigint")
    found = rows.select(*[c.alias(n) for n, c in text.context_budget("x").items()]).collect()
    assert tuple(found[0]) == tuple(found[2]) == (204_800, 30_720, 10_240, 102_400, 30_720)
    assert tuple(found[1]) == (10_000, 1_500, 500, 5_000, 5_000)


def test_language(spark):
    cases = {
        "これは日本語です漢字": "Japanese", "这是中文文本": "Chinese", "Это русский текст": "Russian", "هذا في العربية": "Arabic", "این برای است که پچ": "Persian",
        "Der Hund und die Katze": "German", "Le chat est une bête": "French", "El perro de los niños": "Spanish", "plain words": "English", "zażółć": "Polish", "": "English", "한국어 문장": "Korean",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "x string, expected string")
    for r in language.with_language(rows, "x").collect():
        assert r["language"] == r["expected"], r["x"]


def test_language_guard(spark):
    names = ["English", "Russian", "Greek", "Arabic", "Persian", "Hindi", "Japanese", "Korean", "German"]
    fits = lambda target: column(spark, names, lambda x: language.language_matches(F.lit("long enough to be judged"), x, target))
    assert fits("French") == [True, True, True, False, False, False, False, False, True]
    assert fits("Chinese") == [False, False, False, False, False, False, True, True, False]
    assert fits("Persian") == [False, False, False, False, True, False, False, False, False]
    assert column(spark, ["Arabic"], lambda x: language.language_matches(F.lit("  short      "), x, "English")) == [True]
    page = "---\ntitle: x\n---\nbody ```code``` and $$m$$ $n$ $5\nend"
    assert column(spark, [page, "", "x" * 2000], language.guarded_sample) == ["body  and   $5\nend", "", "x" * 1500]


def test_the_dialect_that_counts(spark):
    query = "What is e.g. the Graph-index 知识图谱?"
    assert counted_tokens(query) == ["e.g.", "graph", "index", "知识", "识图", "图谱", "谱?", "知", "识", "图", "谱", "?", "知识图谱?"] and counted_phrase('"a b"?!') == "a b"
    assert counted_tokens("the of") == ["the of"] and counted_tokens("") == []
    rows = spark.createDataFrame([("graph-index", "Graph index and graph", "x graph index graph index " + "y" * 300), ("a", "b", "c"), ("", "", "")], "s string, t string, b string")
    score = counted_score(F.col("s"), F.lower("t"), F.lower("b"), "graph index")
    assert [tuple(r) for r in rows.select(score["score"].alias("s"), score["title_match"].alias("m")).collect()] == [(200 + 3 * 5 + 4 + 50 + 40, True), (0.0, False), (0.0, False)]
    assert column(spark, ["z" * 100 + " graph\nx " + "y" * 300, "no hit", ""], lambda x: counted_snippet(x, "graph")) == ["z" * 59 + " graph x " + "y" * 132, "no hit", ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB _-\\/.md", max_size=12), min_size=1, max_size=8))
def test_ref_key_is_idempotent(spark, names):
    once = column(spark, names, text.ref_key)
    twice = column(spark, [x or "" for x in once], text.ref_key)
    assert all("md" in (a or "") or a == b for a, b in zip(once, twice))
