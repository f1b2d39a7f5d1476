from pyspark.sql import functions as F

from loreweave.functions import ingest as fn


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
    return row.select(column.alias("r")).first()["r"]


def blocks(spark, text):
    return [tuple(b) for b in one(spark, fn.file_blocks("t"), t=text)]


def test_file_blocks(spark):
    assert blocks(spark, "chat\n---FILE: wiki/a.md---\r\nx\n```\n---END FILE---\n```\ny\n---END FILE---\nrest") == [("wiki/a.md", "x\n```\n---END FILE---\n```\ny", "ok")]
    assert blocks(spark, "--- file: wiki/b.md ---\n---FILE: wiki/c.md---\n--- end  file ---") == [("wiki/b.md", "---FILE: wiki/c.md---", "ok")]
    assert blocks(spark, "---FILE: wiki/b.md---\n~~~~\n~~~\n---END FILE---\n") == [("wiki/b.md", "~~~~\n~~~\n---END FILE---\n", "unclosed")]
    for path in ("../x.md", "wiki/con.md", "wiki/a/../b", "/wiki/a", "wiki//a", "wiki/a. ", "C:\\a", "wiki/a?", "raw/a.md", "wiki/"):
        assert blocks(spark, f"---FILE: {path}---\n---END FILE---")[0][1:] == ("", "unsafe path"), path
    assert blocks(spark, "---FILE: wiki\\a.md---\n\n---END FILE---") == [("wiki\\a.md", "", "ok")]
    assert blocks(spark, "") == [] and one(spark, fn.file_blocks("t"), t=None) is None


def test_review_and_lint_blocks(spark):
    text = "---REVIEW: Missing-Page | A | b ---\nwhy\nPAGES: a.md, , b.md\nOPTIONS: Yes | No\nOPTIONS: kept\n---END REVIEW---\n---REVIEW: odd | T---\n---END REVIEW---"
    first, second = one(spark, fn.review_blocks("t"), t=text)
    assert tuple(first) == ("missing-page", "A | b", "why\n\n\nOPTIONS: kept", ["Yes", "No"], ["a.md", "b.md"], None)
    assert tuple(second) == ("confirm", "T", "", ["Approve", "Skip"], None, None)
    lint = one(spark, fn.lint_blocks("t"), t="---LINT: Stale | loud | Old page---\nIt is old.\nPAGES: a.md\n---END LINT---")
    assert [tuple(x) for x in lint] == [("info", "Old page", "[stale] It is old.", ["a.md"])]


def test_repairs(spark):
    page = "---\nrelated: [[a]], [[b c]]\ntitle: x\n---\nbody [[a]], [[b]]\n"
    mended = "---\nrelated: [\"[[a]]\", \"[[b c]]\"]\ntitle: x\n---\nbody [[a]], [[b]]\n"
    for spoilt in (page, "```yaml\n" + page + "\n```\n", "frontmatter:\n" + page):
        assert one(spark, fn.sanitised("t"), t=spoilt).rstrip("\n") == mended.rstrip("\n")
    assert one(spark, fn.sanitised("t"), t="```py\nx\n```") == "```py\nx\n```" and one(spark, fn.sanitised("t"), t="") == ""
    place = lambda t: tuple(one(spark, fn.located_frontmatter("t"), t=t))
    assert place("---\na: 1\n---\nb") == ("start", "a: 1", "b")
    assert place("Sure:\n---\na: 1\n---\nb") == ("later", "a: 1", "b")
    assert place("```yml\n---\na: 1\n---\n```\nb") == ("fenced", "a: 1", "b")
    assert place("1\n2\n3\n4\n5\n6\n---\na: 1\n---\nb")[0] is None and place("")[2] == ""


def test_fields_and_merge(spark):
    page = "---\ntitle: New\ntags:\n  - b\n  - C\n---\nshort"
    assert one(spark, fn.write_list("t", "tags", F.array(F.lit("x"), F.lit('y "z"'))), t=page) == '---\ntitle: New\ntags: ["x", "y \\"z\\""]\n---\nshort'
    assert one(spark, fn.write_list("t", "sources", F.array()), t="no front") == "no front"
    old = '---\ntitle: "Old"\ntype: entity\ntags: [c, a]\ncreated: 2020-01-01\n---\n' + "long body " * 10
    good = "---\ntitle: Other\ntype: query\n---\n" + "long body " * 9
    rows = [("first", page, None, good), ("same", page, page, good), ("body", page, page.replace("b\n", "q\n"), good), ("model", page, old, good), ("short", page, old, "---\ntitle: x\n---\nshort"), ("bare", page, old, "long body " * 20), ("none", page, old, None)]
    made = fn.merge_pages(spark.createDataFrame(rows, "k string, n string, o string, m string"), "n", "o", "m", "2026-01-01", "page")
    found = {r["k"]: r["page"] for r in made.collect()}
    united = '---\ntitle: New\ntags: ["c", "a", "b"]\n---\nshort'
    assert found["first"] == page and found["same"] == page and found["body"] == '---\ntitle: New\ntags: ["q", "C", "b"]\n---\nshort'
    assert found["short"] == found["bare"] == found["none"] == united
    assert all(x in found["model"] for x in ("title: Old\n", "type: entity\n", 'tags: ["c", "a", "b"]', "created: 2020-01-01\n", "updated: 2026-01-01\n"))


def test_answers(spark):
    answer = 'Sure {not json: "}" }'
    assert one(spark, fn.json_object("t"), t=answer) == '{not json: "}" }' and one(spark, fn.duplicate_answer("t"), t=answer) == []
    assert one(spark, fn.json_object("t"), t='x {"a": {"b": "\\"}"}} y {') == '{"a": {"b": "\\"}"}}' and one(spark, fn.json_object("t"), t="{ open") is None and one(spark, fn.json_object("t"), t="") is None
    groups = one(spark, fn.duplicate_answer("t"), t='```json\n{"groups": [{"slugs": ["a", "b"], "confidence": "high"}, {"slugs": ["c"]}, {"slugs": ["d", "e"], "reason": "r", "confidence": "sure"}]}\n```')
    assert [tuple(g) for g in groups] == [(["a", "b"], "", "high"), (["d", "e"], "r", "low")]
    assert one(spark, fn.reasoning_chars("t"), t='data: {"reasoning": "ab\\n"}\ndata: {"reasoning_content":"c"}{"x":"y"}') == 5


def test_linked_terms(spark):
    links = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("target")) for a, b in (("Ada", "ada-l"), ("ada-l", "ADA-L"), ("Bob", "bob"), ("Gone", "gone"), ("cat", "Cat"))])
    text = "---\ntitle: Ada Bob\n---\n[[Ada]] and Ada, Ada; [see] Bob cat"
    assert one(spark, fn.linked_terms("t", links), t=text) == "---\ntitle: Ada Bob\n---\n[[Ada]] and [[ada-l|Ada]], Ada; [see] [[Bob]] [[cat]]"
    assert one(spark, fn.linked_terms("t", links), t="") == "" and one(spark, fn.linked_terms("t", links), t="Bob") == "[[Bob]]"


def test_routes_and_sources(spark):
    assert [one(spark, fn.write_route("p"), p=p) for p in ("wiki/log.md", "wiki/a/index.md", "wiki/overview.md", "wiki/a.md", "mylog.md")] == ["append", "overwrite", "overwrite", "merge", "merge"]
    df = spark.createDataFrame([(["A\\x.pdf", "X.PDF", None, "b.md"],), (None,)], "s array<string>")
    assert [r["r"] for r in df.select(fn.canonical_sources(F.col("s"), F.lit("a/x.pdf")).alias("r")).collect()] == [["a/x.pdf", "b.md"], ["a/x.pdf"]]
