from pyspark.sql import functions as F

from loreweave.functions import pages


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def fnv(text):
    value = 0x811C9DC5
    coded = text.encode("utf-16-be")
    for i in range(0, len(coded), 2):
        value = (value ^ int.from_bytes(coded[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
    return value


def test_slugs(spark):
    texts = ["", "a", "papers/intro.pdf", "😀é"]
    assert column(spark, [*texts, None], pages.stable_hash) == [*map(fnv, texts), None]
    found = column(spark, ["intro.pdf", "a b/c*.md", "", "x/" + "y" * 300 + ".md"], pages.summary_slug)
    assert found[0] == "intro" and found[1].startswith("5-a%20b--4-c%2A--") and found[2] == "source"
    assert len(found[3]) <= 120 and found[3].startswith("1-x--300-yyy")


def test_set_scalar(spark):
    rows = ["---\ntype: a\ntitle: t\n---\nbody\n", "---\ntitle: t\n---\nbody", "no front", "---\ntype: a\r\n---\nb"]
    found = column(spark, rows, lambda x: pages.set_scalar(x, "type", F.lit("$1\\b")))
    assert found == ["---\ntype: $1\\b\ntitle: t\n---\nbody\n", "---\ntitle: t\ntype: $1\\b\n---\nbody", "no front", "---\ntype: $1\\b\r\n---\nb"]
    assert column(spark, found, lambda x: pages.set_scalar(x, "type", F.lit("$1\\b"))) == found


def test_links_and_listings(spark):
    text = "[[a|b]] `[[c]]` [[d]]\n```\n[[e]]\n``` [[f]]"
    assert column(spark, [text, ""], pages.linked_markdown) == ["[b](#a) `[[c]]` [d](#d)\n```\n[[e]]\n``` [f](#f)", ""]
    listing = "# Index\n- [[Foo Bar|x]] y\n* [[keep]] [[foo-bar]]\ntext [[foo bar]]"
    gone = F.array(F.lit("foobar"))
    assert column(spark, [listing], lambda x: pages.clean_listing(x, gone)) == ["# Index\n* [[keep]] [[foo-bar]]\ntext [[foo bar]]"]


def test_summary_and_predicates(spark):
    page = "---\ntitle: T\ntags: [a, b]\n---\n# H\n\nFirst words.\nmore"
    found = column(spark, [page, "plain", None], lambda x: pages.entity_summary(x, F.lit("s")))
    assert tuple(found[0]) == ("s", "unknown", "T", "First words.", ["a", "b"]) and found[1:] == [None, None]
    paths = {"raw/a.md": False, "wiki/a.md": True, "b/wiki/c.md": False, "a/.hidden": True, ".b/c.md": False, "x/my-secrets.md": False, "x/data.JSON": True, ".store/x.md": True, "raw/sources/.cache/x.md": True, "json": False}
    assert column(spark, [*paths, None], lambda x: pages.import_skipped(x, F.lit(1))) == [*paths.values(), False]
    assert column(spark, ["a.md"], lambda x: pages.import_skipped(x, F.lit(100 * 1024 * 1024 + 1))) == [True]
    said = ["Input too long", "max_tokens is 5", "it exceeds", "Input length 9", "timeout", None]
    assert column(spark, said, lambda x: pages.oversize_error(F.lit(400), x)) == [True, True, True, True, False, False]
    assert column(spark, ["any", None], lambda x: pages.oversize_error(F.lit(413), x)) == [True, True]
