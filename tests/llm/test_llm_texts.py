import itertools
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreweave.llm import mixing, splitting, tokens, visual_forms

# splitting

OPTIONS = {"target_chars": 60, "max_chars": 80, "min_chars": 10, "overlap_chars": 15}
DOC = "---\ntitle: x\n---\nintro text\n# One\n" + "A sentence here. " * 12 + "\n\n```py\n# no heading\n" + "code line\n" * 12 + "```\n## Two\n| a | b |\n| - | - |\n" + "| c | d |\n" * 9 + "| lone\nend " + "x" * 300


def split(spark, rows, options=OPTIONS):
    df = spark.createDataFrame(rows, "item bigint, body string").withColumn("text", F.lit("clash")).withColumn("blocks", F.lit(1))
    return splitting.split_texts(df, "item", "body", {k: F.lit(v) for k, v in options.items()})


def test_pieces_cover_the_body_and_keep_the_limit(spark):
    found = split(spark, [(1, DOC)]).orderBy("start_char").collect()
    at = DOC.index("intro")
    for r in found:
        assert r["text"] == DOC[r["start_char"] : r["end_char"]]
        assert r["start_char"] <= at < r["end_char"]
        at = r["end_char"]
        assert len(r["text"]) <= 80 or r["is_block"] and r["oversized"]
    assert at == len(DOC)
    assert [DOC[r["start_char"] : r["start_char"] + 3] for r in found if r["oversized"]] == ["```", "| a"]
    assert {r["heading_path"] for r in found} == {"", "# One", "# One > ## Two"}
    shared = [a["end_char"] - b["start_char"] for a, b in zip(found, found[1:]) if a["section_start"] == b["section_start"] and not b["is_block"]]
    assert max(shared) <= 15 and sum(s > 3 for s in shared) >= 3


def test_oversized_places(spark):
    found = {(r["kind"], DOC[r["start_char"] :][:5]) for r in splitting.oversized_places(split(spark, [(1, DOC), (1, DOC)]), "item").collect()}
    assert found == {("block", "```py"), ("block", "| a |"), ("section", "# One"), ("section", "## Tw")}


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "\r\n# A\r\nb"), (5, "字" * 500), (6, "```\nopen\n" * 1 + "y" * 200), (7, "---\nnot closed\n# B\n")]
    found = {}
    for r in split(spark, rows).collect():
        found.setdefault(r["item"], []).append(r)
    assert set(found) == {3, 4, 5, 6, 7}
    assert sum(len(r["text"]) for r in found[5]) >= 500 and all(len(r["text"]) <= 80 for r in found[5])
    assert [r["oversized"] for r in found[6]] == [True]
    assert split(spark, [(1, "a b")], {"max_chars": 0, "target_chars": 5, "min_chars": 0, "overlap_chars": 9}).count() == 3
    assert split(spark, []).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# h\n", "``` \n", "```\n", "~~~~\n", "| a\n", "\n", "word. ", "x" * 30, " ", "\r\n", "---\n", "字。"]), max_size=25).map("".join))
def test_sections_partition_the_body(text):
    parts = list(splitting.sections(text))
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and (not parts or parts[-1][1] == len(text))
    for start, end, _, blocks in parts:
        cut = splitting.pieces(text[start:end], [(a - start, b - start, k) for a, b, k in blocks], 20, 30, 5, 8)
        at = 0
        for a, b, block in cut:
            assert a <= at < b and (b - a <= 30 or block)
            at = b
        assert at == end - start
        assert all(text[a:b].startswith(("```", "~~~", "|")) for a, b, _ in blocks)


# tokens


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(tokens.VOCABULARY)
    made.encode_special_tokens = True
    return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def test_encoding_equals_the_reference_tokenizer(spark, reference):
    rng = random.Random(1)
    odd = ["aaaa" * 40, "a" * 3001, " " * 50 + "x", "<|endoftext|>", "\n\n \t", "été 字字字", "👩‍🔬", "it's we'll 'S", "\x00\x85　x", "1234567 ½²"]
    mixed = ["".join(rng.choice("ab  cé字1.,\n'st") for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(odd + mixed)] + [(900, None), (901, ""), (900, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    found = [(r["doc_id"], list(r["ids"])) for r in tokens.encode(df, "doc_id", "text").collect()]
    expected = [(i, ids) for (i, _), ids in zip(rows, reference([t or "" for _, t in rows]))]
    assert sorted(found) == sorted(expected)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_documents_equal_the_reference_tokenizer(spark, sf, reference):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(df, "doc_id", "text").collect()}
    rows = df.select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert found == dict(zip([r[0] for r in rows], reference([r[1] for r in rows])))
    counted = tokens.count_tokens(df.select("doc_id", "text"), "text", "n").collect()
    assert all(r["n"] == len(found[r["doc_id"]]) for r in counted)


# mixing


def test_schedule_stays_within_a_block():
    for shares in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.06, "c": 0.03, "d": 0.01}, {"a": 1.0}):
        slots = mixing.quotas(shares, 100)
        assert sum(slots.values()) == 100
        sent = dict.fromkeys(slots, 0)
        for slot, (source, block, at) in enumerate(sorted(mixing.schedule(slots), key=lambda x: x[2]), 1):
            assert at == slot - 1 and block == sent[source]
            sent[source] += 1
            assert all(abs(n - slot * slots[s] / 100) < 1 for s, n in sent.items())
    assert mixing.quotas({"a": 1e-9, "b": 1.0}, 10) == {"a": 1, "b": 9}


def mixed(spark, rows, targets, **how):
    df = spark.createDataFrame(rows, "doc bigint, source string, n bigint").withColumn("slot", F.lit("clash")).withColumn("have", F.lit(1))
    goal = spark.createDataFrame(targets, "source string, share double, repeats int")
    found, report = mixing.mix_sources(df, "doc", "source", "n", goal, mixing.Mix(**how))
    return found.collect(), {r["source"]: r for r in report.collect()}


def test_mix_reaches_the_shares(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Big", " big ", "BIG"]), rng.randrange(1, 50)) for i in range(3000)]
    rows += [(5000 + i, "small_one", rng.randrange(1, 50)) for i in range(100)] + [(9000, None, 5), (9001, "other", 7), (9002, "big", 0), (9003, "big", None)]
    found, report = mixed(spark, rows, [("big", 0.7, 1), ("small-one", 0.2, 4), ("none", 0.1, 2)], block=200, period=100, bucket_rows=50)
    assert report["none"]["reached_share"] == 0 and abs(report["big"]["reached_share"] - 7 / 9) < 0.01 and abs(report["small-one"]["reached_share"] - 2 / 9) < 0.01
    assert report["small-one"]["max_copies"] == 4 and report["big"]["max_copies"] == 1
    uses = {}
    for r in found:
        uses.setdefault(r["doc"], []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in uses.values()) and not uses.keys() & {9000, 9001, 9002, 9003}
    seen, total = dict.fromkeys(report, 0), 0
    for r in sorted(found, key=lambda r: (r["slot"], r["place"])):
        seen[r["source"]] += r["size"]
        total += r["size"]
        # a block, the last document's excess, and the rounding of the weights to the period
        assert abs(seen["big"] - total * report["big"]["reached_share"]) <= 200 + 50 + 0.01 * total


def test_mix_to_a_total(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 10) for i in range(20)]
    found, report = mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 3)], total=4000)
    assert report["b"]["size"] == 600 and report["b"]["max_copies"] == 3 and abs(report["a"]["size"] - 3400) <= 10
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixed(spark, rows, [])[0] == []


# visual forms

SAME = [
    ("ｅ́clair ﬁn", "éclair fin"), ("ａｂｃ！", "abc!"), ("ﾊﾞｽ", "バス"), ("한국", unicodedata.normalize("NFD", "한국")), ("a b　c", "a b c"), ("wо​rd", "word"),
    ("ậ", "ậ"), ("Ёлка", "Ёлка"), ("ΑΒΕ", "ABE"), ("soft­hyphen", "softhyphen"), ("Å", "Å"),
]
DIFFERENT = [("a", "A"), ("x2", "x²"), ("e", "é"), ("1", "l"), ("a b", "a  b"), ("1", "①"), ("n", "ñ"), ("TM", "™"), ("...", "…"), ("👩‍🔬", "👩🔬"), ("a\nb", "a b")]


def test_forms(spark):
    rows = [(i, t) for i, t in enumerate(itertools.chain.from_iterable(SAME + DIFFERENT))] + [(1000, None), (1001, ""), (1002, "​­")]
    df = spark.createDataFrame(rows, "doc bigint, body string").withColumn("part", F.lit("clash")).withColumn("text", F.lit(1)).withColumn("form", F.lit(2))
    form = {r["doc"]: r["form"] for r in visual_forms.visual_forms(df, "doc", "body").collect()}
    for i, (a, b) in enumerate(SAME + DIFFERENT):
        assert (form[2 * i] == form[2 * i + 1]) == (i < len(SAME)), (a, b)
    assert (form[1000], form[1001], form[1002]) == (None, "", "")
    again = spark.createDataFrame(sorted((k, v) for k, v in form.items() if v is not None), "doc bigint, body string")
    assert all(r["form"] == r["body"] for r in visual_forms.visual_forms(again, "doc", "body").collect())


def test_forms_of_ordinary_characters_are_composed(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x17F), *range(0x1EA0, 0x1EF0), *range(0x3041, 0x3090), *range(0x4E00, 0x4E50), *range(0xAC00, 0xAC40))]
    letters = [c for c in letters if "LIGATURE I" not in unicodedata.name(c, "")]
    rows = [(i, "".join(rng.choices(letters, k=30))) for i in range(50)]
    apart = [(100 + i, unicodedata.normalize("NFD", t)) for i, t in rows]
    form = {r["doc"]: r["form"] for r in visual_forms.visual_forms(spark.createDataFrame(rows + apart, "doc bigint, body string"), "doc", "body").collect()}
    for i, text in rows:
        assert form[i] == form[100 + i] == text


def test_alike_pairs(spark):
    rows = [(1, "word"), (2, "wоrd"), (3, "word"), (4, "ｗord"), (5, "Word"), (6, "​"), (7, ""), (8, None), (9, "x" * 10_000 + "а"), (10, "x" * 10_000 + "a")]
    found = {tuple(r) for r in visual_forms.alike_pairs(spark.createDataFrame(rows, "doc bigint, body string"), "doc", "body").collect()}
    assert found == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (9, 10)}
    assert visual_forms.alike_pairs(spark.createDataFrame([], "doc bigint, body string"), "doc", "body").count() == 0


def test_many_marks_are_quick(spark):
    text = "z" + "́" * 5000 + "̣" * 5000
    form = visual_forms.visual_forms(spark.createDataFrame([(1, text)], "doc bigint, body string"), "doc", "body").first()["form"]
    assert len(form) >= 10_000 and re.fullmatch("ẓ̣*́+", form)


def test_look_alikes_of_three_scripts(spark):
    twins = "æӕ ÆӔ əә ƏӘ cϲ jϳ yү ʒӡ ΣƩ εɛ μµ αɑ вʙ".split()
    rows = [(f"{i}-{j}", "be" + c + "1") for i, pair in enumerate(twins) for j, c in enumerate(pair)]
    found = {(r["key_a"], r["key_b"]) for r in visual_forms.alike_pairs(spark.createDataFrame(rows, "key string, text string"), "key", "text").collect()}
    assert found == {(f"{i}-0", f"{i}-1") for i in range(len(twins))}


def test_forms_of_odd_and_settled_texts(spark):
    rows = [(i, f"сloud {i}\u00a0\uff21bc  e\u0301te\u0301 か\u3099，経過 " * 3) for i in range(40)] + [(90, None), (91, ""), (92, "plain ascii"), (93, "\u0301x"), (94, "x" * 100_000 + "\u200b")]
    df = spark.createDataFrame(rows, "key int, text string")
    formed = {r["key"]: r["form"] for r in visual_forms.visual_forms(df, "key", "text").collect()}
    assert formed[7] == "cloud 7 Abc  été が,経過 " * 3 and formed[90] is None and formed[91] == "" and formed[92] == "plain ascii" and formed[94] == "x" * 100_000


def test_no_piece_lies_within_the_next(spark):
    text = "# H\n" + "\n\n".join("word " * n for n in (3, 20, 2, 25, 1, 30)) * 3
    for overlap in (0, 40, 70, 79):
        sizes = {"target_chars": 100, "max_chars": 160, "min_chars": 10, "overlap_chars": overlap}
        found = split(spark, [(1, text)], sizes).orderBy("start_char", "end_char").collect()
        assert all(a["start_char"] < b["start_char"] and a["end_char"] < b["end_char"] and b["start_char"] <= a["end_char"] for a, b in zip(found, found[1:]))
        assert all(len(r["text"]) <= 160 for r in found) and found[-1]["end_char"] == len(text)


def test_more_sources_than_slots_and_the_deviation(spark):
    rows = [(i, f"s{i % 150}", 100 + i % 7) for i in range(1500)]
    targets = spark.createDataFrame([(f"s{i}", 1.0 / 150, 1) for i in range(150)], "source string, share double, repeats int")
    how = mixing.Mix(block=200, period=100, bucket_rows=3)
    mixed, report = mixing.mix_sources(spark.createDataFrame(rows, "doc int, source string, size int"), "doc", "source", "size", targets, how)
    assert mixed.count() >= 1300 and report.where("size > 0").count() == 150
    few = targets.where("source in ('s0', 's1', 's2')").withColumn("share", F.when(F.col("source") == "s0", 0.5).otherwise(0.25))
    many = spark.createDataFrame([(i, f"s{i % 3}", 50 + i % 11) for i in range(3000)], "doc int, source string, size int")
    plain = mixing.Mix(block=200, period=100)
    off = mixing.schedule_deviation(mixing.mix_sources(many, "doc", "source", "size", few, plain)[0], plain).collect()
    assert len(off) == 3 and all(r["deviation"] < 1 and r["longest"] < 1 for r in off)
