import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreweave.llm import near_duplicates as nd
from loreweave.llm import set_join, shingles
from loreweave.llm import vector_neighbours as vn


def word_set(text, n):
    words = re.findall("[a-z0-9]+", text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_texts(rows, sets, threshold):
    found = set()
    rows = {(k, t) for k, t in rows if k is not None and t is not None}
    for (k, t), (m, u) in itertools.combinations(sorted(rows), 2):
        a, b = sets(t), sets(u)
        if k != m and a and b and len(a & b) / len(a | b) >= threshold - 1e-12:
            found.add((min(k, m), max(k, m)))
    return found


def edited(rng, words, base, edits):
    base = list(base)
    for _ in range(edits):
        i = rng.randrange(len(base))
        if rng.random() < 0.5:
            base[i] = rng.choice(words)
        else:
            base.insert(i, rng.choice(words))
    return base


def texts(seed, count=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(count):
        base = rng.choices(words, k=rng.randrange(1, 40))
        for j in range(rng.choice([1, 1, 2, 4])):
            rows.append((f"k{i}-{j}", " ".join(edited(rng, words, base, j))))
    rows += [(f"h{i}", "hot text that many rows hold") for i in range(30)]
    rows += [("n1", None), (None, "hot text"), ("e1", ""), ("e2", "   "), ("one", "single"), ("é", "été été été"), ("long", " ".join(rng.choices(words, k=20000)))]
    rows += rows[:5]
    return rows


@pytest.mark.parametrize("shape", [nd.Shape(), nd.Shape("word", 2, 0.7), nd.Shape("word", 1, 0.5, fragments=3, bins=64), nd.Shape("word", 2, 0.7, crowd=3), nd.Shape("word", 1, 0.5, crowd=0), nd.Shape("char", 3, 0.7)])
def test_near_duplicates_against_brute_force(spark, shape):
    rows = texts(1)
    if shape.kind == "char":
        rows = [(k, None if t is None else t[:200].encode("ascii", "ignore").decode()) for k, t in rows]
    sets = (lambda t: word_set(t, shape.n)) if shape.kind != "char" else (lambda t: {t[i : i + shape.n] for i in range(len(t) - shape.n + 1)})
    df = spark.createDataFrame(rows, "key string, text string").withColumn("rid", F.lit(1)).withColumn("copies", F.lit("clash"))
    found = nd.near_duplicate_pairs(df, "key", "text", shape).collect()
    assert len(found) == len({(r["key_a"], r["key_b"]) for r in found})
    assert {(r["key_a"], r["key_b"]) for r in found} == brute_texts(rows, sets, shape.threshold)


def test_words_and_characters_of_all_scripts(spark):
    long_ru = "новая заметка сравнивает старую страницу и ссылку на проект"
    rows = [("r1", long_ru), ("r2", long_ru + "!"), ("r3", long_ru + " снова"), ("z1", "经过天缓存已经更新。没有段落"), ("z2", "经过天缓存已经更新没有段落了"), ("e1", "été à la plage, où naît"), ("e2", "ete a la plage ou nait")]
    found = {(r["key_a"], r["key_b"]) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, "key string, text string"), "key", "text").collect()}
    assert found == {("r1", "r2"), ("r1", "r3"), ("r2", "r3"), ("z1", "z2")}
    chars = {(r["key_a"], r["key_b"]) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, "key string, text string"), "key", "text", nd.Shape("char", 3, 0.7)).collect()}
    assert chars == brute_texts(rows, lambda t: {t[i : i + 3] for i in range(len(t) - 2)}, 0.7)


def test_candidates_beyond_the_filter_are_joined(spark, monkeypatch):
    rows = texts(2)
    df = spark.createDataFrame(rows, "key string, text string")
    monkeypatch.setattr(nd, "MARKS", 1)
    found = {(r["key_a"], r["key_b"]) for r in nd.near_duplicate_pairs(df, "key", "text", nd.Shape("word", 2, 0.7)).collect()}
    assert found == brute_texts(rows, lambda t: word_set(t, 2), 0.7)


def test_classes_count_their_links(spark):
    rows = [(f"k{i}", "a b c d e f g") for i in range(3)] + [("x", "a b c d e f g h"), ("y", "other words"), ("n", None)]
    found = {r["key"]: (r["class"], r["copies"], r["links"]) for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "key string, text string"), "key", "text", nd.Shape("word", 2, 0.7)).collect()}
    assert found == {"k0": ("k0", 3, 1), "k1": ("k0", 3, 1), "k2": ("k0", 3, 1), "x": ("x", 1, 1), "y": ("y", 1, 0)}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, text string")
    assert nd.near_duplicate_pairs(empty, "key", "text").count() == 0
    with pytest.raises(ValueError):
        nd.similar_classes(empty, "key", "text", nd.Shape("line"))


def test_classes_keep_copies_together(spark):
    rows = [(f"k{i}", "a b c d e f g") for i in range(50)] + [("x", "a b c d e f g h")]
    pairs, members, texts_ = nd.similar_classes(spark.createDataFrame(rows, "key string, text string"), "key", "text", nd.Shape("word", 2, 0.7))
    assert pairs.count() == 1 and members.count() == 51 and texts_.count() == 2


def test_groups_are_components_of_the_pairs(spark):
    rows = texts(5)
    df = spark.createDataFrame(rows, "key string, text string")
    shape = nd.Shape("word", 2, 0.7)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_texts(rows, lambda t: word_set(t, 2), 0.7):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["key"]: r["group"] for r in nd.near_duplicate_groups(df, "key", "text", shape).collect()}
    assert found == {x: root(x) for x in parent}


def test_gram_hashes_are_distinct():
    words = [f"{a}{b}" for a in "abcdefghij0123456789" for b in "klmnopqrst9876543210"]
    rows, grams = shingles.gram_sets(pa.array(words), "word", 1)
    assert len(set(grams.tolist())) == len(words) and rows.tolist() == list(range(len(words)))
    rows, grams = shingles.gram_sets(pa.array(["ab ab", "", "ab"]), "word", 1)
    assert rows.tolist() == [0, 2] and grams[0] == grams[1]
    parts = list(shingles.slices(pa.record_batch([pa.array(["x" * (3 << 20)] * 3)], ["t"]), "t"))
    assert [p.num_rows for p in parts] == [1, 1, 1] and shingles.gram_sets(pa.array([], pa.string()), "char", 3)[0].tolist() == []


# sets


def sets(seed):
    rng = random.Random(seed)
    values = [f"V {i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = rng.sample(values, rng.randrange(1, 14))
        for j in range(rng.choice([1, 2, 3])):
            own = [x for x in base if rng.random() > 0.05 * j] + rng.sample(values, j // 2)
            own = [x.lower().replace(" ", rng.choice([" ", "-", "_", ""])) if rng.random() < 0.5 else x for x in own]
            rows.append((f"k{i}-{j}", own + own[:1] + [None, " - "] * (j % 2)))
    rows += [(f"hot{i}", ["a", "b", "c", "d", "e"]) for i in range(25)]
    return rows + [("null", None), (None, ["a", "b", "c", "d"]), ("empty", []), ("few", ["a", "b", "c"])] + rows[:4]


def plain(values):
    return frozenset(x for x in (re.sub(r"[\s\-_]", "", v.lower()) for v in values or [] if v is not None) if x)


def as_table(spark, rows, grp, both, side=None):
    df = spark.createDataFrame([r for r in rows], "key string, raw array<string>").withColumn("size", F.lit("clash"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))) if side is None else F.lit(side)
    return df.select(F.lit(grp).alias("grp"), sides.alias("side"), F.lit(both).alias("both"), "key", set_join.normal_values("raw").alias("values"), "size")


@pytest.mark.parametrize("how", [set_join.Pivots(), set_join.Pivots(near=-1.0, crowd=1), set_join.Pivots(near=1.0, crowd=1), set_join.Pivots(near=0.1, bands=1), set_join.Pivots(crowd=2, threshold=0.5, min_size=1), set_join.Pivots(threshold=0.8, min_size=1)])
def test_similar_sets_against_brute_force(spark, how):
    rows = sets(3)
    found = set_join.similar_set_pairs(as_table(spark, rows, "g", True), how).collect()
    big = sorted({(k, plain(v)) for k, v in rows if k is not None and len(plain(v)) >= how.min_size}, key=repr)
    expected = {(min(k, m), max(k, m)) for (k, a), (m, b) in itertools.combinations(big, 2) if k != m and len(a & b) / len(a | b) >= how.threshold - 1e-12}
    assert {(r["key_a"], r["key_b"]) for r in found} == expected and len(found) == len(expected)


def test_similar_sets_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BROADCAST_ROWS", -1)
    rows = sets(4)
    found = set_join.similar_set_pairs(as_table(spark, rows, "g", True), set_join.Pivots(crowd=2)).collect()
    big = sorted({(k, plain(v)) for k, v in rows if k is not None and len(plain(v)) >= 4}, key=repr)
    assert {(r["key_a"], r["key_b"]) for r in found} == {(min(k, m), max(k, m)) for (k, a), (m, b) in itertools.combinations(big, 2) if k != m and len(a & b) / len(a | b) >= 0.7 - 1e-12}


def test_two_tables_and_groups(spark):
    one, two = [("p1", ["a", "b", "c", "d"]), ("p2", ["a", "b", "c", "x"])], [("q1", ["A", "B-", "c", "d"]), ("p1", ["z", "y", "x", "w"]), ("k1", ["a", "b", "c", "D"]), ("p2", ["a", "b", "c", "x"])]
    both = as_table(spark, one, "g", False, 0).unionByName(as_table(spark, two, "g", False, 1)).unionByName(as_table(spark, one, "h", True))
    found = {tuple(r) for r in set_join.similar_set_pairs(both, set_join.Pivots(threshold=0.6)).select("grp", "key_a", "key_b").collect()}
    assert found == {("g", "p1", "q1"), ("g", "p2", "q1"), ("g", "k1", "p1"), ("g", "k1", "p2"), ("g", "p1", "p2"), ("h", "p1", "p2")}
    assert set_join.similar_set_pairs(both.limit(0)).count() == 0


# vectors


def vectors(seed, n=400, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[: n // 2] + rng.normal(size=(n // 2, dim)) * rng.uniform(0.01, 0.45, size=(n // 2, 1))
    x = np.concatenate([base, near]) * rng.uniform(0.001, 1000, size=(n + n // 2, 1))
    return [(f"c{i:04}", [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


def brute_vectors(rows, k, least):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    found = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]:
            if s[i, j] >= least:
                found.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return found


def test_neighbours_recall(spark):
    rows = vectors(1)
    rows += [("null", None), ("zero", [0.0] * 64), ("short", [1.0] * 32), ("nan", [float("nan")] * 64), ("hole", [None] + [1.0] * 63), (None, [1.0] * 64)] + rows[:10]
    df = spark.createDataFrame(rows, "key string, v array<float>").withColumn("rid", F.lit("clash"))
    expected = brute_vectors(rows, 5, 0.9)
    found = {tuple(r) for r in vn.neighbour_pairs(df, "key", "v", k=5, min_similarity=0.9).collect()}
    assert len(expected) > 100 and len(found & expected) >= 0.95 * len(expected) and len(found - expected) <= 0.02 * len(found)


def test_hot_buckets_are_split_without_loss(spark):
    df = spark.createDataFrame(vectors(2, 120), "key string, v array<float>")
    how = vn.Hashing(tables=1, cuts=0, probes=1, part_rows=16)
    found = {(r["key"], r["neighbour"], r["rank"]) for r in vn.nearest_neighbours(df, "key", "v", k=4, how=how).collect()}
    whole = vn.Hashing(tables=1, cuts=0, probes=1)
    assert found == {(r["key"], r["neighbour"], r["rank"]) for r in vn.nearest_neighbours(df, "key", "v", k=4, how=whole).collect()}
    assert len(found) == 180 * 4
    assert {(min(a, b), max(a, b)) for a, b, _ in found} == brute_vectors(vectors(2, 120), 4, -1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # buckets go on over many batches
    try:
        assert found == {(r["key"], r["neighbour"], r["rank"]) for r in vn.nearest_neighbours(df, "key", "v", k=4, how=whole).collect()}
        assert found == {(r["key"], r["neighbour"], r["rank"]) for r in vn.nearest_neighbours(df, "key", "v", k=4, how=how).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_winners_within_the_rounding_error_are_kept(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + rng.normal(size=(500, 64)) * 0.07  # cosines of about 0.995
    rows = [(f"c{i:03}", [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    whole = vn.Hashing(tables=1, cuts=0, probes=1)
    found = vn.neighbour_pairs(spark.createDataFrame(rows, "key string, v array<float>"), "key", "v", k=5, how=whole).collect()
    assert {tuple(r) for r in found} == brute_vectors(rows, 5, -1)


@pytest.mark.parametrize("n", [300, 3000])
def test_recall_without_a_least_similarity(spark, n):
    rows = vectors(6, n)
    df = spark.createDataFrame(rows, "key string, v array<float>")
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = {i for i in ids if int(i[1:]) % 10 == 0}
    found = vn.nearest_neighbours(df, "key", "v", k=5, asks=F.substring("key", 2, 9).cast("int") % 10 == 0).collect()
    assert {r["key"] for r in found} == asked and len(found) == 5 * len(asked)
    hits = 0
    by = {(r["key"], r["neighbour"]) for r in found}
    for i in asked:
        near = x @ x[ids.index(i)]
        near[ids.index(i)] = -2
        hits += sum((i, ids[j]) in by for j in np.argsort(-near)[:5])
    assert hits >= 0.9 * 5 * len(asked)


def test_a_dense_group_is_cut_into_finer_cells(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(2000, 64)), rng.normal(size=64) + rng.normal(size=(1000, 64)) * 0.02])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    made = vn._Tables(vn.WIDE, unit, len(unit))
    for table in made.tables:
        names, level, _ = table.place(table.at(unit))
        assert np.unique(names, return_counts=True)[1].max() <= 55 and level[2000:].min() > level[:2000].min() and not len(table.split)
    rows = [(f"c{i:04}", [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    dense = spark.createDataFrame(rows, "key string, v array<float>")
    found = vn.nearest_neighbours(dense, "key", "v", k=5, asks=F.col("key") >= "c2900").select("key", "neighbour").collect()
    near = unit[2900:] @ unit.T
    near[np.arange(100), np.arange(2900, 3000)] = -2
    by = {tuple(r) for r in found}
    assert sum((f"c{2900 + i:04}", f"c{j:04}") in by for i in range(100) for j in np.argsort(-near[i])[:5]) >= 450


@pytest.mark.parametrize("block", [32_768, 100])
def test_exact_neighbours_below_the_hashing(spark, block):
    rows = vectors(4, 300)
    rows += [("null", None), ("zero", [0.0] * 64), ("short", [1.0] * 32)] + [(f"d{i}", rows[i][1]) for i in range(8)] + rows[:5]
    found = vn.exact_neighbours(spark.createDataFrame(rows, "key string, v array<float>"), "key", "v", k=5, block=block).collect()
    assert len(found) == 5 * 458 and min(r["similarity"] for r in found) < 0.6
    assert {(min(r["key"], r["neighbour"]), max(r["key"], r["neighbour"])) for r in found} == brute_vectors(sorted(set((k, tuple(v) if v else None) for k, v in rows), key=repr), 5, -1)


def test_copies_are_neighbours(spark):
    same = [1.0] * 64
    rows = [(f"s{i}", same) for i in range(9)] + [("t", [1.0] * 63 + [1.1])]
    found = vn.nearest_neighbours(spark.createDataFrame(rows, "key string, v array<float>"), "key", "v", k=3, min_similarity=0.5)
    by = {}
    for r in found.orderBy("key", "rank").collect():
        by.setdefault(r["key"], []).append(r["neighbour"])
    assert by["s0"] == ["s1", "s2", "s3"] and by["s8"] == ["s0", "s1", "s2"] and by["t"] == ["s0", "s1", "s2"] and len(by) == 10
    assert vn.nearest_neighbours(spark.createDataFrame([], "key string, v array<float>"), "key", "v").count() == 0


def test_probe_order():
    found = vn.probe_sets(4, 12)
    assert found[0] == (0,) and len(set(found)) == 12 and all(7 - r not in s for s in found for r in s)


def test_rounding_stays_within_slack():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64)) * rng.exponential(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    packed = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True)))
    packed /= np.linalg.norm(packed, axis=1, keepdims=True)
    assert np.abs(packed @ packed.T - x @ x.T).max() < vn.SLACK
