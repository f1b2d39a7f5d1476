import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import graph, maintain, search
from loreweave.operators.snapshots import assign_ordinals, snapshot_changes
from loreweave.storage import materialize


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# search


def test_page_blend_goldens(spark):
    rows = [("a", 0.9), ("a", 0.5), ("b", 0.88), ("c", 0.5), ("c", 0.1), ("c", 0.1)]
    found = search.blended_pages(spark.createDataFrame(rows, "page_id string, score double"))
    assert {r["page_id"]: round(r["score"], 9) for r in found.collect()} == {"a": 1.0, "b": 0.88, "c": 0.56}


def test_fusion_goldens(spark):
    keyword = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 1.0)], "page_id string, score double")
    vector = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3)], "page_id string, rank int")
    found = {r["page_id"]: r for r in search.fused(keyword, vector, 3).collect()}
    assert math.isclose(found["a"]["score"], 2 / 61) and math.isclose(found["c"]["score"], 1 / 63 + 1 / 62)
    assert found["b"]["keyword_rank"] == 2 and found["b"]["vector_rank"] == 0


def test_fusion_finds_low_keyword_ranks(spark):
    keyword = spark.createDataFrame([(f"p{i:03}", float(1000 - i)) for i in range(300)], "page_id string, score double")
    vector = spark.createDataFrame([("p299", 1)], "page_id string, rank int")
    best = search.fused(keyword, vector, 1).first()
    assert best["page_id"] == "p299" and best["keyword_rank"] == 300


def test_keyword_hits_with_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "s", None, None), (2, "sparse", "x", "sparse index"), (3, "t", "Sparse index", "")], "key int, stem string, title string, content string")
    found = {r["key"]: r["score"] for r in search.keyword_hits(pages, "sparse index").collect()}
    # the title text holds the stem too
    assert found == {2: 20 + 5 + 2, 3: 50 + 10}
    assert search.keyword_hits(pages.limit(0), "sparse").count() == 0
    assert search.keyword_hits(pages, "").count() == 0


def test_nearest_chunks_skips_unsound_vectors(spark):
    schema = "chunk_id string, page_id string, chunk_index int, chunk_text string, heading_path string, embedding array<float>"
    rows = [("a", "p", 0, "", "", [1.0, 0.0]), ("a", "p", 0, "", "", [1.0, 0.0]), ("b", "p", 1, "", "", [0.0, 0.0]), ("c", "p", 2, "", "", [1.0]), ("d", "p", 3, "", "", None), ("e", "p", 4, "", "", [float("nan"), 1.0])]
    found = search.nearest_chunks(spark.createDataFrame(rows, schema), [1.0, 0.0], 5)
    assert values(found, "chunk_id", "score") == [("a", 1.0), ("b", 0.5)]
    assert values(search.best_chunks(found, 1), "chunk_id") == [("a",)]


# graph


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, type string, sources array<string>")


def test_link_resolution(spark):
    nodes = nodes_of(spark, [("foo-bar", "t", "entity", None), ("Foo_Bar", "t", "entity", None), ("baz", "t", None, None)])
    links = spark.createDataFrame([("baz", "foo-bar"), ("baz", "foo bar"), ("baz", "Baz"), ("baz", "none"), ("baz", None)], "src string, raw string")
    found = {r["raw"]: r["dst"] for r in graph.resolve_links(nodes, links).collect()}
    assert found == {"foo-bar": "foo-bar", "foo bar": "Foo_Bar", "Baz": "baz", "none": None, None: None}
    assert values(graph.directed(graph.resolve_links(nodes, links))) == [("baz", "Foo_Bar"), ("baz", "foo-bar")]


def random_graph(spark, seed, n=30, m=80):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})
    edges = [(a, b) for a, b in edges if a != b] + [("n00", f"n{i:02}") for i in range(1, n)]
    kinds = ["entity", "concept", "source", "query", "synthesis", "other", None]
    rows = [(f"n{i:02}", f"t{i}", rng.choice(kinds), rng.sample(["s1", "s2", "s3", None], rng.randrange(4))) for i in range(n)]
    return rows, sorted(set(edges)), nodes_of(spark, rows), spark.createDataFrame(sorted(set(edges)), "src string, dst string")


def test_relevance_against_brute_force(spark):
    rows, edges, nodes, links = random_graph(spark, 3)
    pairs = sorted({(min(e), max(e)) for e in edges})
    near = {r[0]: set() for r in rows}
    degree = dict.fromkeys(near, 0)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
        degree[a] += 1
        degree[b] += 1
    about = {r[0]: r for r in rows}
    found = {(r["a"], r["b"]): r["relevance"] for r in graph.relevance(spark.createDataFrame(pairs, "a string, b string"), nodes, links).collect()}
    assert set(found) == set(pairs)
    for a, b in pairs:
        direct = ((a, b) in edges) + ((b, a) in edges)
        shared = len((set(about[a][3]) & set(about[b][3])) - {None})
        common = sum(1 / math.log(max(degree[x], 2)) for x in near[a] & near[b])
        kind = graph.AFFINITY.get(about[a][2], {}).get(about[b][2], 0.5)
        assert math.isclose(found[a, b], 3 * direct + 4 * shared + 1.5 * common + kind, abs_tol=1e-9)


def test_related_nodes_without_a_link_against_brute_force(spark, monkeypatch):
    rows, edges, nodes, links = random_graph(spark, 7, 40, 50)
    edges = [e for e in edges if "n00" not in e]  # without the hub some nodes have few others with a signal
    links = spark.createDataFrame(edges, "src string, dst string")
    near = {r[0]: set() for r in rows}
    degree = dict.fromkeys(near, 0)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
        degree[a] += 1
        degree[b] += 1
    about = {r[0]: r for r in rows}

    def score(a, b):
        direct = ((a, b) in edges) + ((b, a) in edges)
        shared = len((set(about[a][3]) & set(about[b][3])) - {None})
        common = sum(1 / math.log(max(degree[x], 2)) for x in near[a] & near[b])
        return 3 * direct + 4 * shared + 1.5 * common + graph.AFFINITY.get(about[a][2], {}).get(about[b][2], 0.5)

    expected = {}
    for a in near:
        best = sorted((b for b in near if b != a), key=lambda b: (-round(score(a, b), 6), b))[:5]
        expected |= {(a, i + 1): (b, round(score(a, b), 6)) for i, b in enumerate(best)}
    assert any(b not in near[a] for (a, _), (b, _) in expected.items())
    assert any(s <= 1.2 for _, s in expected.values())  # affinity alone
    for size in (10, 1_000_000):  # keys in many parts, and in one
        monkeypatch.setattr(graph, "MEET_ROWS", size)
        found = graph.related_nodes(nodes, nodes, links).collect()
        assert {(r["id"], r["rank"]): (r["other"], round(r["relevance"], 6)) for r in found} == expected and len(found) == 200
    asked = graph.related_nodes(nodes.where("id in ('n03', 'n04')"), nodes, links).collect()
    assert {(r["id"], r["rank"]): r["other"] for r in asked} == {k: v[0] for k, v in expected.items() if k[0] in ("n03", "n04")}


def test_page_budgets_take_unlinked_pages(spark, sf):
    from loreweave.plans import graph as plans, maintain as upkeep

    best = {r["id"]: r["other"] for r in plans.related_all(spark, sf).where("rank = 1").collect()}
    taken = {r["id"]: r["taken"].split(",")[0] for r in upkeep.page_budgets(spark, sf).collect()}
    linked = {frozenset(r) for r in plans.link_dedupe(spark, sf).collect()}
    assert taken == best and any(frozenset(p) not in linked for p in best.items())


def test_communities_of_planted_groups(spark):
    rng = random.Random(1)
    groups = {f"g{g}-{i}": g for g in range(4) for i in range(8)}
    names = sorted(groups)
    edges = [(a, b, 1.0) for a in names for b in names if a < b and (groups[a] == groups[b] and rng.random() < 0.8 or rng.random() < 0.03)]
    pairs = spark.createDataFrame(edges, "a string, b string, weight double")
    nodes = nodes_of(spark, [(n, n, None, None) for n in [*names, "alone"]])
    found = graph.communities(nodes, pairs)
    label = {r["id"]: r["community"] for r in found.collect()}
    assert set(label) == {*names, "alone"} and label["alone"] == "alone"
    assert len({label[n] for n in names}) == 4
    assert all(label[a] == label[b] for a in names for b in names if groups[a] == groups[b])
    assert graph.modularity(found, pairs) > graph.modularity(nodes.select("id", F.col("id").alias("community")), pairs) + 0.3
    assert graph.communities(nodes, pairs.limit(0)).count() == 33


def test_communities_by_tables_and_in_one_task(spark, monkeypatch):
    from loreweave.operators import moving

    names = spark.createDataFrame([("a",), ("é",), ("x" * 40,)], "x string").select(F.xxhash64("x").alias("h"), F.xxhash64("x", F.lit(3), F.lit(70)).alias("g")).collect()
    hashed = moving.hash_int(70, moving.hash_int(3, np.array([r["h"] for r in names]).view(np.uint64)))
    assert hashed.view(np.int64).tolist() == [r["g"] for r in names]

    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(24), 2))) for _ in range(45)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", rng.choice([0.5, 1.0, 2.5])) for a, b in sorted(pairs)] + [("n0", "n0", 3.0), ("n1", "n2", 0.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(26)], "id string")
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    found = values(graph.communities(nodes, edges))
    assert len(written) <= 4  # one table a round before
    assert found == values(graph.communities(nodes, edges, one_task=0)) and 1 < len({c for _, c in found}) < 12
    numbered = lambda df, *c: df.select(*[F.substring(x, 2, 9).cast("bigint").alias(x) for x in c], *[x for x in df.columns if x not in c])
    assert len(values(graph.communities(numbered(nodes, "id"), numbered(edges, "a", "b")))) == 26
    with pytest.warns(UserWarning, match="level 0 hasn't settled after 1 rounds"):
        graph.communities(nodes, edges, rounds=1)


def test_communities_of_large_graphs_take_one_task(spark, monkeypatch):
    from loreweave.operators import moving

    rng = np.random.default_rng(3)
    n = 300
    keys = np.unique(rng.integers(0, n * n, 1500))
    x, y = (keys // n)[keys // n < keys % n].astype(np.int32), (keys % n)[keys // n < keys % n].astype(np.int32)
    w, names, loop = rng.choice([0.5, 1.0, 2.5], len(x)), rng.permutation(np.arange(n) * 10**15), rng.choice([0.0, 1.0], n)
    edges = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", float(v)) for a, b, v in zip(x, y, w, strict=True)], "a string, b string, weight double")
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    assert graph.communities(spark.range(n).select(F.format_string("n%03d", "id").alias("id")), edges, one_task=60 * len(x)).count() == n
    assert written == ["members", "arcs", "labels", "members"]  # about 100 bytes for each direction before

    order = rng.permutation(len(x))
    label, still = moving._settle(moving._graph(x, y, w, loop), names, 0, 1000)
    whole = moving.settled(moving._graph(x, y, w, loop), names, 0, 1000, 20)[0]
    monkeypatch.setattr(moving, "_BLOCK", 40)  # many parts
    assert moving.settled(moving._graph(x[order], y[order], w[order], loop), names, 0, 1000, 20)[0].tolist() == whole.tolist()
    strength, to = loop.copy(), np.zeros((n, n))
    np.add.at(strength, np.r_[x, y], np.r_[w, w])
    np.add.at(to, (np.r_[x, y], label[np.r_[y, x]]), np.r_[w, w])
    mass = np.bincount(label, strength, n)
    gain = np.where(to > 0, to - strength[:, None] * mass / strength.sum(), -np.inf)
    own = np.arange(n), label
    assert still and (gain.max(1) <= to[own] - strength * (mass[label] - strength) / strength.sum() + 1e-8).all()  # no node wants to move


def test_insights_of_detected_communities(spark, tmp_path):
    from loreweave.plans import graph as plans, pages as more

    group = {f"g{g}-{i}": g for g in range(4) for i in range(6)}  # all of one type
    out = {a: [b for b in group if a < b and group[a] == group[b]] for a in group}
    for g in (1, 2, 3):
        out["g0-0"].append(f"g{g}-0")
    rows = [(a, a, "concept", [], b) for a, b in out.items()]
    spark.createDataFrame(rows, "page_id string, title string, page_type string, sources array<string>, out_links array<string>").write.parquet(f"{tmp_path}/retrieval_nodes.parquet")
    sf = str(tmp_path)
    assert values(plans.community_stats_detected(spark, sf), "community", "nodes", "inner_edges", "cohesion") == [(f"g{g}-0", 6, 15, 1.0) for g in range(4)]
    assert values(plans.surprising_detected(spark, sf)) == [("g0-0", f"g{g}-0", 3) for g in (1, 2, 3)]
    assert values(plans.bridges_detected(spark, sf)) == [("g0-0", 4)]
    assert values(more.knowledge_gaps_detected(spark, sf)) == [("bridge-node", "g0-0", 4)]


@pytest.mark.parametrize("name", ["bridges_detected", "community_stats_detected", "surprising_detected", "knowledge_gaps_detected"])
def test_detected_communities_take_few_tables(spark, sf, monkeypatch, name):
    from loreweave import plans

    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    assert plans.queries()[name](spark, sf).count() > 0
    assert written == ["members", "arcs", "labels", "members"]  # one table a round before


@pytest.mark.parametrize("name", ["community_stats_detected", "surprising_detected", "knowledge_gaps_detected"])
def test_detected_insights_resolve_links_once(spark, sf, monkeypatch, name):
    from loreweave import plans

    times, resolve = [], graph.resolve_links
    monkeypatch.setattr(graph, "resolve_links", lambda *a: times.append(1) or resolve(*a))
    assert plans.queries()[name](spark, sf).count() > 0
    assert len(times) == 1  # two before


def test_graph_findings(spark):
    rows, edges, nodes, links = random_graph(spark, 5, 12, 10)
    counts = graph.link_counts(nodes, links.select("src", F.col("dst").alias("raw"), "dst"))
    assert {r["id"]: r["links"] for r in counts.collect()} == {n: sum((a == n) + (b == n) for a, b in edges) for n in (r[0] for r in rows)}
    pairs = graph.undirected(links.select("src", F.col("dst").alias("raw"), "dst"))
    labels = nodes.select("id", F.lit("c").alias("community"))
    stats = graph.community_stats(labels, pairs, counts).first()
    assert stats["nodes"] == 12 and math.isclose(stats["cohesion"], pairs.count() / 66)
    assert graph.bridges(pairs, labels).count() == 0
    assert graph.visible_edges(pairs, nodes.where("id <> 'n00'")).where("a = 'n00'").count() == 0


# upkeep


def test_union_lists(spark):
    rows = spark.createDataFrame([(["A", "b", None], ["a", "C"]), (None, ["x", "X"]), (None, None)], "u array<string>, v array<string>")
    assert [r[0] for r in rows.select(maintain.union_lists(F.col("u"), F.col("v"))).collect()] == [["A", "b", "C"], ["x"], []]


def test_page_fates(spark):
    pages = spark.createDataFrame([("a", ["raw/sources/X.pdf"]), ("b", ["x.pdf", "y.pdf"]), ("c", ["z"]), ("d", None), ("e", [None])], "id string, sources array<string>")
    gone = spark.createDataFrame([("x.pdf",), (None,)], "source string")
    assert values(maintain.page_fates(pages, gone)) == [("a", "delete", []), ("b", "keep", ["y.pdf"]), ("c", "skip", ["z"]), ("d", "skip", []), ("e", "skip", [])]


def test_duplicate_groups_and_whitelist(spark):
    pages = spark.createDataFrame([("a", "Foo bar"), ("b", "foo-bar"), ("c", "x"), ("d", None), ("e", ""), ("a", "Foo bar"), ("f", "Q"), ("g", "q")], "id string, title string")
    assert values(maintain.duplicate_groups(pages), "pages", "size", "canonical") == [("a,b", 2, "a"), ("f,g", 2, "f")]
    known = spark.createDataFrame([("B,A",)], "pages string")
    assert values(maintain.duplicate_groups(pages, known), "pages") == [("f,g",)]
    assert values(maintain.redirects(pages)) == [("b", "a"), ("g", "f")]


def test_large_duplicate_groups_keep_their_pages(spark):
    ids = [f"p{i:04}" for i in range(1500)]
    pages = spark.createDataFrame([(i, "One title") for i in ids] + [("x", "Other")], "id string, title string")
    assert values(maintain.duplicate_groups(pages), "pages", "size", "canonical") == [(",".join(ids), 1500, "p0000")]
    assert maintain.duplicate_groups(pages, spark.createDataFrame([(",".join(ids).upper(),)], "pages string")).count() == 0
    assert values(maintain.duplicate_members(pages), "id", "size", "canonical") == [(i, 1500, "p0000") for i in ids]


def test_saved_chats_keep_a_hundred_messages(spark, tmp_path):
    from loreweave.plans import maintain as plans

    chat = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}: m{i}" for i in range(120))
    spark.createDataFrame([(1, chat)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["content"] for r in plans.chat_saved_messages(spark, str(tmp_path)).collect()} == {f"m{i}" for i in range(20, 120)}


def test_rewrite_links(spark):
    links = spark.createDataFrame([("p", 0, "b"), ("p", 1, "A"), ("p", 2, "c"), ("p", 3, "b")], "id string, place int, target string")
    moved = spark.createDataFrame([("b", "a")], "old string, new string")
    assert values(maintain.rewrite_links(links, moved), "target", "was") == [("a", "b"), ("c", "c")]


def test_reviews(spark):
    schema = "id bigint, kind string, key string, description string, project string, created_at timestamp_ntz"
    from datetime import datetime

    at = lambda d: datetime(2025, 1, d)
    rows = [(1, "missing-page", "two words", "old", "p", at(1)), (2, "missing-page", "two words", "", "q", at(2)), (3, "duplicate", "gone", None, "p", at(1)), (4, "duplicate", "here", "x", "p", at(1))]
    reviews = spark.createDataFrame(rows, schema)
    merged = {(r["kind"], r["key"]): r for r in maintain.merge_reviews(reviews).collect()}
    one = merged["missing-page", "two words"]
    assert (one["first_id"], one["last_id"], one["n"], one["description"], one["projects"]) == (1, 2, 2, "old", 2)
    again = maintain.merge_reviews(reviews.unionByName(reviews.limit(0)))
    assert again.count() == len(merged)
    pages = spark.createDataFrame([("two-words", "T"), ("x", "Here")], "id string, title string")
    assert values(maintain.sweep_reviews(reviews, pages)) == [(1, "page exists"), (2, "page exists"), (3, "page is gone")]


def test_caches(spark):
    now = spark.createDataFrame([("a", "H1"), ("b", "h2"), ("c", None), ("d", "h")], "path string, hash string")
    old = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h")], "path string, hash string")
    assert values(maintain.cache_misses(now, old, ["path"])) == [("b", "changed"), ("c", "no hash"), ("d", "new")]


def test_chunk_tables(spark):
    schema = "chunk_id string, page_id string, embedding array<float>"
    stored = spark.createDataFrame([("a#0", "a", [1.0]), ("a#1", "a", [1.0]), ("b#0", "b", [1.0, 2.0]), ("c#0", "c", None)], schema)
    new = spark.createDataFrame([("a#0", "a", [2.0])], schema)
    assert values(maintain.upsert_chunks(stored, new), "chunk_id") == [("a#0",), ("b#0",), ("c#0",)]
    assert maintain.upsert_chunks(stored, new.limit(0)).count() == 4
    assert values(maintain.delete_pages(stored, spark.createDataFrame([("a",), ("z",)], "page_id string")), "chunk_id") == [("b#0",), ("c#0",)]
    assert values(maintain.wrong_dimensions(stored)) == [("b#0", 2), ("c#0", 0)]
    made = maintain.embed_chunks(stored.drop("embedding"), "chunk_id", lambda texts: [[float(len(t))] for t in texts])
    assert {tuple(r["embedding"]) for r in made.collect()} == {(3.0,)}


def test_folds(spark):
    from loreweave.streaming.changes import merge_kind

    rng = random.Random(2)
    kinds = ["created", "modified", "deleted"]
    lists = [[rng.choice(kinds) for _ in range(rng.randrange(6))] for _ in range(60)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    for r in rows.select("x", maintain.fold_kinds(F.col("x")).alias("k")).collect():
        state = None
        for k in r["x"]:
            state = merge_kind(state, k)
        assert r["k"] == state
    sizes = spark.createDataFrame([([400, 900, 300, 500],), ([],), ([2000],)], "s array<int>")
    assert [r[0] for r in sizes.select(maintain.fill_budget(F.col("s"), 1000, 500)).collect()] == [[0, 1], [], [0]]


# snapshots


def brute_changes(rows):
    held = {}
    for no, project, path, h, size, version in sorted(rows, key=lambda r: (r[5], r[3] or "", r[4])):
        held.setdefault(no, {})[project, path] = (h, size)
    found = set()
    for no in held:
        if no - 1 in held:
            now, before = held[no], held[no - 1]
            found |= {(no, *k, "added") for k in now.keys() - before.keys()} | {(no, *k, "removed") for k in before.keys() - now.keys()}
            found |= {(no, *k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
    return found


def changes(spark, rows, known=None):
    df = spark.createDataFrame(rows, "no int, project string, path string, hash string, size bigint, version bigint").withColumn("ordinal", F.lit("clash")).withColumn("bits", F.lit(1))
    found = snapshot_changes(df, "no", ["project", "path"], F.struct("hash", "size"), F.col("version"), known)
    return {(r["no"], r["project"], r["path"], r["change"]) for r in found.collect()}


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for no in range(1, 5):
        for i in range(300):
            if rng.random() < 0.8:
                rows.append((no, rng.choice(["p", None]) if i % 50 == 0 else "p", f"f{i}", rng.choice(["a", "b", None]) if rng.random() < 0.2 else "a", i, rng.randrange(10**9)))
    rows += rows[:40]
    rows += [(2, "p", "f1", "z", 9, 10**10), (None, "p", "f1", "z", 9, 1)]
    assert changes(spark, rows) == brute_changes([r for r in rows if r[0] is not None])


def test_snapshot_edges(spark):
    assert changes(spark, [(1, "p", "a", "x", 1, 1)]) == set()
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "p", "a", None, 1, 1), (2, "p", "a", None, 1, 1), (3, "p", "b", None, 1, 1)]) == {(3, "p", "a", "removed"), (3, "p", "b", "added")}
    # the second listing is missing: nothing is known of the third
    assert changes(spark, [(1, "p", "a", "x", 1, 1), (3, "p", "b", "x", 1, 1)]) == set()


def test_ordinals_persist(spark):
    first = assign_ordinals(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string"), ["k"], shards=2)
    more = assign_ordinals(spark.createDataFrame([("c",), ("a",), (None,), ("d",)], "k string"), ["k"], first, shards=2)
    old, new = {r["k"]: r["ordinal"] for r in first.collect()}, {r["k"]: r["ordinal"] for r in more.collect()}
    assert len(old) == 3 and len(new) == 5 == len(set(new.values()))
    assert all(new[k] == v for k, v in old.items())


# components


def test_components_against_brute_force(spark):
    from loreweave.operators.components import connected_components

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(200, 200 + i) for i in range(1, 30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges + edges[:5], "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
