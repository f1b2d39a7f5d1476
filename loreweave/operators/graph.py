"""Link graph: resolution, counts, relevance, communities and insights.

Nodes are (id, title, type, sources), links are (src, raw, dst): ``raw`` as
written, ``dst`` the node it resolves to or null. Hubs may hold a third of all
links, so nothing collects neighbour lists; common neighbours come from joins
that start at the end of an edge with fewer neighbours.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.functions.text import ref_key
from loreweave.operators import moving
from loreweave.storage import materialize

#: Weights of the relevance signals, and of the two-hop score.
DIRECT, SOURCE, NEIGHBOUR, OTHER_AFFINITY = 3.0, 4.0, 1.5, 0.5
#: Affinity of page types.
AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source": 1.0, "synthesis": 1.0, "query": 0.8},
    "concept": {"entity": 1.2, "concept": 0.8, "source": 1.0, "synthesis": 1.2, "query": 1.0},
    "source": {"entity": 1.0, "concept": 1.0, "source": 0.5, "query": 0.8, "synthesis": 1.0},
    "query": {"concept": 1.0, "entity": 0.8, "synthesis": 1.0, "source": 0.8, "query": 0.5},
    "synthesis": {"concept": 1.2, "entity": 1.0, "source": 1.0, "query": 1.0, "synthesis": 0.8},
}
#: Types that have affinities of their own; all others are one class after them.
CLASSES = tuple(AFFINITY)
#: Pairs that one task of an expansion makes, about.
MEET_ROWS = 1_000_000
#: Bytes of a graph whose communities one task finds, and what a pair of linked nodes counts there.
ONE_TASK_BYTES, PAIR_BYTES = 500_000_000, 60
#: Pages that hold a knowledge base together rather than knowledge.
STRUCTURAL = ("index", "overview", "log", "schema", "purpose")
#: Pairs of types that are far apart.
DISTANT_TYPES = (("source", "concept"), ("source", "synthesis"), ("query", "entity"))


def resolve_links(nodes: DataFrame, raw_links: DataFrame) -> DataFrame:
    """``raw_links`` (src, raw) with ``dst``: the node with that id, else the first by id with the same key.

    Keys ignore case, blanks, hyphens, underscores and a ``.md``. A link without
    a node keeps a null ``dst``; a null link stays null; repeated links are kept.
    """
    by_key = nodes.select(ref_key("id").alias("key"), "id").where("key <> ''").groupBy("key").agg(F.min("id").alias("near"))
    exact = nodes.select("id").distinct()
    keyed = raw_links.withColumn("key", ref_key("raw"))
    found = keyed.join(exact.select(F.col("id").alias("hit")), F.col("raw") == F.col("hit"), "left").join(by_key, "key", "left")
    return found.select("src", "raw", F.coalesce("hit", "near").alias("dst"))


def directed(links: DataFrame) -> DataFrame:
    """Distinct resolved links without self-links: src, dst."""
    return links.where("dst is not null and src <> dst").select("src", "dst").distinct()


def undirected(links: DataFrame) -> DataFrame:
    """Each linked pair once: a < b."""
    return directed(links).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def link_counts(nodes: DataFrame, links: DataFrame, once_per_pair: bool = False) -> DataFrame:
    """Ends of links per node, 0 for unlinked ones: id, links. Each raw link counts, or each linked pair."""
    ends = undirected(links).select(F.explode(F.array("a", "b")).alias("id")) if once_per_pair else links.where("dst is not null and src <> dst").select(F.explode(F.array("src", "dst")).alias("id"))
    counted = ends.groupBy("id").agg(F.count("*").alias("links"))
    return nodes.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct out-links plus distinct in-links, so a mutual pair counts twice: id, degree."""
    counted = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def shared_sources(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Number of sources that both ends of each pair name: a, b, shared (0 included)."""
    named = nodes.select("id", F.array_distinct(F.array_compact(F.coalesce("sources", F.array().cast(nodes.schema["sources"].dataType)))).alias("s"))
    both = pairs.join(named.select(F.col("id").alias("a"), F.col("s").alias("u")), "a", "left").join(named.select(F.col("id").alias("b"), F.col("s").alias("v")), "b", "left")
    return both.select("a", "b", F.coalesce(F.size(F.array_intersect("u", "v")), F.lit(0)).alias("shared"))


def adamic_adar(pairs: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """Sum over common neighbours of 1 / ln(max(degree, 2)): a, b, common, score; pairs with none are left out."""
    near = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().select(F.col("src").alias("id"), F.col("dst").alias("n"))
    sizes = near.groupBy("id").agg(F.count("*").alias("size"))
    sized = pairs.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("u")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("v")), "b")
    first = F.col("u") <= F.col("v")
    few = sized.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"))
    met = few.join(near, "id").join(near.select(F.col("id").alias("other"), "n"), ["other", "n"])
    weighed = met.join(degree.select(F.col("id").alias("n"), "degree"), "n")
    return weighed.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(1 / F.log(F.greatest(F.col("degree"), F.lit(2)).cast("double"))).alias("score"))


def affinity(a: Column, b: Column, other: float = OTHER_AFFINITY) -> Column:
    value = F.lit(other)
    for left, row in AFFINITY.items():
        for right, x in row.items():
            value = F.when((a == left) & (b == right), F.lit(x)).otherwise(value)
    return value


def relevance(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Four-signal relevance of each pair: a, b, direct, shared, neighbours, affinity, relevance."""
    degree = degrees(nodes, edges)
    direct = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("direct"))
    types = nodes.select("id", "type").dropDuplicates(["id"])
    found = shared_sources(pairs, nodes).join(direct, ["a", "b"], "left").join(adamic_adar(pairs, edges, degree).select("a", "b", "score"), ["a", "b"], "left")
    found = found.join(types.select(F.col("id").alias("a"), F.col("type").alias("x")), "a", "left").join(types.select(F.col("id").alias("b"), F.col("type").alias("y")), "b", "left")
    parts = found.select("a", "b", F.coalesce("direct", F.lit(0)).alias("direct"), "shared", F.coalesce("score", F.lit(0.0)).alias("neighbours"), affinity(F.col("x"), F.col("y")).alias("affinity"))
    total = F.col("direct") * DIRECT + F.col("shared") * SOURCE + F.col("neighbours") * NEIGHBOUR + F.col("affinity")
    return parts.withColumn("relevance", total)


def related(scored: DataFrame, limit: int = 5) -> DataFrame:
    """The most relevant others of each node among scored pairs: id, other, relevance, rank; ties by id."""
    both = scored.select(F.col("a").alias("id"), F.col("b").alias("other"), "relevance").unionByName(scored.select(F.col("b").alias("id"), F.col("a").alias("other"), "relevance"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("relevance", 6)), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _meet(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Joins asked (id, key, weight) with members (key, other): id, other, weight. A key of many pairs is cut into parts of about ``MEET_ROWS``."""
    sizes = asked.groupBy("key").agg(F.count("*").alias("n")).join(members.groupBy("key").agg(F.count("*").alias("m")), "key").select("key", (F.col("n") * F.col("m")).alias("work"))
    sizes = materialize(sizes.select("key", "work", F.ceil(F.col("work") / MEET_ROWS).cast("int").alias("parts")), "sizes")
    # A stated number, since the bytes that are read say nothing of the rows that come out.
    tasks = min(10_000, (sizes.agg(F.sum("work")).first()[0] or 0) // MEET_ROWS + 1)
    left = asked.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("key", "part", "id", "weight")
    right = members.join(sizes, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "part", "other")
    met = left.repartition(tasks, "key", "part").join(right.repartition(tasks, "key", "part"), ["key", "part"])
    return met.where("id <> other").select("id", "other", "weight")


def related_nodes(queries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """The most relevant of all other nodes, linked or not, for each query node: id, other, relevance, rank; ties by id.

    Candidates are the others that are linked, share a source or have a common neighbour; the rest
    have their affinity alone, so of each class of types only the first ``limit + 1`` by id can rank.
    Work is the sum over the query nodes' neighbours and sources of how many nodes those have.
    """
    kind = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("type")), F.lit(0)).cast("long")
    # A node's number ascends with its id; its last three bits are its class, so no pair is joined with types.
    numbered = nodes.select("id", "type").dropDuplicates(["id"]).orderBy("id").select("id", (F.monotonically_increasing_id() * 8 + kind).alias("no"))
    numbered = materialize(numbered, "numbered")
    number = lambda column, name: numbered.select(F.col("id").alias(column), F.col("no").alias(name))
    asked = materialize(queries.select("id").distinct().join(numbered, "id").select(F.col("no").alias("id")), "asked")
    ends = edges.join(number("src", "x"), "src").join(number("dst", "y"), "dst")
    steps = ends.select(F.col("x").alias("id"), F.col("y").alias("n")).unionAll(ends.select(F.col("y").alias("id"), F.col("x").alias("n")))
    near = materialize(steps.groupBy("id", "n").agg(F.count("*").alias("direct")), "near")
    degree = near.groupBy(F.col("id").alias("n")).agg(F.sum("direct").alias("degree"))
    own = near.join(asked, "id", "left_semi")
    paths = own.join(degree, "n").select("id", F.col("n").alias("key"), (NEIGHBOUR / F.log(F.greatest("degree", F.lit(2)).cast("double"))).alias("weight"))
    named = nodes.select("id", F.explode("sources").alias("key")).where("key is not null").distinct().join(numbered, "id").select("key", F.col("no").alias("other"))
    named = materialize(named, "named")
    sharing = named.withColumnRenamed("other", "id").join(asked, "id", "left_semi").select("id", "key", F.lit(SOURCE).alias("weight"))
    first = Window.partitionBy(F.col("no") % 8).orderBy("no")
    heads = numbered.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit + 1).select(F.col("no").alias("other"))
    signals = own.select("id", F.col("n").alias("other"), (F.col("direct") * DIRECT).alias("weight"))
    signals = signals.unionByName(_meet(paths, near.select(F.col("n").alias("key"), F.col("id").alias("other")))).unionByName(_meet(sharing, named))
    signals = signals.unionByName(asked.join(F.broadcast(heads), F.col("id") != F.col("other")).withColumn("weight", F.lit(0.0)))
    total = signals.repartition("id").groupBy("id", "other").agg(F.sum("weight").alias("signal"))
    values = [AFFINITY.get(x, {}).get(y, OTHER_AFFINITY) for x in (None, *CLASSES) for y in (None, *CLASSES)]
    both = F.get(F.array(*[F.lit(v) for v in values]), ((F.col("id") % 8) * (len(CLASSES) + 1) + F.col("other") % 8).cast("int"))
    total = total.select("id", "other", (F.col("signal") + both).alias("relevance"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("relevance", 6)), "other")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    best = best.withColumnsRenamed({"id": "x", "other": "y"}).join(number("id", "x"), "x").join(number("other", "y"), "y")
    return best.select("id", "other", "relevance", "rank")


def two_hop_related(queries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Related nodes of the query nodes: 3 per direct link either way, 1.5 per two-link path, 4 per shared
    source, times the affinity of the types (1 where none is set): id, other, score, rank."""
    steps = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("n")))
    asked = queries.select("id").distinct()
    one = asked.join(steps, "id")
    two = one.join(steps.select(F.col("id").alias("n"), F.col("n").alias("other")), "n").where("other <> id")
    named = nodes.select("id", F.explode(F.array_distinct("sources")).alias("source")).where("source is not null").distinct()
    shared = asked.join(named, "id").join(named.select(F.col("id").alias("other"), "source"), "source").where("other <> id")
    parts = [(one.select("id", F.col("n").alias("other")), DIRECT), (two.select("id", "other"), NEIGHBOUR), (shared.select("id", "other"), SOURCE)]
    scored = None
    for part, weight in parts:
        part = part.groupBy("id", "other").agg((F.count("*") * weight).alias("score"))
        scored = part if scored is None else scored.unionByName(part)
    types = nodes.select("id", "type").dropDuplicates(["id"])
    total = scored.groupBy("id", "other").agg(F.sum("score").alias("base"))
    total = total.join(types.select("id", F.col("type").alias("x")), "id").join(types.select(F.col("id").alias("other"), F.col("type").alias("y")), "other")
    total = total.select("id", "other", (F.col("base") * affinity(F.col("x"), F.col("y"), 1.0)).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 6)), "other")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def structural(node_id: Column) -> Column:
    return F.lower(node_id).isin(*STRUCTURAL)


def _renamed(member: DataFrame, label: DataFrame) -> DataFrame:
    """Members (id, node) with the label (x, c) of their node, if it has one."""
    return member.join(label.withColumnRenamed("x", "node"), "node", "left").select("id", F.coalesce("c", "node").alias("node"))


def _told_apart(member: DataFrame) -> bool:
    """Whether all nodes of the members have hashes of their own."""
    return not member.select("node").distinct().groupBy(F.xxhash64("node")).count().where("count > 1").limit(1).count()


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 1000, levels: int = 20, one_task: int = ONE_TASK_BYTES) -> DataFrame:
    """Weighted modularity communities by deterministic local moving: id, community (its smallest member's id).

    ``edges`` has a, b, weight. In each round a hash half of the nodes moves to the neighbouring
    community with the greatest gain in modularity, if any; ties go to the smaller name. Then
    communities become nodes and the rounds are repeated, until no node wants to move and no two
    communities join. A level that hasn't settled after ``rounds``, or a graph after ``levels``, is reported
    by a warning. Every round is a join of the edges with the labels and two aggregations, written to the shared folder.
    As soon as a level has at most ``one_task`` bytes, one task does the rest by the same rule, with the same result.
    """
    spark: SparkSession = nodes.sparkSession
    member = materialize(nodes.select("id", F.col("id").alias("node")).distinct(), "members")
    linked = edges.where("a <> b and weight > 0").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("weight").alias("w"))
    half = materialize(linked, "arcs")
    for level in range(levels):
        total, size = half.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(F.col("w") * 2)), F.count("*") * PAIR_BYTES).first()
        if not total:
            break
        if size <= one_task and _told_apart(member):
            found = materialize(moving.moved_in_one_task(half, level, rounds, levels), "labels")
            for row in found.where("said is not null").collect():
                warnings.warn(row["said"], stacklevel=2)
            hashed = member.select("id", F.xxhash64("node").alias("h"))
            member = materialize(hashed.join(found.where("said is null").select("h", "c"), "h", "left").select("id", F.coalesce("c", "h").alias("node")), "members")
            break
        arcs = half.unionByName(half.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "w"))
        strength = materialize(arcs.groupBy("x").agg(F.sum("w").alias("k")), "strength")
        label = materialize(strength.select("x", F.col("x").alias("c")), "labels")
        for turn in range(rounds):
            mass = strength.join(label, "x").groupBy("c").agg(F.sum("k").alias("m"))
            to = arcs.where("x <> y").join(label.select(F.col("x").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("w").alias("w"))
            own = strength.join(label.withColumnRenamed("c", "was"), "x")
            choice = to.unionByName(own.select("x", F.col("was").alias("c"), F.lit(0.0).alias("w"))).groupBy("x", "c").agg(F.sum("w").alias("w"))
            choice = choice.join(own, "x").join(mass, "c")
            rest = F.col("m") - F.when(F.col("c") == F.col("was"), F.col("k")).otherwise(F.lit(0.0))
            gain = F.round(F.col("w") - F.col("k") * rest / F.lit(float(total)), 9)
            best = choice.groupBy("x", "was").agg(F.max_by("c", F.struct(gain, (F.col("c") == F.col("was")).cast("int"), -F.xxhash64("c"))).alias("c"))
            # Another half each round, so that two neighbours don't change places for ever.
            moves = F.pmod(F.xxhash64("x", F.lit(level), F.lit(turn)), F.lit(2)) == 0
            moved = materialize(best.select("x", F.when(moves, F.col("c")).otherwise(F.col("was")).alias("c"), (F.col("c") != F.col("was")).alias("wants")), "labels")
            label = moved.select("x", "c")
            if not moved.where("wants").limit(1).count():
                break
        else:
            warnings.warn(moving.unsettled(level, rounds), stacklevel=2)
        if not label.where("x <> c").limit(1).count():
            break
        member = materialize(_renamed(member, label), "members")
        named = arcs.join(label, "x").join(label.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").where("c <= d")
        half = materialize(named.groupBy(F.col("c").alias("x"), F.col("d").alias("y")).agg(F.sum("w").alias("w")), "arcs")
    else:
        warnings.warn(moving.joining(levels), stacklevel=2)
    names = member.groupBy("node").agg(F.min("id").alias("community"))
    return member.join(names, "node").select("id", "community")


def modularity(labels: DataFrame, edges: DataFrame) -> float:
    """Weighted modularity of a labelling: one number."""
    both = edges.where("a <> b and weight > 0")
    named = both.join(labels.select(F.col("id").alias("a"), F.col("community").alias("c")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("d")), "b")
    total = named.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    ends = named.select(F.col("c"), "weight").unionByName(named.select(F.col("d").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    inner = named.where("c = d").agg(F.sum("weight")).first()[0] or 0.0
    return inner / total - (ends.agg(F.sum(F.pow(F.col("k") / (2 * total), F.lit(2)))).first()[0] or 0.0)


def community_stats(labels: DataFrame, pairs: DataFrame, counts: DataFrame, top: int = 5) -> DataFrame:
    """Per community: nodes, inner edges, cohesion (their density), and its most linked members."""
    size = labels.groupBy("community").agg(F.count("*").alias("nodes"))
    named = pairs.join(labels.select(F.col("id").alias("a"), F.col("community").alias("c")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("d")), "b")
    inner = named.where("c = d").groupBy(F.col("c").alias("community")).agg(F.count("*").alias("inner_edges"))
    order = Window.partitionBy("community").orderBy(F.desc("links"), "id")
    best = labels.join(counts, "id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    best = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("top_nodes"))
    stats = size.join(inner, "community", "left").join(best, "community", "left").withColumn("inner_edges", F.coalesce("inner_edges", F.lit(0)))
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return stats.withColumn("cohesion", F.when(possible > 0, F.col("inner_edges") / possible).otherwise(F.lit(0.0)))


def surprising_edges(pairs: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Best-scored unexpected edges: a, b, score.

    3 for two communities, 2 for distant types or 1 for other different ones, 2 if an end with at most
    two links meets one with at least half the greatest number, 1 for a weight between 0 and 2; from 3 on.
    ``pairs`` has a, b, weight; ``nodes`` has id, type, community, links. Ties by a, then b.
    """
    most = max(nodes.agg(F.max("links")).first()[0] or 0, 1)
    ends = [nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in ("id", "type", "community", "links")]) for end in "ab"]
    both = pairs.join(ends[0], F.col("a") == F.col("id_a")).join(ends[1], F.col("b") == F.col("id_b"))
    both = both.where(~F.lower("a").isin("index", "log", "overview") & ~F.lower("b").isin("index", "log", "overview"))
    distant = F.lit(False)
    for x, y in DISTANT_TYPES:
        distant = distant | ((F.col("type_a") == x) & (F.col("type_b") == y)) | ((F.col("type_a") == y) & (F.col("type_b") == x))
    score = F.when(F.col("community_a") != F.col("community_b"), 3).otherwise(0)
    score = score + F.when(F.col("type_a").eqNullSafe(F.col("type_b")), 0).when(distant, 2).otherwise(1)
    score = score + F.when((F.least("links_a", "links_b") <= 2) & (F.greatest("links_a", "links_b") >= F.lit(most * 0.5)), 2).otherwise(0)
    score = score + F.when((F.col("weight") < 2) & (F.col("weight") > 0), 1).otherwise(0)
    return both.select("a", "b", score.alias("score")).where("score >= 3").orderBy(F.desc("score"), "a", "b").limit(limit)


def bridges(pairs: DataFrame, labels: DataFrame, limit: int = 3) -> DataFrame:
    """Nodes next to at least three communities, most first: id, communities."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("n")))
    near = both.join(labels.select(F.col("id").alias("n"), "community"), "n").where(~F.lower("id").isin("index", "log", "overview"))
    counted = near.groupBy("id").agg(F.countDistinct("community").alias("communities"))
    return counted.where("communities >= 3").orderBy(F.desc("communities"), "id").limit(limit)


def visible_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    return pairs.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
