"""Exact near-duplicate join by vertical partitioning of the n-gram order.

The n-grams of all records are put into one global order, rare ones first, and
that order is cut into fragments. A record becomes one segment per fragment;
overlaps are counted within each fragment and summed per pair.

Two records can only reach the threshold if they share an n-gram among the first
``n - ceil(t * n) + 1`` of either one, so pairs are generated in those rare
fragments only, by an equi-join on the n-gram. Three tests that lose no pair
drop almost all others while they are joined: the sizes, the places of the
shared n-gram, and the parity signature of 128 bits (each n-gram flips one bit,
so signatures of sets differ in at most as many bits as the sets in members).

The order is by the count of the n-gram's bin over all records, then by its
hash. Any total order gives the same pairs; counts make it a good one. Broadcast
are the count vector, ``bins`` numbers, and, up to ``MARKS`` bits, a filter sized by the
records that have a candidate; beyond, those records are joined by a shuffle.

An n-gram in the bins of more than ``crowd`` records is split: two records that share
it as their rarest common n-gram also share the next one, which lies at most one place
beyond the first so many. They meet at the two together, so no task holds all
records of a frequent n-gram, and records that share nothing else never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.shingles import gram_sets, mix, slices
from loreweave.operators.components import connected_components
from loreweave.storage import materialize

_EPS = 1e-9
#: Most bits of the filter that keeps records without candidates from being shuffled: 32 MiB, for 16 million records with candidates.
MARKS = 1 << 28


@dataclass(frozen=True)
class Shape:
    """How a text becomes a set: runs of ``n`` words (kind ``text``; ``word`` for those of a-z and 0-9 only), or of ``n`` characters (``char``)."""

    kind: str = "text"
    n: int = 5
    threshold: float = 0.8
    fragments: int = 16
    bins: int = 1 << 18
    crowd: int = 1 << 14


def _bin(grams: np.ndarray, bins: int) -> np.ndarray:
    return (grams >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)


def _classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One row per different text (rid, copies, text), and the keys of each (rid, key).

    Texts are told apart by 128 bits of hash, so copies, however many, meet after
    a partial aggregation and never form a group that one task must hold.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    rows = rows.withColumns({"h0": F.xxhash64("text"), "h1": F.xxhash64(F.lit(7), "text")})
    texts = rows.groupBy("h0", "h1").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("rid"), "*"), "texts")
    members = rows.select("key", "h0", "h1").join(texts.select("rid", "h0", "h1"), ["h0", "h1"])
    return texts, materialize(members.select("rid", "key").distinct(), "members")


def _bin_counts(texts: DataFrame, shape: Shape) -> np.ndarray:
    """How many sets hold an n-gram of each bin, over all texts: ``shape.bins`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.bins, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, grams = gram_sets(part.column("text"), shape.kind, shape.n)
                total += np.bincount(_bin(grams, shape.bins), minlength=shape.bins)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bin", "n"])

    counts = texts.select("text").mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    total = np.zeros(shape.bins, dtype=np.int64)
    total[found["bin"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return total


class _Order:
    """The global order, its cuts and the crowded bins; sent to the executors as vectors of ``bins`` numbers."""

    def __init__(self, counts: np.ndarray, fragments: int, crowd: int) -> None:
        self.crowded = counts > crowd
        by_count = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), dtype=np.int32)
        self.rank[by_count] = np.arange(len(counts), dtype=np.int32)
        mass = np.cumsum(counts[by_count])
        of_rank = np.minimum(mass * fragments // max(int(mass[-1]), 1), fragments - 1)
        self.fragment = of_rank.astype(np.int16)

    def ordered(self, texts: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, n-gram and rank, by row and then in the global order."""
        rows, grams = gram_sets(texts, shape.kind, shape.n)
        ranks = self.rank[_bin(grams, shape.bins)]
        order = np.lexsort((ranks, rows))  # stable: equal ranks stay ordered by hash
        return rows[order], grams[order], ranks[order]


def _prefixes(texts: DataFrame, order, shape: Shape) -> DataFrame:
    """The rare n-grams that a partner must share: token, rid, place, size, signature.

    The token is 32 bits of the n-gram: two that share them cost a test, never a result.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, grams, _ = order.value.ordered(part.column("text"), shape)
                if not len(rows):
                    continue
                first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                sizes = np.diff(np.append(first, len(rows)))
                size = np.repeat(sizes, sizes)
                place = np.arange(len(rows)) - np.repeat(first, sizes)
                bit = grams & np.uint64(127)
                flag = np.uint64(1) << (bit & np.uint64(63))
                low = np.bitwise_xor.reduceat(np.where(bit < 64, flag, np.uint64(0)), first)
                high = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), flag), first)
                least = np.ceil(shape.threshold * size - _EPS).astype(np.int64)
                first_ones = size - least + 1
                crowded = order.value.crowded[_bin(grams, shape.bins)]
                alone = np.flatnonzero((place < first_ones) & (~crowded | (least < 2)))
                split = np.flatnonzero((place < first_ones) & crowded)
                children = np.maximum(np.minimum(first_ones + 1, size)[split] - place[split] - 1, 0)
                parent = np.repeat(split, children)
                child = parent + 1 + np.arange(len(parent)) - np.repeat(np.cumsum(children) - children, children)
                at = np.concatenate([alone, parent])
                token = np.concatenate([grams[alone], mix(grams[parent] * np.uint64(3) + grams[child])])
                yield pa.record_batch(
                    [
                        pa.array(token.astype(np.uint32).view(np.int32)),
                        pa.array(part.column("rid").to_numpy()[rows[at]]),
                        pa.array(place[at].astype(np.int32)),
                        pa.array(size[at].astype(np.int32)),
                        pa.array(np.repeat(low, sizes)[at].view(np.int64)),
                        pa.array(np.repeat(high, sizes)[at].view(np.int64)),
                    ],
                    ["token", "rid", "place", "size", "low", "high"],
                )

    schema = "token int, rid bigint, place int, size int, low bigint, high bigint"
    return texts.select("rid", "text").mapInArrow(emit, schema)


def _with_candidates(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The texts that may have a candidate: by a filter of 16 bits or more for each of them, or, where it would be too large, by a join."""
    ids = materialize(candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ids")
    bits = 1 << max(16, (16 * max(ids.count(), 1) - 1).bit_length())
    if bits > MARKS:
        return texts.select("rid", "text").join(ids, "rid", "left_semi")
    spot = F.pmod(F.xxhash64("rid"), F.lit(bits)).alias("spot")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("spot") % 64).cast("int"))
    words = ids.select(spot).groupBy((F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    found = np.zeros(bits // 64, dtype=np.uint64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    marks = texts.sparkSession.sparkContext.broadcast(found)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column("spot").to_numpy().astype(np.uint64)
            hit = (marks.value[spots >> np.uint64(6)] >> (spots & np.uint64(63))) & np.uint64(1)
            yield batch.select(["rid", "text"]).filter(pa.array(hit.astype(bool)))

    return texts.select("rid", "text", spot).mapInArrow(marked, "rid bigint, text string")


def _segments(texts: DataFrame, order, shape: Shape) -> DataFrame:
    """One row per record and fragment: rid, fragment, the n-grams of that segment."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, grams, ranks = order.value.ordered(part.column("text"), shape)
                if not len(rows):
                    continue
                fragment = order.value.fragment[ranks]
                first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (fragment[1:] != fragment[:-1]))))
                grams = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(grams.view(np.int64)))
                rid = part.column("rid").to_numpy()[rows[first]]
                yield pa.record_batch([pa.array(rid), pa.array(fragment[first].astype(np.int32)), grams], ["rid", "fragment", "grams"])

    return texts.mapInArrow(emit, "rid bigint, fragment int, grams array<bigint>")


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a rare n-gram and pass the three tests: a, b, size_a, size_b."""
    a, b = prefixes.alias("a"), prefixes.alias("b")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.size") + F.col("b.size")) - F.lit(_EPS))
    apart = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) + F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
    smaller = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.rid") < F.col("b.rid")))
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & smaller
        & (F.col("a.size") >= F.lit(threshold) * F.col("b.size") - F.lit(_EPS))
        & (F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) >= need)
        & (apart <= F.col("a.size") + F.col("b.size") - 2 * need),
    )
    return met.select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"), F.col("a.size").alias("size_a"), F.col("b.size").alias("size_b")).distinct()


def _overlaps(candidates: DataFrame, segments: DataFrame, threshold: float) -> DataFrame:
    """Partial overlaps of each fragment, summed per pair; pairs at the threshold or above."""
    left = segments.select(F.col("rid").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("rid").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = candidates.join(left, "a").join(right, ["b", "fragment"])
    partial = partial.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))
    union = F.col("size_a") + F.col("size_b") - F.col("overlap")
    total = total.withColumn("similarity", F.col("overlap") / union)
    return total.where(F.col("similarity") >= F.lit(threshold - _EPS)).select("a", "b", "overlap", "similarity")


def similar_classes(df: DataFrame, key: str, text: str, shape: Shape = Shape()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near-duplicates as pairs between different texts, with the keys of each text.

    Returns ``pairs(a, b, overlap, similarity)`` over text ids with a text's
    set never empty, ``members(rid, key)`` and ``texts(rid, h0, h1, copies, text)``.
    Rows with a null key or text take no part; a text without any n-gram has no
    partners, not even its copies; extra columns of ``df`` are ignored; repeated
    rows count once. An empty table gives empty results.
    """
    if shape.kind not in ("text", "word", "char") or shape.n < 1 or not 0 < shape.threshold <= 1:
        raise ValueError(f"not a shape: {shape}")
    texts, members = _classes(df, key, text)
    context = df.sparkSession.sparkContext
    order = context.broadcast(_Order(_bin_counts(texts, shape), shape.fragments, shape.crowd))
    candidates = materialize(_candidates(_prefixes(texts, order, shape), shape.threshold), "candidates")
    segments = _segments(_with_candidates(texts, candidates), order, shape)
    return _overlaps(candidates, segments, shape.threshold), members, texts


def _with_grams(texts: DataFrame, shape: Shape) -> DataFrame:
    """The texts whose set isn't empty."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, _ = gram_sets(part.column("text"), shape.kind, shape.n)
                yield pa.record_batch([pa.array(part.column("rid").to_numpy()[np.unique(rows)])], ["rid"])

    return texts.select("rid", "text").mapInArrow(emit, "rid bigint")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, shape: Shape = Shape()) -> DataFrame:
    """All pairs of keys with similarity at or above the threshold: key_a, key_b, similarity.

    ``key_a < key_b``. Copies of one text pair up with similarity 1 unless their
    set is empty. Cases and nulls as in :func:`similar_classes`.
    """
    pairs, members, texts = similar_classes(df, key, text, shape)
    left = members.select(F.col("rid").alias("a"), F.col("key").alias("x"))
    right = members.select(F.col("rid").alias("b"), F.col("key").alias("y"))
    different = pairs.join(left, "a").join(right, "b").select("x", "y", "similarity").where("x <> y")
    repeated = _with_grams(texts.where("copies > 1"), shape)
    copies = members.join(repeated, "rid", "left_semi")
    same = copies.select("rid", F.col("key").alias("x")).join(copies.select("rid", F.col("key").alias("y")), "rid")
    same = same.where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    both = different.unionByName(same)
    return both.groupBy(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).agg(F.max("similarity").alias("similarity"))


def near_duplicate_classes(df: DataFrame, key: str, text: str, shape: Shape = Shape()) -> DataFrame:
    """One row per key: key, class (the least key with the same text), copies (keys of the class), links (similar texts of other classes).

    Copies are a class and are never paired, however many; a key that has several texts
    is in the class of each. Cases and nulls as in :func:`similar_classes`.
    """
    pairs, members, _ = similar_classes(df, key, text, shape)
    classes = members.groupBy("rid").agg(F.min("key").alias("class"), F.count("*").alias("copies"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    return members.join(classes, "rid").join(links, "rid", "left").select("key", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_groups(df: DataFrame, key: str, text: str, shape: Shape = Shape()) -> DataFrame:
    """Groups of versions: key, group (the least key of its component), for groups of two keys or more.

    Texts are linked by the pairs of :func:`similar_classes`; copies of one text are
    in one group without being paired. Cases and nulls as there.
    """
    pairs, members, texts = similar_classes(df, key, text, shape)
    linked = connected_components(pairs.select("a", "b"))
    single = _with_grams(texts.where("copies > 1"), shape).join(linked.select(F.col("id").alias("rid")), "rid", "left_anti")
    placed = linked.select(F.col("id").alias("rid"), "component").unionByName(single.select("rid", F.col("rid").alias("component")))
    keyed = members.join(placed, "rid").select("key", "component").distinct()
    names = keyed.groupBy("component").agg(F.min("key").alias("group"), F.countDistinct("key").alias("n")).where("n > 1")
    return keyed.join(names, "component").select("key", "group")
