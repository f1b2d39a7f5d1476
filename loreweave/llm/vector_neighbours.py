"""Nearest neighbours of every vector by multiprobe p-stable hashing.

Each of ``tables`` hash tables projects a unit vector on ``hashes`` Gaussian
directions, shifts the projections and cuts them into cells; the whole numbers of
the cells name a bucket. Cells are nested: a crowded one is cut in half along the
next direction, so buckets hold about ``root * sqrt(n)`` of n vectors in dense and
sparse regions alike, and a dense group is told apart by finer cells instead of
being compared with itself. A vector lies in its home bucket and also visits the
``probes`` perturbed buckets most likely to hold its neighbours: those that lie
nearest beyond the walls of its own (Lv et al., VLDB 2007: the perturbation sets
in the order of their expected distance, applied to the walls sorted by
distance).

Directions are drawn with the covariance of a sample of at most ``sample``
vectors, and the sample says which cells are crowded; every vector is placed and
compared. Both are one broadcast of a size that the sample bounds.

Rows travel to the buckets as eight-bit vectors. Within a bucket the similarities
of visitors and residents are one matrix product; the best of each visitor go on.
Candidates of all buckets are merged per visitor, those that rounding can't rule
out are joined with the full vectors and ranked by the exact cosine in double
precision.

A bucket that stays crowded after ``cuts`` cuts is split: its residents are
salted into parts of about ``part_rows`` and each visitor goes to all parts, so no
pair is lost and no task holds an unbounded bucket.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.shingles import mix
from loreweave.storage import materialize

#: Eight-bit rounding moves a cosine by less than this (measured maximum 0.006 for 64 numbers).
SLACK = 0.012
#: Standard deviations from the middle at which the outermost cells are closed; farther projections fall into them.
EDGE = 2.5


@dataclass(frozen=True)
class Hashing:
    """Parameters of the tables: number, directions, perturbed buckets, bucket size over the root of the number of vectors."""

    tables: int = 4
    hashes: int = 16
    probes: int = 31
    root: float = 1.0
    cuts: int = 160
    part_rows: int = 16_384
    sample: int = 1 << 15
    seed: int = 11

    def crowd(self, vectors: int, sampled: int) -> float:
        """Rows of the sample above which a cell is cut; eight or more, so that the sample can tell."""
        return max(8.0, self.root * max(vectors, 1) ** 0.5 * sampled / max(vectors, 1))


#: For neighbours however similar, and for those of a cosine of 0.9 or more, which share a bucket far more often.
WIDE = Hashing()
NEAR = Hashing(tables=3, probes=3, root=3.0)


def probe_sets(hashes: int, count: int) -> list[tuple[int, ...]]:
    """The ``count`` best sets of walls to cross, as ranks of the 2 * hashes walls by distance.

    The expected squared distance of the j-th nearest wall orders the sets; a set
    never holds both walls of one hash, whose ranks add up to 2 * hashes - 1.
    """
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2)) for i in range(m, 0, -1)]
    heap, found = [(cost[0], (0,))], []
    while heap and len(found) < count:
        total, ranks = heapq.heappop(heap)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
        if all(2 * m - 1 - r not in ranks for r in ranks):
            found.append(ranks)
    return found


class _Table:
    """One hash table: directions, shift, and the crowded cells of each level."""

    def __init__(self, sample: np.ndarray, how: Hashing, crowd: float, vectors: int, rng: np.random.Generator) -> None:
        dim = sample.shape[1]
        m = self.m = min(how.hashes, dim)
        self.centre = sample.mean(axis=0)
        apart = sample - self.centre
        spread = apart.T @ apart / max(len(sample), 1)
        spread += np.eye(dim) * (1e-6 * np.trace(spread) / dim + 1e-12)
        self.lines = np.linalg.qr(spread @ rng.normal(size=(dim, m)))[0]
        self.size = np.maximum((apart @ self.lines).std(axis=0), 1e-6) if len(sample) else np.ones(m)
        self.shift = rng.uniform(-1, 1, m)
        self.keys = rng.integers(1, 2**62, m, dtype=np.int64) * 2 + 1
        self.marks = rng.integers(1, 2**62, how.cuts + 1, dtype=np.int64)
        self.crowded: list[np.ndarray] = []
        at, live = self.at(sample), np.arange(len(sample))
        names, cells = np.full(len(sample), self.marks[0]), np.zeros((len(sample), m), np.int64)
        settled = []
        for level in range(how.cuts + 1):
            found, inverse, count = np.unique(names[live], return_inverse=True, return_counts=True)
            full = (count > crowd) & (level < how.cuts)
            settled.append((found[~full], count[~full]))
            if not full.any():
                break
            self.crowded.append(found[full])
            live = live[full[inverse]]
            self._cut(names, cells, at, live, level)
        found, count = (np.concatenate(x) for x in zip(*settled))
        parts = np.ceil(count * vectors / max(len(sample), 1) / how.part_rows).astype(np.int64)
        order = np.argsort(found[parts > 1])
        self.split, self.parts = found[parts > 1][order], parts[parts > 1][order]

    def _cut(self, names: np.ndarray, cells: np.ndarray, at: np.ndarray, live: np.ndarray, level: int) -> None:
        """Move the live points to the half of their cell, in the direction of this level."""
        d = level % self.m
        cell = np.floor(at[live, d] / (2 * EDGE / 2 ** (level // self.m + 1))).astype(np.int64)
        names[live] += (cell - cells[live, d]) * self.keys[d] + (self.marks[level + 1 : level + 2] - self.marks[level : level + 1])
        cells[live, d] = cell

    def at(self, unit: np.ndarray) -> np.ndarray:
        """Shifted projections in standard deviations, counted from the lower edge."""
        return np.clip((unit - self.centre) @ self.lines / self.size + self.shift, -EDGE, EDGE - 1e-9) + EDGE

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket name, number of cuts and cells of each point: it moves to a half while its cell is crowded."""
        names, level = np.full(len(at), self.marks[0]), np.zeros(len(at), np.int64)
        cells, live = np.zeros((len(at), self.m), np.int64), np.arange(len(at))
        for j, crowded in enumerate(self.crowded):
            mine = names[live]
            live = live[crowded[np.minimum(np.searchsorted(crowded, mine), len(crowded) - 1)] == mine]
            if not len(live):
                break
            self._cut(names, cells, at, live, j)
            level[live] = j + 1
        return names, level, cells

    def probed(self, at: np.ndarray, level: np.ndarray, cells: np.ndarray, sets: list[tuple[int, ...]]) -> list[np.ndarray]:
        """Names of the perturbed buckets in estimated success order; the home's where a wall doesn't exist."""
        m, rows = self.m, np.arange(len(at))
        width = 2 * EDGE / 2.0 ** ((level[:, None] + m - 1 - np.arange(m)) // m)
        low, high = cells * width, (cells + 1) * width
        walls = np.concatenate([np.where(low > 1e-9, at - low, np.inf) * self.size, np.where(high < 2 * EDGE - 1e-9, high - at, np.inf) * self.size], axis=1)
        order = np.argsort(walls, axis=1, kind="stable")
        names = []
        for ranks in sets:
            point = at.copy()
            for rank in ranks:
                wall = order[:, rank]
                d = wall % m
                moved = np.where(wall < m, low[rows, d] - 1e-9, high[rows, d])
                point[rows, d] = np.where(np.isfinite(walls[rows, wall]), moved, point[rows, d])
            names.append(self.place(point)[0])
        return names


class _Tables:
    """All tables and the order of the probes."""

    def __init__(self, how: Hashing, sample: np.ndarray, vectors: int) -> None:
        rng = np.random.default_rng(how.seed)
        crowd = how.crowd(vectors, len(sample))
        self.tables = [_Table(sample, how, crowd, vectors, rng) for _ in range(how.tables)]
        self.sets = probe_sets(self.tables[0].m, how.probes)

    def visits(self, unit: np.ndarray, rid: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bucket, row number and whether the row is at home there; only rows that ask visit other buckets."""
        askers = np.flatnonzero(asks)
        for table in self.tables:
            at = table.at(unit)
            home, level, cells = table.place(at)
            names = np.stack([home[askers], *table.probed(at[askers], level[askers], cells[askers], self.sets)], axis=1)
            names[:, 1:].sort(axis=1)
            fresh = names[:, 1:] != home[askers][:, None]
            fresh[:, 1:] &= names[:, 2:] != names[:, 1:-1]
            asker, probe = np.nonzero(fresh)
            yield from self._parts(table, home, np.arange(len(home)), rid, True, asks)
            yield from self._parts(table, names[asker, probe + 1], askers[asker], rid, False, asks)

    @staticmethod
    def _parts(table: _Table, names: np.ndarray, rows: np.ndarray, rid: np.ndarray, home: bool, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts = np.ones(len(names), np.int64)
        if len(table.split):
            spot = np.minimum(np.searchsorted(table.split, names), len(table.split) - 1)
            parts = np.where(table.split[spot] == names, table.parts[spot], 1)
        own = mix(rid[rows].astype(np.uint64)).astype(np.int64) & np.int64(2**62 - 1)
        step = np.int64(0x1E3779B97F4A7C15)
        if home:
            yield names + own % parts * step, rows, np.ones(len(rows), bool)
        split = np.flatnonzero((parts > 1) & asks[rows]) if home else np.arange(len(names))
        times = parts[split]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        again = np.repeat(split, times)
        if home:  # its own part has it as a resident
            keep = part != own[again] % parts[again]
            part, again = part[keep], again[keep]
        yield names[again] + part * step, rows[again], np.zeros(len(again), bool)


def _unit(column: pa.ListArray, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _sampled(vectors: DataFrame, count: int, how: Hashing, dim: int) -> np.ndarray:
    """At most ``how.sample`` unit vectors, spread over the data by the hash of their id."""
    share = min(1.0, 0.9 * how.sample / max(count, 1))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(how.seed), "rid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vector").limit(how.sample)
    return _unit(drawn.toArrow().column("vector").combine_chunks(), dim)


def _visits(vectors: DataFrame, tables, dim: int) -> DataFrame:
    """One row per vector and visited bucket: bucket, rid, home, asks, packed vector."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("vector"), dim)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            scale = 127 / np.abs(unit).max(axis=1, keepdims=True)
            packed = np.rint(unit * scale).astype(np.int8)
            packed = pa.Array.from_buffers(pa.binary(dim), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            whole = pa.record_batch([batch.column("rid"), batch.column("asks"), packed], ["rid", "asks", "packed"])
            for names, rows, home in tables.value.visits(unit, batch.column("rid").to_numpy(), asks):
                some = whole.take(pa.array(rows))
                yield pa.record_batch([pa.array(names), some.column("rid"), pa.array(home), some.column("asks"), some.column("packed")], ["bucket", "rid", "home", "asks", "packed"])

    return vectors.select("rid", "asks", "vector").mapInArrow(emit, "bucket bigint, rid bigint, home boolean, asks boolean, packed binary")


def _matches(sorted_visits: DataFrame, dim: int, keep: int, least: float) -> DataFrame:
    """Best ``keep`` residents of each row that asks within its bucket, by the rounded vectors, and all within the rounding error of them: a asks, b is near it; residents come first in a bucket."""
    block = 2048

    def scaled(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def meet(rid: np.ndarray, x: np.ndarray, base_rid: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(x), block):
            near = x[start : start + block] @ base.T
            mine = rid[start : start + block]
            near[mine[:, None] == base_rid[None, :]] = -2
            good = near >= np.float32(least)
            many = np.flatnonzero(good.sum(axis=1) > keep)
            if len(many):
                # Rounding can lower a true winner and raise the last one kept, each by up to SLACK.
                floor = np.partition(near[many], -keep, axis=1)[:, -keep:].min(axis=1, keepdims=True) - np.float32(2 * SLACK)
                good[many] &= near[many] >= floor
            q, b = np.nonzero(good)
            yield mine[q], base_rid[b], near[q, b]

    class Open:
        """A bucket whose rows go on in the next batch: its residents, who come first, are held; visitors pass through."""

        def __init__(self, cell: int) -> None:
            self.cell, self.rid, self.x, self.asks, self.met = cell, [], [], [], False

        def add(self, rid: np.ndarray, home: np.ndarray, asks: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            if home.any():
                self.rid.append(rid[home])
                self.x.append(scaled(x[home]))
                self.asks.append(asks[home])
            if not home.all() and self.rid:
                yield from self.close()
                yield from meet(rid[~home], scaled(x[~home]), self.rid[0], self.x[0])

        def close(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            if self.rid and not self.met:
                self.rid, self.x, self.met = [np.concatenate(self.rid)], [np.concatenate(self.x)], True
                asks = np.concatenate(self.asks)
                yield from meet(self.rid[0][asks], self.x[0][asks], self.rid[0], self.x[0])

    def out(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            a, b, near = (np.concatenate(part) for part in zip(*found))
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(near.astype(np.float32))], ["a", "b", "near"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("bucket").to_numpy()
            packed = batch.column("packed").cast(pa.large_binary())
            start = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset]
            x = np.frombuffer(packed.buffers()[2], dtype=np.int8)[start : start + batch.num_rows * dim].reshape(-1, dim)
            rid, home, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "home", "asks"))
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            ends = np.append(first[1:], len(cells))
            live = (ends - first > 1) & (np.add.reduceat(home.astype(np.int64), first) > 0)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if held is not None and held.cell == cells[0]:
                found.extend(held.add(rid[: ends[0]], home[: ends[0]], asks[: ends[0]], x[: ends[0]]))
                live[0] = False
            if held is not None and (len(first) > 1 or held.cell != cells[0]):
                found.extend(held.close())
                held = None
            if held is None:  # the last bucket may go on
                held, live[-1] = Open(cells[-1]), False
                found.extend(held.add(rid[first[-1] :], home[first[-1] :], asks[first[-1] :], x[first[-1] :]))
            for a, b in zip(first[live], ends[live]):
                all_x, mine, asking = scaled(x[a:b]), home[a:b], asks[a:b]
                found.extend(meet(rid[a:b][asking], all_x[asking], rid[a:b][mine], all_x[mine]))
            yield from out(found)
        if held is not None:
            yield from out(list(held.close()))

    return sorted_visits.mapInArrow(emit, "a bigint, b bigint, near float")


def _promising(matches: DataFrame, keep: int) -> DataFrame:
    """Different pairs (a < b) of which rounding can't rule out that one is among the ``keep`` best of the other."""
    best = Window.partitionBy("a").orderBy(F.desc("near"), "b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    once = matches.repartition("a").dropDuplicates(["a", "b"])
    ranked = once.withColumn("floor", F.coalesce(F.nth_value("near", keep).over(best), F.lit(-2.0)) - F.lit(2 * SLACK))
    return ranked.where("near >= floor").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _exact(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Cosines of the pairs in double precision."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("ij,ij->i", _unit(batch.column("u"), dim), _unit(batch.column("v"), dim))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(cosine)], ["a", "b", "cosine"])

    left = vectors.select(F.col("rid").alias("a"), F.col("vector").alias("u"))
    right = vectors.select(F.col("rid").alias("b"), F.col("vector").alias("v"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v").mapInArrow(emit, "a bigint, b bigint, cosine double")


def _unique_vectors(df: DataFrame, key: str, vector: str, dim: int, asks: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per different vector (rid, asks, vector) and its keys (rid, key, asks); all ask unless told which keys do."""
    v = F.col("vector")
    asking = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), asking.alias("asks"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("key").isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(sound)
    rows = rows.withColumns({"h0": F.xxhash64("vector"), "h1": F.xxhash64(F.lit(7), "vector")})
    unique = rows.groupBy("h0", "h1").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks"))
    unique = materialize(unique.select(F.monotonically_increasing_id().alias("rid"), "*"), "vectors")
    members = rows.groupBy("key", "h0", "h1").agg(F.max("asks").alias("asks")).join(unique.select("rid", "h0", "h1"), ["h0", "h1"])
    return unique, materialize(members.select("rid", "key", "asks"), "members")


def _of_keys(both: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ``k`` best other keys of each key, from cosines (a, b, cosine) of different vectors and the keys of each vector."""
    # At most k + 1 members of a text's class can be among the k best others of anything.
    by_key = Window.partitionBy("rid").orderBy("key")
    few = members.drop("asks").withColumn("n", F.row_number().over(by_key)).where(F.col("n") <= k + 1).select(F.col("rid").alias("b"), F.col("key").alias("neighbour"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour")
    of_class = both.join(few, "b").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n", "b")
    # Of its own class the key itself is passed over, so k + 1 of them are kept.
    shared = few.join(few.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b"), "b", "left_semi")
    own = shared.select(F.col("b").alias("a"), F.lit(1.0).alias("cosine"), "neighbour")
    rows = members.where("asks").select(F.col("rid").alias("a"), "key").join(of_class.unionByName(own), "a").where(F.col("key") != F.col("neighbour"))
    rank = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    ranked = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("key", "neighbour", F.col("cosine").alias("similarity"), "rank")


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, *, k: int = 5, dim: int = 64, min_similarity: float = -1.0, asks: Column | None = None, how: Hashing = WIDE
) -> DataFrame:
    """The ``k`` most similar other keys of each key: key, neighbour, similarity, rank.

    Similarity is the cosine, at least ``min_similarity``; ties go to the smaller
    key. ``asks`` says which rows ask (all without it; a null is none); they are compared with all
    rows. Vectors that are null, all zero, of another length or with a null or
    non-finite number take no part. ``WIDE`` finds neighbours however similar, ``NEAR`` is
    enough for a least similarity of 0.9. Copies of one vector are neighbours of each
    other at similarity 1. Repeated rows count once, other columns are ignored,
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors, members = _unique_vectors(df, key, vector, dim, asks)
    count = vectors.count()
    sample = _sampled(vectors, count, how, dim) if count else np.zeros((1, dim))
    tables = spark.sparkContext.broadcast(_Tables(how, sample, count))
    grouped = _visits(vectors, tables, dim).repartition("bucket").sortWithinPartitions("bucket", F.desc("home"))
    matches = _matches(grouped, dim, k + 2, min_similarity - SLACK)
    pairs = materialize(_promising(matches, k + 2), "pairs")
    near = _exact(pairs, vectors, dim).where(F.col("cosine") >= min_similarity)

    both = near.select("a", "b", "cosine").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    return _of_keys(both, members, k)


def _scan(grid: DataFrame, dim: int, k: int) -> DataFrame:
    """The ``k`` nearest residents of each visitor in its cell of the grid, ties included: a, b, cosine; residents come first in a cell."""
    rows, step, error = 1024, 4096, np.float32(1e-5)  # a float32 product of unit vectors is off by less

    def best(x: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        small, all_base = x.astype(np.float32), base.astype(np.float32)
        for start in range(0, len(x), rows):
            part = small[start : start + rows]
            floor = np.full(len(part), -2, dtype=np.float32)
            q, b, value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
            for at in range(0, len(base), step):
                near = part @ all_base[at : at + step].T
                if near.shape[1] > k + 1 and not at:
                    floor = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)]  # itself may be among them
                more, other = np.nonzero(near >= (floor - error)[:, None])
                q, b, value = np.concatenate([q, more]), np.concatenate([b, other + at]), np.concatenate([value, near[more, other]])
                order = np.lexsort((-value, q))
                q, b, value = q[order], b[order], value[order]
                first = np.searchsorted(q, np.arange(len(part)))
                last = first + k
                full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == np.arange(len(part)))
                floor[full] = value[last[full]]
                keep = value >= (floor - error)[q]
                q, b, value = q[keep], b[keep], value[keep]
            yield q + start, b, np.einsum("ij,ij->i", x[q + start], base[b])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, base_rid, base = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, rid, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "rid", "home"))
            x = _unit(batch.column("vector"), dim)
            ends = np.append(np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells))
            for start, end in zip(np.append(0, ends[:-1]), ends):
                if cells[start] != cell:
                    cell, base_rid, base = cells[start], [], []
                mine = home[start:end]
                if mine.any():
                    base_rid.append(rid[start:end][mine])
                    base.append(x[start:end][mine])
                if mine.all() or not base:
                    continue
                base_rid, base = [np.concatenate(base_rid)], [np.concatenate(base)]
                visitors = rid[start:end][~mine]
                for q, b, cosine in best(x[start:end][~mine], base[0]):
                    other = visitors[q] != base_rid[0][b]
                    yield pa.record_batch([pa.array(visitors[q][other]), pa.array(base_rid[0][b][other]), pa.array(cosine[other])], ["a", "b", "cosine"])

    return grid.mapInArrow(emit, "a bigint, b bigint, cosine double")


def exact_neighbours(df: DataFrame, key: str, vector: str, *, k: int = 5, dim: int = 64, block: int = 65_536) -> DataFrame:
    """As ``nearest_neighbours`` without a least similarity, by comparing all vectors with all: nothing is lost.

    Vectors are cut into parts of about ``block``; each cell of the grid of parts is compared by
    matrix products and sends on its ``k`` best of each vector. Work is quadratic.
    """
    vectors, members = _unique_vectors(df, key, vector, dim)
    parts = (max(vectors.count(), 1) - 1) // block + 1
    own, turn = F.pmod(F.xxhash64("rid"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    placed = vectors.select("rid", "vector", own.alias("own"), turn.alias("turn"))
    cells = [placed.select((F.col(x) * parts + F.col(y)).alias("cell"), "rid", F.lit(home).alias("home"), "vector") for x, y, home in (("own", "turn", True), ("turn", "own", False))]
    grid = cells[0].unionByName(cells[1]).repartition(parts * parts, "cell").sortWithinPartitions("cell", F.desc("home"))
    return _of_keys(_scan(grid, dim, k), members, k)


def neighbour_pairs(df: DataFrame, key: str, vector: str, *, k: int = 5, dim: int = 64, min_similarity: float = -1.0, how: Hashing = WIDE) -> DataFrame:
    """Unordered pairs of which one is among the ``k`` most similar of the other: key_a, key_b."""
    near = nearest_neighbours(df, key, vector, k=k, dim=dim, min_similarity=min_similarity, how=how)
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
