"""All similar pairs of sets by metric pivot partitioning under Jaccard distance.

Pivots are records of the dense regions, however many there are: sets that agree
in a band of min-hashes elect one of them, so a region with several alike sets
gets a pivot of its own with near certainty, and a lonely set gets none. Every
record goes to the cell of the nearest pivot that it helped to elect, if that one
lies within ``near`` (its home, at distance h).

For a pair within ``eps = 1 - threshold`` let x be the one with the smaller
(h, id). The triangle inequality puts y within ``h(x) + eps`` of x's pivot, and
``h(x) <= h(y)``. So y visits each cell whose pivot lies within
``min(h(y), radius of the cell) + eps`` of it, and the pair meets in x's cell.
That bound is below 1, so the visits come from an equi-join on values, cut short
by the bound of each cell: both lists need only their rarest values.

Records without a home are only ever the x of pairs whose other record has none
either, so they are joined among themselves in a second round with pivots that
suit sparse regions: the one-value sets. In it, a record has distance
``1 - 1/size`` to each of its values' pivots and 1 to all others; of the equally
near ones the rarest value's is its home, and y visits the pivots of its values
that can be the rarest of a partner: its ``size - ceil(t * size) + 1`` rarest.
Both rounds are exact; which sets are elected changes no result.

Cells with more than ``crowd`` records are split by child pivots: one-value sets
in the cell of a record, two-value sets in the cell of a value. A pair shares the
one or two values that are its rarest common ones, so it meets in that child.

Cells are joined by an equi-join on the cell. Each pair is tested where it meets:
sizes, the pivot distances' difference (again the triangle inequality), a parity
signature of 128 bits, then the intersection itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.storage import materialize

_EPS = 1e-9


@dataclass(frozen=True)
class Pivots:
    """``bands`` elections of pivots by two min-hashes each; homes within ``near`` of a pivot (below the threshold); cells split beyond ``crowd``."""

    bands: int = 6
    near: float = 0.4
    crowd: int = 256
    threshold: float = 0.7
    min_size: int = 4

    @property
    def reach(self) -> float:
        return min(self.near, self.threshold - 2 * _EPS)


def normal_values(column: str | Column) -> Column:
    """Values in lower case without white space, hyphens and underscores; no nulls, empties or repeats."""
    column = F.col(column) if isinstance(column, str) else column
    plain = F.transform(column, lambda x: F.regexp_replace(F.lower(x), r"[\s\p{Z}\-_]+", ""))
    return F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "")))


def _classes(df: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """One row per different set (rid, grp, values as hashes from the rarest on, size, signature), and members (rid, side, key)."""
    hashed = F.array_sort(F.transform("values", lambda x: F.xxhash64("grp", x)))  # values of different groups are different
    rows = df.where(F.col("key").isNotNull() & (F.size("values") >= min_size)).select("grp", "side", "both", "key", hashed.alias("values"))
    rows = materialize(rows.withColumns({"h0": F.xxhash64("values"), "h1": F.xxhash64(F.lit(7), "values")}), "rows")
    sets = rows.groupBy("grp", "h0", "h1").agg(F.first("values").alias("values"), F.max((F.col("side") == 0).cast("int")).alias("left"), F.max((F.col("side") == 1).cast("int")).alias("right"))

    def word(low: bool) -> Column:
        flag = lambda x: F.when((x.bitwiseAND(F.lit(64)) == 0) == F.lit(low), F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate("values", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(flag(x)))

    sets = sets.select(
        F.monotonically_increasing_id().alias("rid"), "grp", "left", "right", "h0", "h1", "values",
        F.size("values").alias("size"), word(True).alias("low"), word(False).alias("high"),
    )
    sets = _rare_first(materialize(sets, "sets"))
    members = rows.select("grp", "h0", "h1", "side", "both", "key").distinct().join(sets.select("rid", "grp", "h0", "h1"), ["grp", "h0", "h1"])
    return sets.drop("h0", "h1"), materialize(members.select("rid", "grp", "both", "side", "key"), "members")


#: Most rows of a list that is broadcast, of values with their counts or of pivots' values (50 bytes each at most); longer ones are joined by a shuffle.
BROADCAST_ROWS = 400_000


def _short(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _rare_first(sets: DataFrame) -> DataFrame:
    """The sets with their values ordered by how many sets of the group have them, ties by the value."""
    counts = sets.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    placed = sets.repartition("rid")
    valued = placed.select("rid", F.explode("values").alias("value")).join(_short(materialize(counts, "counts")), "value")
    listed = valued.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("v"))
    ordered = listed.select("rid", F.transform("v", lambda x: x["value"]).alias("values"))
    return materialize(placed.drop("values").join(ordered, "rid"), "ordered")


def _least(size: Column, share: Column | float) -> Column:
    """Values that a set of this size must share with another of at least this similarity."""
    return F.ceil((F.lit(share) if isinstance(share, float) else share) * size - F.lit(_EPS)).cast("int")


def _homes(sets: DataFrame, how: Pivots) -> DataFrame:
    """Nearest elected pivot of each set within reach: rid, cell (the pivot's rid), h. A pivot that nobody else is near to has no cell."""
    low = lambda seed: F.array_min(F.transform("values", lambda x: F.xxhash64(F.lit(seed), x)))
    bands = F.array(*[F.xxhash64(F.lit(i), low(2 * i), low(2 * i + 1)) for i in range(how.bands)])
    voted = sets.select("rid", F.explode(bands).alias("band"))
    elected = voted.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(3), "rid").alias("order"), "rid"))["rid"].alias("cell"))
    pairs = voted.join(elected.where("n > 1").select("band", "cell"), "band").select("rid", "cell").distinct()
    far = _distance(pairs, sets).where(F.col("distance") <= F.lit(how.reach))
    homes = far.groupBy("rid").agg(F.min(F.struct("distance", "cell")).alias("m")).select("rid", F.col("m.cell").alias("cell"), F.col("m.distance").alias("h"))
    homes = materialize(homes, "elected")
    return homes.join(homes.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cell", "left_semi").select("rid", "cell", "h")


def _distance(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Jaccard distances of rid and cell."""
    one = sets.select("rid", F.col("values").alias("u"))
    two = sets.select(F.col("rid").alias("cell"), F.col("values").alias("v"))
    both = F.size(F.array_intersect("u", "v"))
    return pairs.join(one, "rid").join(two, "cell").select("rid", "cell", (1 - both / (F.size("u") + F.size("v") - both)).alias("distance"))


def _visits(sets: DataFrame, homes: DataFrame, how: Pivots) -> DataFrame:
    """The cells that each set must visit: rid, cell, h (1 without a home), at (its distance to the pivot)."""
    eps = 1 - how.threshold
    radius = homes.groupBy("cell").agg(F.max("h").alias("radius"))
    need = F.lit(1 - eps - _EPS) - F.col("radius")
    pivots = radius.join(sets.select(F.col("rid").alias("cell"), "size", "values", "low", "high"), "cell").withColumn("need", need)
    pivots = pivots.select("cell", F.col("size").alias("p_size"), "radius", "need", F.col("low").alias("p_low"), F.col("high").alias("p_high"), F.explode(F.slice("values", F.lit(1), F.col("size") - _least(F.col("size"), F.col("need")) + 1)).alias("value"))
    most = min(1.0, 1 - eps - how.reach - _EPS)
    placed = sets.select("rid", "size", "low", "high", F.posexplode(F.slice("values", F.lit(1), F.col("size") - _least(F.col("size"), most) + 1)).alias("place", "value"))
    fits = (F.least("size", "p_size") >= F.col("need") * F.greatest("size", "p_size") - F.lit(_EPS)) & (F.col("place") <= F.col("size") - _least(F.col("size"), F.col("need")))
    shared = F.ceil(F.col("need") / (1 + F.col("need")) * (F.col("size") + F.col("p_size")) - F.lit(_EPS))
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("p_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("p_high")))
    fits = fits & (apart <= F.col("size") + F.col("p_size") - 2 * shared)
    met = placed.join(_short(materialize(pivots, "pivots")), "value").where(fits).select("rid", "cell").distinct()
    found = _distance(met, sets).join(radius, "cell").join(homes.select("rid", "h"), "rid", "left")
    found = found.select("rid", "cell", F.coalesce("h", F.lit(1.0)).alias("h"), F.col("distance").alias("at"), "radius")
    return found.where(F.col("at") <= F.least("h", "radius") + F.lit(eps + _EPS)).drop("radius")


def _meet(visits: DataFrame, homes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs that meet in a child of a cell and are similar: a, b, similarity. Both sides have h, at and what the tests need of a set."""
    x, y = homes.alias("x"), visits.alias("y")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - F.lit(_EPS))
    apart = F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low"))) + F.bit_count(F.col("x.high").bitwiseXOR(F.col("y.high")))
    sides = ((F.col("x.left") == 1) & (F.col("y.right") == 1)) | ((F.col("x.right") == 1) & (F.col("y.left") == 1))
    met = x.join(
        y,
        (F.col("x.cell") == F.col("y.cell")) & (F.col("x.child") == F.col("y.child"))
        & ((F.col("x.h") < F.col("y.h")) | ((F.col("x.h") == F.col("y.h")) & (F.col("x.rid") < F.col("y.rid"))))
        & sides
        & (F.least("x.size", "y.size") >= F.lit(threshold) * F.greatest("x.size", "y.size") - F.lit(_EPS))
        & (F.abs(F.col("x.at") - F.col("y.at")) <= F.lit(1 - threshold + _EPS))
        & (apart <= F.col("x.size") + F.col("y.size") - 2 * need),
    )
    met = met.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()
    left = sets.select(F.col("rid").alias("a"), F.col("values").alias("u"))
    right = sets.select(F.col("rid").alias("b"), F.col("values").alias("v"))
    both = F.size(F.array_intersect("u", "v"))
    tested = met.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("u") + F.size("v") - both)).alias("similarity"))
    return tested.where(F.col("similarity") >= F.lit(threshold - _EPS))


#: What the tests of a pair need of a set.
_ABOUT = ("size", "low", "high", "left", "right")


def _crowded(cells: DataFrame, crowd: int) -> DataFrame:
    """``cells`` with ``crowded``, true in cells of more than ``crowd`` rows."""
    found = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("cell", F.lit(True).alias("crowded")), "crowded")
    joined = cells.join(_short(found), "cell", "left")
    return joined.withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def _dense_pairs(sets: DataFrame, visits: DataFrame, homes: DataFrame, how: Pivots) -> DataFrame:
    """First round: cells of record pivots; crowded ones are split by the rarest values of their records."""
    rare = F.slice("values", F.lit(1), F.col("size") - _least(F.col("size"), how.threshold) + 1)
    about = sets.select("rid", *_ABOUT, rare.alias("rare"))
    held = homes.select("rid", "cell", "h", F.col("h").alias("at"), F.lit(True).alias("home"))
    rows = _crowded(held.unionByName(visits.withColumn("home", F.lit(False))), how.crowd).join(about, "rid")
    split = F.when(F.col("crowded"), F.col("rare")).otherwise(F.array(F.lit(0).cast("bigint")))
    placed = materialize(rows.select("rid", "cell", "h", "at", "home", *_ABOUT, F.explode(split).alias("child")), "placed")
    return _meet(placed.where("not home"), placed.where("home"), sets, how.threshold)


def _sparse_pairs(sets: DataFrame, far: DataFrame, how: Pivots) -> DataFrame:
    """Second round, among records without a home: cells of one-value pivots; crowded ones are split by two-value pivots."""
    rows = sets.join(far, "rid").withColumn("least", _least(F.col("size"), how.threshold))
    at = F.lit(1.0) - 1 / F.col("size")
    # Two sets' rarest common value is among the first of either, the next one at most a place later.
    later = F.slice("values", F.col("place") + 2, F.greatest(F.col("size") - F.greatest("least", F.lit(1)) + 1 - F.col("place"), F.lit(0)))
    first = F.slice("values", F.lit(1), F.col("size") - F.col("least") + 1)
    cells = rows.select("rid", *_ABOUT, "least", "values", F.posexplode(first).alias("place", "cell"))
    cells = _crowded(cells.select("rid", *_ABOUT, "least", "cell", later.alias("later")), how.crowd)
    whole = F.when(~F.col("crowded") | (F.col("least") < 2), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    children = F.concat(whole, F.when(F.col("crowded"), F.col("later")).otherwise(F.array().cast("array<bigint>")))
    placed = cells.select("rid", "cell", at.alias("h"), at.alias("at"), *_ABOUT, F.explode(children).alias("child"))
    return _meet(placed, placed, sets, how.threshold)


def similar_sets(df: DataFrame, how: Pivots = Pivots()) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of different sets within each group, and the keys of each set.

    ``df`` has grp, side, both, key and values (see :func:`normal_values`). A group
    joined with itself has each row on side 0 and on side 1, and both true; one
    that joins two tables has the first on side 0, the second on side 1, and both
    false. Returns ``pairs(a, b, similarity, dense)`` over set ids, dense for those that met
    in the cell of a record, and ``members(rid, grp, both, side, key)``. Null keys, null sets and sets
    under ``min_size`` take no part; repeated rows count once; empty tables give empty results.
    """
    sets, members = _classes(df, how.min_size)
    homes = materialize(_homes(sets, how), "homes")
    visits = materialize(_visits(sets, homes, how), "visits")
    far = sets.select("rid").join(homes.select("rid"), "rid", "left_anti")
    dense = _dense_pairs(sets, visits, homes, how).withColumn("dense", F.lit(True))
    pairs = dense.unionByName(_sparse_pairs(sets, far, how).withColumn("dense", F.lit(False)))
    return materialize(pairs, "pairs"), members


def similar_set_pairs(df: DataFrame, how: Pivots = Pivots()) -> DataFrame:
    """All similar pairs of keys: grp, key_a, key_b, similarity.

    Pairs are unordered and of two different keys, ``key_a < key_b``, within a
    table and across two. Rows with equal sets pair up with similarity 1. Other
    cases as in :func:`similar_sets`.
    """
    pairs, members = similar_sets(df, how)
    one = members.where("side = 0").select("rid", "grp", "both", F.col("key").alias("x"))
    two = members.where("side = 1").select("rid", "grp", "both", F.col("key").alias("y"))
    pairs = pairs.drop("dense")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    different = ways.join(one.withColumnRenamed("rid", "a"), "a").join(two.select(F.col("rid").alias("b"), "y"), "b").drop("a", "b")
    same = one.join(two.select("rid", "y"), "rid").select(F.lit(1.0).alias("similarity"), "grp", "both", "x", "y")
    found = different.unionByName(same)
    found = found.where(F.when(F.col("both"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return found.groupBy("grp", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).agg(F.max("similarity").alias("similarity"))
