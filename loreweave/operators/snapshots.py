"""Changes between full listings by ordinals, bitmaps and aligned columns.

Keys get persistent ordinals. The ordinals present in one listing form a bitmap
of 64-bit words of which only the non-zero ones are stored, so a sparse listing
is a short table. ``now & ~before`` gives the additions and ``before & ~now`` the
removals, 64 keys at a time. The values of a word's keys are a vector aligned to
its bits; comparing the vectors of two listings shows the changes among the keys
that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.storage import materialize

#: Ordinals are dealt out within this many hash shards, each in parallel; shard and rank make the ordinal.
SHARDS = 1024
_SHARD_BITS = 40


def assign_ordinals(keys: DataFrame, key_columns: list[str], known: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Dictionary of key columns and ``ordinal``, written to the shared folder.

    ``known`` is an earlier dictionary: its keys keep their ordinals and new keys
    follow after the last of their shard, in key order. Repeated keys count once;
    null is a key value like any other. An empty table gives an empty dictionary.
    """
    shard = F.pmod(F.xxhash64(*key_columns), F.lit(shards)).cast("bigint")
    fresh = keys.select(*key_columns).distinct()
    if known is not None:
        same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in key_columns]
        condition = same[0]
        for part in same[1:]:
            condition = condition & part
        fresh = fresh.alias("new").join(known.alias("old"), condition, "left_anti")
    order = Window.partitionBy("shard").orderBy(*[F.col(c).asc_nulls_first() for c in key_columns])
    fresh = fresh.withColumn("shard", shard).withColumn("place", F.row_number().over(order) - 1)
    if known is not None:
        last = known.groupBy(F.call_function("shiftright", "ordinal", F.lit(_SHARD_BITS)).alias("shard"))
        last = last.agg(F.max(F.col("ordinal").bitwiseAND(F.lit((1 << _SHARD_BITS) - 1))).alias("last"))
        fresh = fresh.join(last, "shard", "left").withColumn("place", F.col("place") + F.coalesce(F.col("last") + 1, F.lit(0)))
    ordinal = F.call_function("shiftleft", "shard", F.lit(_SHARD_BITS)) + F.col("place")
    dictionary = fresh.select(*key_columns, ordinal.cast("bigint").alias("ordinal"))
    return materialize(dictionary if known is None else known.select(*key_columns, "ordinal").unionByName(dictionary), "ordinals")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def _columns(listing: DataFrame) -> DataFrame:
    """Per listing and word: the bitmap word and the (bit, state) vector in bit order."""
    place = F.col("ordinal").bitwiseAND(F.lit(63)).cast("int")
    rows = listing.select("snapshot", F.call_function("shiftright", "ordinal", F.lit(6)).alias("word"), place.alias("bit"), "state")
    return rows.groupBy("snapshot", "word").agg(F.bit_or(_bit(F.col("bit"))).alias("bits"), F.sort_array(F.collect_list(F.struct("bit", "state"))).alias("vector"))


def snapshot_changes(df: DataFrame, snapshot: str, key_columns: list[str], state: Column, version: Column, known: DataFrame | None = None) -> DataFrame:
    """Differences of each listing from the one before: snapshot, key columns, change.

    ``df`` has one integer ``snapshot`` per listing; the listing before n is
    n - 1, and a listing without one before it reports nothing. ``state`` is what
    counts as content, compared null-safely; of several rows of a key in a
    listing the one with the greatest ``version`` holds, then the one with the
    greatest state. ``change`` is added, removed or changed. A key that returns
    after an absence is added. Rows with a null snapshot take no part; null keys
    are keys. A listing that is missing altogether, though a later one exists,
    is not taken for an empty one. Extra columns are ignored.
    """
    named = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).cast("bigint").alias("snapshot"), *key_columns, state.alias("state"), version.alias("version"))
    held = named.groupBy("snapshot", *key_columns).agg(F.max(F.struct("version", "state")).alias("m"))
    held = materialize(held.select("snapshot", *key_columns, F.xxhash64("m.state").alias("h0"), F.xxhash64(F.lit(7), "m.state").alias("h1")), "listing")
    dictionary = assign_ordinals(held, key_columns, known)
    same = [held[c].eqNullSafe(dictionary[c]) for c in key_columns]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    coded = held.join(dictionary, condition).select("snapshot", "ordinal", F.struct("h0", "h1").alias("state"))
    words = materialize(_columns(coded), "words")
    taken = words.select("snapshot").distinct()
    later = taken.select((F.col("snapshot") - 1).alias("snapshot")).join(taken, "snapshot").select((F.col("snapshot") + 1).alias("snapshot"))

    now = words.join(later, "snapshot", "left_semi").select("snapshot", "word", F.col("bits").alias("now"), F.col("vector").alias("now_vector"))
    before = words.withColumn("snapshot", F.col("snapshot") + 1).join(later, "snapshot", "left_semi")
    before = before.select("snapshot", "word", F.col("bits").alias("before"), F.col("vector").alias("before_vector"))
    both = now.join(before, ["snapshot", "word"], "full_outer")
    zero = F.lit(0).cast("bigint")
    a, b = F.coalesce("now", zero), F.coalesce("before", zero)
    common = a.bitwiseAND(b)

    def aligned(name: str) -> Column:
        kept = F.filter(name, lambda x: _bit(x["bit"]).bitwiseAND(F.col("common")) != 0)
        return F.coalesce(kept, F.array().cast("array<struct<bit:int,state:struct<h0:bigint,h1:bigint>>>"))

    both = both.select("snapshot", "word", a.bitwiseAND(F.bitwise_not(b)).alias("added"), b.bitwiseAND(F.bitwise_not(a)).alias("removed"), common.alias("common"), "now_vector", "before_vector")
    both = both.withColumns({"x": aligned("now_vector"), "y": aligned("before_vector")})
    differs = F.filter(F.zip_with("x", "y", lambda x, y: F.when(x["state"] != y["state"], x["bit"])), lambda bit: bit.isNotNull())
    places = F.sequence(F.lit(0), F.lit(63))

    def set_bits(name: str) -> Column:
        return F.when(F.col(name) == 0, F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: _bit(i).bitwiseAND(F.col(name)) != 0))

    def marked(bits: Column, kind: str) -> Column:
        return F.transform(bits, lambda i: F.struct(i.alias("bit"), F.lit(kind).alias("change")))

    marks = F.concat(marked(set_bits("added"), "added"), marked(set_bits("removed"), "removed"), marked(differs, "changed"))
    found = both.select("snapshot", "word", F.inline(marks))
    found = found.select("snapshot", (F.call_function("shiftleft", "word", F.lit(6)) + F.col("bit")).alias("ordinal"), "change")
    return found.join(dictionary, "ordinal").select(F.col("snapshot").alias(snapshot), *key_columns, "change")
