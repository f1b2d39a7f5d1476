"""Mixing sources to target weights, interleaved by Pfair scheduling.

The documents of a source are put into a pseudo-random order and read as one
stream, again and again up to its number of repeats. Each source gives the first
part of its stream, as long as its share of the mix. The stream is cut into
blocks; block j of a source with weight w may be sent from slot ``floor(j / w)``
on and must be by slot ``ceil((j + 1) / w)``, and of the blocks that may be sent
the one with the earliest deadline is. So at any slot each source is less than
one block away from its weight.

Weights are whole numbers of ``period`` slots; then the schedule of one period,
a table of that many rows, repeats for ever, and a block's slot follows from its
number. Positions within a source come from sums over hash buckets and running
sums within a bucket, never from one window over a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.storage import materialize


@dataclass(frozen=True)
class Mix:
    """``total`` is the size to reach, or None for the largest at which no source with documents runs out."""

    total: int | None = None
    block: int = 2048
    period: int = 1000
    bucket_rows: int = 5000
    seed: int = 5


def plain_source(name: str | Column) -> Column:
    """Source names in one spelling: lower case, trimmed, hyphens for blanks and underscores."""
    column = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"[\s\p{Z}]+", " "))), "[ _]+", "-")


def quotas(shares: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers of slots that add up to the period, largest remainders first, at least one each."""
    total = sum(shares.values())
    exact = {s: w / total * period for s, w in shares.items() if w > 0}
    if len(exact) > period:
        raise ValueError("the period must have a slot for each source")  # mix_sources gives it ten
    given = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (given[s] - exact[s], s)):
        if sum(given.values()) < period:
            given[s] += 1
    while sum(given.values()) > period:
        given[max(given, key=lambda s: (given[s] - exact[s] if given[s] > 1 else -period, s))] -= 1
    return given


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """Slot of each block of one period by earliest deadline among the released: source, block, slot."""
    period = sum(slots.values())
    sent = dict.fromkeys(slots, 0)
    found = []
    for slot in range(period):
        free = [(-(-(n + 1) * period // slots[s]), s) for s, n in sent.items() if n < slots[s] and n * period // slots[s] <= slot]
        _, source = min(free)
        found.append((source, sent[source], slot))
        sent[source] += 1
    return found


def _budgets(sizes: DataFrame, targets: DataFrame, how: Mix) -> list[dict]:
    """Per target source: all it has, what it may give, and what it shall give. One row per target, whatever the data."""
    have = sizes.groupBy("source").agg(F.sum("size").alias("have"), F.count("*").alias("rows"))
    rows = [r.asDict() for r in targets.join(have, "source", "left").select("source", "share", "repeats", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("rows", F.lit(0)).alias("rows")).collect()]
    for r in rows:
        r["most"] = r["have"] * r["repeats"]
    able = [r for r in rows if r["most"] > 0 and r["share"] > 0]
    scale = min((r["most"] / r["share"] for r in able), default=0.0)
    if how.total is not None and able:
        # Raise the level until the total is reached; sources at their limit stay there.
        left, open_ = float(how.total), sorted(able, key=lambda r: r["most"] / r["share"])
        while open_:
            scale = left / sum(r["share"] for r in open_)
            if open_[0]["most"] >= open_[0]["share"] * scale:
                break
            left -= open_.pop(0)["most"]
    for r in rows:
        r["budget"] = int(min(r["most"], r["share"] * scale)) if r in able else 0
    return rows


def _running(sums: DataFrame, group: int = 4096) -> DataFrame:
    """``before``, the sum of a source's earlier buckets: within groups of buckets, and over the groups' sums."""
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    grouped = sums.withColumn("span", F.floor(F.col("bucket") / group))
    inner = grouped.withColumn("inner", F.coalesce(F.sum("n").over(ahead("source", "span").orderBy("bucket")), F.lit(0)))
    outer = grouped.groupBy("source", "span").agg(F.sum("n").alias("m")).withColumn("outer", F.coalesce(F.sum("m").over(ahead("source").orderBy("span")), F.lit(0)))
    return inner.join(outer, ["source", "span"]).select("source", "bucket", (F.col("inner") + F.col("outer")).alias("before"))


def schedule_deviation(mixed: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Of each source of a mix: source, slots, weight, deviation (the greatest distance, at any slot, between the blocks
    sent and the weight's share, in blocks) and longest (its largest document in blocks).

    Pfair keeps the deviation below 1. A document belongs to the block in which it starts, so what is sent by a slot can be
    off by ``longest`` more. For mixes of at most a tenth of ``period`` sources; an empty mix gives no rows.
    """
    taken = mixed.select("source", "slot", "size").withColumn("turn", F.floor(F.col("slot") / how.period))
    slots = taken.groupBy("source", "turn", "slot").agg(F.max("size").alias("longest"))
    # A slot belongs to one source, so a source's turn of the period has a bounded number of rows. Empty slots leave no rows: the first after one counts on.
    place = Window.partitionBy("source", "turn").orderBy("slot")
    ranked = slots.withColumn("n", F.row_number().over(place))
    quota = ranked.groupBy("source").agg(F.max("n").alias("quota"), F.count("*").alias("slots"))
    sent = F.col("turn") * F.col("quota") + F.col("n")
    due = lambda at: at * F.col("quota") / F.lit(float(how.period))
    off = F.greatest(F.abs(due(F.col("slot")) - (sent - 1)), F.abs(due(F.col("slot") + 1) - sent))
    both = ranked.join(quota, "source")
    return both.groupBy("source").agg(F.max("slots").alias("slots"), (F.max("quota") / how.period).alias("weight"), F.max(off).alias("deviation"), (F.max("longest") / how.block).alias("longest"))


def mix_sources(df: DataFrame, key: str, source: str | Column, size: str, targets: DataFrame, how: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``targets`` has source, share and repeats; of repeated sources the row with
    the greatest share holds. The mix has slot, place (order within the slot),
    source, the key, copy (0 for the first use) and size; a document is used
    ``repeats`` times at most. The report has source, target_share,
    reached_share, size, documents and max_copies for every target, also those
    without documents. Documents of other or null sources and those of null or no
    size take no part. Keys should be unique; other columns are ignored. Without
    documents the mix is empty and the reached shares are 0.
    """
    spark = df.sparkSession
    name = plain_source(source)
    targets = targets.select(plain_source("source").alias("source"), F.col("share").cast("double").alias("share"), F.col("repeats").cast("bigint").alias("repeats"))
    targets = targets.where("source is not null and share >= 0 and repeats >= 0").groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("m")).select("source", "m.*")
    rows = df.select(F.col(key).alias("key"), name.alias("source"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    sizes = materialize(rows.join(targets.select("source"), "source", "left_semi"), "sizes")
    plan = _budgets(sizes, targets, how)
    used = [r for r in plan if r["budget"] > 0]
    period = max(how.period, 10 * len(used))
    slots = quotas({r["source"]: r["budget"] for r in used}, period) if used else {}
    buckets = {r["source"]: max(1, -(-r["rows"] // how.bucket_rows)) for r in used}
    terms = [(r["source"], r["have"], r["budget"], r["repeats"], buckets[r["source"]], slots[r["source"]]) for r in used]
    terms = spark.createDataFrame(terms, "source string, have bigint, budget bigint, repeats bigint, buckets bigint, quota bigint")
    times = spark.createDataFrame(schedule(slots), "source string, turn bigint, slot_in_period bigint")

    # Both tables have as many rows as targets or slots in a period: parameters, not data.
    drawn = sizes.join(F.broadcast(terms), "source").withColumn("draw", F.xxhash64(F.lit(how.seed), "key"))
    drawn = drawn.withColumn("bucket", F.pmod("draw", "buckets"))
    sums = _running(drawn.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    inner = Window.partitionBy("source", "bucket").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = drawn.withColumn("upto", F.sum("size").over(inner)).join(sums.select("source", "bucket", "before"), ["source", "bucket"])
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    # A copy is used if the greater part of it lies within the budget.
    fits = F.floor((F.col("budget") - F.col("start") - F.col("size") / 2) / F.col("have")) + 1
    copies = F.least(F.greatest(fits, F.lit(0)), "repeats")
    each = placed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    at = F.col("copy") * F.col("have") + F.col("start")
    each = each.select("source", "key", "copy", "size", "quota", F.floor(at / how.block).alias("number"), (at % how.block).alias("place"))
    each = each.withColumn("turn", F.col("number") % F.col("quota")).join(F.broadcast(times), ["source", "turn"])
    slot = F.floor(F.col("number") / F.col("quota")) * period + F.col("slot_in_period")
    mixed = materialize(each.select(slot.alias("slot"), "place", "source", F.col("key").alias(key), "copy", "size"), "mix")

    given = mixed.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("documents"), (F.max("copy") + 1).alias("max_copies"))
    # A window over one row per target.
    given = given.withColumn("all", F.sum("size").over(Window.partitionBy(F.lit(1))))
    report = targets.join(given, "source", "left")
    report = report.select(
        "source", F.col("share").alias("target_share"), F.coalesce(F.col("size") / F.col("all"), F.lit(0.0)).alias("reached_share"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("size", "documents", "max_copies")],
    )
    return mixed, report
