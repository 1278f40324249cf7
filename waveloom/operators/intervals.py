"""Algebra of half-open intervals [s, e) per key, of whole numbers or not. Overlap joins are equi-joins on buckets of time with the exact test behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.plans.shared import stored


def sane(df: DataFrame) -> DataFrame:
    return df.filter("s IS NOT NULL AND e IS NOT NULL AND e > s")


def coalesce(df: DataFrame, key: str) -> DataFrame:
    """Union of the intervals of a key; touching ones merge. Adds n, the intervals merged."""
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1))
    parts = sane(df).withColumn("new", new).withColumn("part", F.sum("new").over(upto))
    return parts.groupBy(key, "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("part")


def complement(merged: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """What merged intervals leave of [lo, hi) of each key in whole (key, lo, hi)."""
    inside = whole.join(merged, key, "left").withColumn("from", F.greatest("s", "lo")).withColumn("to", F.least("e", "hi"))
    inside = inside.withColumn("hit", F.col("s").isNotNull() & (F.col("to") > F.col("from")))
    first = inside.groupBy(key, "lo", "hi").agg(F.min(F.when(F.col("hit"), F.col("from"))).alias("e")).select(key, F.col("lo").alias("s"), F.coalesce("e", "hi").alias("e"))
    after = inside.filter("hit").select(key, F.col("to").alias("s"), F.coalesce(F.lead("from").over(Window.partitionBy(key).orderBy("from")), F.col("hi")).alias("e"))
    return first.unionByName(after).filter("e > s")


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / width), F.ceil(F.col("e") / width) - 1)))


def overlap_pairs(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of overlapping rows: a's columns and b's with prefix o_. Each pair once (in the first bucket they share)."""
    right = b.select(F.col(key).alias("o_key"), *[F.col(c).alias(f"o_{c}") for c in b.columns if c != key])
    right = right.withColumn("o_bucket", F.explode(F.sequence(F.floor(F.col("o_s") / width), F.ceil(F.col("o_e") / width) - 1)))
    pairs = _bucketed(a, width).join(right, (F.col(key) == F.col("o_key")) & (F.col("bucket") == F.col("o_bucket")))
    once = F.col("bucket") == F.floor(F.greatest("s", "o_s") / width)
    return pairs.filter((F.col("s") < F.col("o_e")) & (F.col("o_s") < F.col("e")) & once).drop("bucket", "o_bucket", "o_key")


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int, keep: bool = True) -> DataFrame:
    """Rows of a that overlap (keep) or don't overlap any row of b of the same key; a has distinct (key, s, e)."""
    hit = overlap_pairs(a, b, key, width).select(key, "s", "e").distinct()
    return a.join(hit, [key, "s", "e"], "left_semi" if keep else "left_anti")


def accepted(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """Of the intervals of a key, taken in order of (s, e, ties), those that overlap none accepted before.

    After an accepted interval comes the first one in order that starts at or after its end, so the accepted ones are the chain of these
    pointers from the first interval of each island of overlapping ones. Pointers come from one window over starts and ends; the chain is marked
    by pointer jumping, in as many rounds as the longest island's chain has binary digits, over rows and not over keys.
    """
    order = Window.partitionBy(key).orderBy("s", "e", *ties)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    held = sane(df).withColumn("__i", F.row_number().over(order).cast("long")).withColumn("__first", F.coalesce(F.col("s") >= F.max("e").over(upto), F.lit(True)))
    held = stored(held, "intervals")
    ends = held.select(key, F.col("e").alias("at"), F.lit(0).alias("side"), F.col("__i").alias("own"), F.lit(None).cast("long").alias("next"))
    starts = held.select(key, F.col("s").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("own"), F.col("__i").alias("next"))
    ahead = Window.partitionBy(key).orderBy("at", "side", "next").rowsBetween(0, Window.unboundedFollowing)
    after = ends.unionByName(starts).withColumn("next", F.first("next", True).over(ahead)).filter("side = 0").select(key, F.col("own").alias("i"), "next")
    first = held.filter("__first").select(key, F.col("__i").alias("i"))
    # islands are chains of their own: a pointer to the first interval of an island leads to what is marked already
    jumps = stored(after.join(first.select(key, F.col("i").alias("next")), [key, "next"], "left_anti").filter("next IS NOT NULL").select(key, "i", "next"), "jumps")
    marked = stored(first, "marked")
    while not jumps.isEmpty():
        marked = stored(marked.union(marked.join(jumps, [key, "i"]).select(key, F.col("next").alias("i"))), "marked")
        jumps = stored(jumps.join(jumps.select(key, F.col("i").alias("next"), F.col("next").alias("beyond")), [key, "next"]).select(key, "i", F.col("beyond").alias("next")), "jumps")
    return held.join(marked.withColumnRenamed("i", "__i"), [key, "__i"], "left_semi").drop("__i", "__first")


def union_without_overlap(groups: list[DataFrame], key: str, width: int) -> DataFrame:
    """Intervals of the first group, then of each next one, in order of (s, e), those that overlap nothing kept, their own group's included.
    The first group is taken as it is. Groups have the same columns and distinct (key, s, e)."""
    kept = groups[0]
    for more in groups[1:]:
        kept = stored(kept.unionByName(accepted(overlapping(more, kept, key, width, keep=False), key)), "kept")
    return kept


def covered(merged: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Share of [lo, hi) that merged intervals cover, 0 without any."""
    part = F.greatest(F.lit(0), F.least("e", "hi") - F.greatest("s", "lo"))
    return whole.join(merged, key, "left").groupBy(key).agg((F.coalesce(F.sum(part), F.lit(0)) / F.max(F.col("hi") - F.col("lo"))).alias("fraction"))


def rows_in(points: DataFrame, spans: DataFrame, key: str, at: Column, width: int) -> DataFrame:
    """Points of a key inside one of its spans, once for each span (o_s, o_e)."""
    right = spans.select(F.col(key).alias("o_key"), F.col("s").alias("o_s"), F.col("e").alias("o_e"))
    right = right.withColumn("o_bucket", F.explode(F.sequence(F.floor(F.col("o_s") / width), F.ceil(F.col("o_e") / width) - 1)))
    left = points.withColumn("at", at).withColumn("bucket", F.floor(F.col("at") / width))
    return left.join(right, (F.col(key) == F.col("o_key")) & (F.col("bucket") == F.col("o_bucket"))).filter("at >= o_s AND at < o_e").drop("bucket", "o_bucket", "o_key")
