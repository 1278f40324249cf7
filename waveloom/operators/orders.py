"""Exact order statistics of large groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def ranks(df: DataFrame, key: str, x: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key the elements at given ranks (from 0, a function of the group's size) of the sorted values.

    No group is ever collected: values are counted with map-side combine, dealt into SLICES value slices per
    key between its extremes, and only the slice that holds a rank is ranked.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(key, x).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.groupBy(key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum("c").alias("n"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (SLICES - 1))).otherwise(F.lit(0))
    dealt = counts.join(ends, key).withColumn("slice", at.cast("int"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "slice").agg(F.sum("c").alias("m"), F.first("n").alias("n")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    targets = sizes.withColumn("r", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in wanted.items()])))
    targets = targets.filter("r.rank >= before AND r.rank < before + m").select(key, "slice", "before", "r.name", "r.rank")
    upto = Window.partitionBy(key, "slice", "name").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(targets, [key, "slice"]).withColumn("end", F.col("before") + F.sum("c").over(upto)).filter("end > rank AND end - c <= rank")
    return found.groupBy(key).pivot("name", list(wanted)).agg(F.first(x))
