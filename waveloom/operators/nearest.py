"""As-of joins: the nearest row in time of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward_forward(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str) -> DataFrame:
    """left with near_at and near_value: the right row nearest in time, the earlier of equally near ones; of several at one time the largest value.

    Both sides are sorted together once per key; the last right row at or before
    and the first one after come from two running windows, so no pair of rows is made.
    left carries a unique row_id; times are longs.
    """
    mark = left.select(key, F.col(at).alias("at"), "row_id", F.lit(None).cast("struct<at:bigint,v:double>").alias("r"), F.lit(1).alias("side"))
    once = right.groupBy(key, F.col(right_at).cast("long").alias("at")).agg(F.max(F.col(value).cast("double")).alias("v"))  # one row a time, so either window meets the same one
    point = once.select(key, "at", F.lit(None).cast("long").alias("row_id"), F.struct("at", "v").alias("r"), F.lit(0).alias("side"))
    order = Window.partitionBy(key).orderBy("at", "side", "r")
    both = mark.unionByName(point.repartition(key, "at"))  # not dealt by key alone: Spark 4.1 takes a union of two sides dealt so for dealt, also where their partitions don't match
    before = F.last("r", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("r", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("before", before).withColumn("after", after).filter("side = 1")
    earlier = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col("at") - F.col("before.at") <= F.col("after.at") - F.col("at")))
    pick = F.when(earlier, F.col("before")).otherwise(F.col("after"))
    return left.join(near.select("row_id", pick["at"].alias("near_at"), pick["v"].alias("near_value")), "row_id")
