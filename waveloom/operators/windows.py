"""Series operators over (key, t, x): moving windows, edge conventions, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.plans.shared import stored


def ranked(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with t: 0, 1, ... within key by the given order (name a unique last column for ties)."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def centred(key: str, half: int):
    return Window.partitionBy(key).orderBy("t").rowsBetween(-half, half)


def moving_mean(df: DataFrame, key: str, of: Column, n: int, name: str = "m") -> DataFrame:
    """Mean over a centred window of 2 * (n // 2) + 1 rows, cut off at the ends of the series."""
    return df.withColumn(name, F.avg(of).over(centred(key, n // 2)))


def _edges(key: str, x: str, half: int) -> tuple[Column, Column, Column, Column]:
    """First and last value of the series, and how many rows of a centred window are missing before and after."""
    whole = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    missing_after = F.greatest(F.lit(0), F.col("t") + half - F.max("t").over(whole))
    return F.first(x).over(whole), F.last(x).over(whole), F.greatest(F.lit(0), half - F.col("t")), missing_after


def edge_mean(df: DataFrame, key: str, x: str, half: int, name: str = "m") -> DataFrame:
    """Mean of 2 * half + 1 values, the end values repeated outside the series."""
    first, last, before, after = _edges(key, x, half)
    return df.withColumn(name, (F.sum(x).over(centred(key, half)) + before * first + after * last) / (2 * half + 1))


def edge_median(df: DataFrame, key: str, x: str, half: int, name: str = "m") -> DataFrame:
    """Median of 2 * half + 1 values, the end values repeated outside the series."""
    first, last, before, after = _edges(key, x, half)
    held = F.concat(F.array_repeat(first, before.cast("int")), F.collect_list(x).over(centred(key, half)), F.array_repeat(last, after.cast("int")))
    return df.withColumn(name, F.element_at(F.array_sort(held), half + 1))


def trailing_max(df: DataFrame, key: str, x: str, n: int, bucket: Column) -> DataFrame:
    """Per key and bucket the maximum of the trailing n-row mean; the mean may reach back before the bucket."""
    mean = F.avg(x).over(Window.partitionBy(key).orderBy("t").rowsBetween(-(n - 1), 0))
    return df.withColumn("m", mean).withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.max("m").alias("peak"))


def runs(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive t where flag holds: key, a, b (inclusive), n."""
    held = df.filter(flag).withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy(key).orderBy("t")))
    return held.groupBy(key, "island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).drop("island")


def bridged(found: DataFrame, key: str, gap: Column | int) -> DataFrame:
    """Runs (key, a, b) merged where the next starts at most gap after the last end."""
    order = Window.partitionBy(key).orderBy("a")
    new = F.coalesce((F.col("a") - F.lag("b").over(order) > gap).cast("int"), F.lit(1))
    parts = found.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(key, "part").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n_runs")).drop("part")


def longest_run(found: DataFrame, key: str) -> DataFrame:
    """The longest run of each key, the first of equals."""
    best = Window.partitionBy(key).orderBy(F.desc("n"), "a")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def hopping(df: DataFrame, key: str, length: int, step: int, *aggregates: Column) -> DataFrame:
    """Blocks of ``length`` rows every ``step``; only whole blocks count as in [b*step, b*step + length)."""
    size = df.groupBy(key).agg(F.max("t").alias("top"))
    lowest = F.greatest(F.lit(0), F.floor((F.col("t") - length) / step) + 1)
    spread = df.withColumn("block", F.explode(F.sequence(lowest.cast("long"), F.floor(F.col("t") / step).cast("long"))))
    blocks = spread.groupBy(key, "block").agg(*aggregates)
    return blocks.join(size, key).filter(F.col("block") * step + length - 1 <= F.col("top")).drop("top")


def best_window(df: DataFrame, key: str, x: str, n: int, step: int) -> DataFrame:
    """Start and sum of the n-row window, starting at a multiple of step, with the greatest sum; first of equals. Only whole windows."""
    ahead = Window.partitionBy(key).orderBy("t").rowsBetween(0, n - 1)
    sums = df.withColumn("s", F.round(F.sum(x).over(ahead), 6)).withColumn("c", F.count(x).over(ahead)).filter((F.col("c") == n) & (F.col("t") % step == 0))
    best = Window.partitionBy(key).orderBy(F.desc("s"), "t")
    return sums.withColumn("r", F.row_number().over(best)).filter("r = 1").select(key, F.col("t").alias("start"), "s")


def best_stretch(df: DataFrame, key: str, x: str, want: int, least: int, step: int) -> DataFrame:
    """key, start, n, s: the stretch with the greatest sum (6 decimals, the first of equals), of n = ``want`` rows or half the key's if that is less,
    starting at a multiple of ``step``. Keys with n under ``least`` have none. A sum is the difference of two running ones, met by an equi-join."""
    size = df.groupBy(key).agg(F.floor(F.least(F.lit(want), F.count(F.lit(1)) / 2)).alias("n")).filter(F.col("n") >= least)
    upto = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = stored(df.select(key, "t", x, F.sum(x).over(upto).alias("upto")).join(size, key), "sums")
    ends = sums.select(key, (F.col("t") - F.col("n") + 1).alias("t"), F.col("upto").alias("end"))
    each = sums.filter(F.col("t") % step == 0).join(ends, [key, "t"]).select(key, "t", "n", F.round(F.col("end") - F.col("upto") + F.col(x), 6).alias("s"))
    return each.groupBy(key).agg(F.min(F.struct((-F.col("s")).alias("v"), "t", "n")).alias("b")).select(key, F.col("b.t").alias("start"), "b.n", (-F.col("b.v")).alias("s"))
