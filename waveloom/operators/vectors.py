"""Vectors per (key, t): dot products, self-similarity, offset search, centring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.operators import orders as O


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def self_similarity(df: DataFrame, key: str, v: str, lags: list[int]) -> DataFrame:
    """max(0, best dot product with the vector ``lag`` rows ahead)."""
    order = Window.partitionBy(key).orderBy("t")
    found = [F.coalesce(dot(v, F.lead(v, lag).over(order)), F.lit(0.0)) for lag in lags]
    return df.withColumn("self_sim", F.greatest(F.lit(0.0), *found))


def offset_similarity(a: DataFrame, b: DataFrame, v: str, reach: int) -> DataFrame:
    """Mean dot product of a's rows (t, v) with b's at t + d, for every |d| <= reach; rows without a partner are left out.
    An equi-join on t + d; a and b carry pair, the id of what is compared."""
    shifted = a.select("pair", "t", F.col(v).alias("va"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d")).withColumn("u", F.col("t") + F.col("d"))
    other = b.select("pair", F.col("t").alias("u"), F.col(v).alias("vb"))
    return shifted.join(other, ["pair", "u"]).groupBy("pair", "d").agg(F.avg(dot("va", "vb")).alias("sim"), F.count(F.lit(1)).alias("n"))


def best_offset(sims: DataFrame) -> DataFrame:
    """The offset with the greatest mean (6 decimals), the smallest d of equals."""
    order = Window.partitionBy("pair").orderBy(F.desc(F.round("sim", 6)), "d")
    return sims.withColumn("r", F.row_number().over(order)).filter("r = 1").select("pair", "d", "sim")


def centred(df: DataFrame, key: str, v: str, gate: float, measure: Column | None = None) -> DataFrame:
    """Per key subtract the mean vector, zero vectors shorter than gate times the upper median length (or ``measure``), normalise the rest.
    Dimensions are exploded, so the mean is an ordinary aggregate whatever the number of rows of a key."""
    measure = norm(v) if measure is None else measure
    length = df.select(key, "t", measure.alias("len"))
    median = O.ranks(length, key, "len", {"median": lambda n: F.floor(n / 2)})
    parts = df.select(key, "t", F.posexplode(v).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    vector = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda z: z["mean"]).alias("means"))
    out = df.join(vector, key).join(median, key)
    moved = F.zip_with(v, "means", lambda x, m: x.cast("double") - m)
    gone = measure < gate * F.col("median")
    out = out.withColumn("moved", moved).withColumn("size", norm("moved"))
    return out.withColumn("c", F.when(gone | (F.col("size") == 0), F.transform("moved", lambda x: F.lit(0.0))).otherwise(F.transform("moved", lambda x: x / F.col("size")))).drop("moved", "size", "means", "median")
