"""Two bounded helpers against skew: a lookup that sends the commonest keys whole, and a one-sided filter of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOT = 50_000  # keys that hold more than this part of all rows are broadcast, so there are fewer than this many
SLOTS = 1 << 27  # bits of a filter: 4,096 bitmaps of 4 KB, 16 MB in all whatever the data


def looked_up(rows: DataFrame, known: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined to known (one row a key; ``weight``: how many of the ``total`` rows have the key).

    Keys with weight * MOST_HOT > total are fewer than MOST_HOT and are broadcast. The others are joined by shuffle, where no key has more than
    total / MOST_HOT rows. rows is read twice, so it should be a stored table.
    """
    common, rare = known.filter(F.col(weight) * MOST_HOT > total), known.filter(F.col(weight) * MOST_HOT <= total)
    met = rows.join(F.broadcast(common), key)
    rest = rows.join(F.broadcast(common.select(key)), key, "left_anti")
    return met.unionByName(rest.join(rare, key, "left").select(met.columns))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def bitmaps(rows: DataFrame, key: Column) -> DataFrame:
    """bucket, bits: at most 4,096 bitmaps of 4 KB in which the slot of every key of rows is set."""
    return rows.groupBy(F.bitmap_bucket_number(_slot(key)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_slot(key))).alias("bits"))


def perhaps(df: DataFrame, key: Column, known: DataFrame, name: str) -> DataFrame:
    """df with boolean ``name``: false only where the key is surely not among those of the bitmaps (a false yes is possible)."""
    at = F.bitmap_bit_position(_slot(key)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("slot_bucket", F.bitmap_bucket_number(_slot(key))).join(F.broadcast(known), F.col("slot_bucket") == F.col("bucket"), "left")
    hit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop("slot_bucket", "bucket", "bits")
