"""What is to be cut from which file: merged ranges, refusals by name, target names, and the report. Also small formatters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.operators import intervals as I

#: Containers that can be cut, and the extension of the result.
CUTTABLE = {"wav": "wav", "aiff": "aiff", "flac": "flac", "mp3": "mp3", "mp4": "m4a"}


def plan(files: DataFrame, ranges: DataFrame, mode: str = "remove") -> DataFrame:
    """One row a file: id, n_ranges (merged and clipped to the file), removed, output (seconds), target, refusal (null: it can be cut).

    files: id, name, container, duration; ranges: id, s, e in seconds. mode 'keep' keeps the ranges instead. A file without a range, one
    that nothing would be left of, and one whose container can't be written are refused, each with its reason; none disappears.
    """
    clipped = ranges.join(files.select("id", "duration"), "id").select("id", F.greatest("s", F.lit(0.0)).alias("s"), F.least("e", "duration").alias("e"))
    total = I.coalesce(clipped, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("e") - F.col("s")).alias("inside"))
    held = files.join(total, "id", "left").withColumn("n_ranges", F.coalesce("n_ranges", F.lit(0).cast("long"))).withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    removed = F.col("inside") if mode == "remove" else F.col("duration") - F.col("inside")
    known = F.create_map(*[F.lit(x) for kv in CUTTABLE.items() for x in kv])
    extension = F.try_element_at(known, F.col("container"))
    refusal = (
        F.when(F.col("n_ranges") == 0, "nothing to remove" if mode == "remove" else "nothing to keep").when(F.col("container").isin("matroska", "webm"), F.concat(F.lit("cutting "), "container", F.lit(" is not implemented")))
        .when(extension.isNull(), "unknown container").when(removed >= F.col("duration"), "every sample would be removed"))
    cut = refusal.isNull()
    target = F.concat(F.regexp_replace("name", r"\.[^./\\]+$", ""), F.lit("."), extension)
    return held.select("id", "n_ranges", F.when(cut, removed).otherwise(0.0).alias("removed"), (F.col("duration") - F.when(cut, removed).otherwise(0.0)).alias("output"), F.when(cut, target).alias("target"), refusal.alias("refusal"))


def replaced(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Targets of the plan that exist already (present: name): to be confirmed before anything is written."""
    return planned.filter("target IS NOT NULL").join(present.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("id", "target")


def report(planned: DataFrame) -> DataFrame:
    """One row: files written, seconds removed, files skipped."""
    return planned.agg(F.count_if(F.col("target").isNotNull()).alias("written"), F.coalesce(F.sum("removed"), F.lit(0.0)).alias("removed"), F.count_if(F.col("target").isNull()).alias("skipped"))


def clock(seconds: Column) -> Column:
    """Seconds as minutes:seconds with one decimal."""
    return F.format_string("%d:%04.1f", F.floor(seconds / 60), seconds % 60)


def smoothed_share(df: DataFrame, key: str, x: str, alpha: float = 0.5) -> DataFrame:
    """key, value: exponentially weighted mean in order of t, the first value with full weight. Its weights depend on a row's
    place alone, so it is an ordinary sum."""
    size = df.groupBy(key).agg(F.max("t").alias("last"))
    held = df.join(size, key)
    weight = F.pow(F.lit(1 - alpha), F.col("last") - F.col("t")) * F.when(F.col("t") == 0, 1.0).otherwise(alpha)
    return held.groupBy(key).agg(F.sum(F.col(x) * weight).alias("value"))
