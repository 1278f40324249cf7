"""Calibrated detectors: Fisher discriminant, scores, two-class thresholds, level gate, fixed-constant z scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean and deviation of the three speech series over music-free frames.
SPEECH_CONSTANTS = {"mod4": (0.2906, 0.0918), "mod_speech": (1.9010, 0.0368), "band_sync": (0.5730, 0.1600)}
LEAST_POSITIVES, LEAST_NEGATIVES = 10, 50


def fisher(df: DataFrame, key: str, positive: Column, features: list[str]) -> DataFrame:
    """Per key: weights w = (m1 - m0) / (v1 + v0 + 1e-9), separation, class counts; keys with too few rows drop out.
    One aggregation: class means and population variances are conditional aggregates."""
    yes, no = positive, ~positive
    moments = [f(F.when(c, F.col(x))).alias(f"{x}_{n}{k}") for x in features for n, f in (("m", F.avg), ("v", F.var_pop)) for k, c in ((1, yes), (0, no))]
    got = df.groupBy(key).agg(F.count_if(yes).alias("pos_count"), F.count_if(no).alias("neg_count"), *moments)
    got = got.filter((F.col("pos_count") >= LEAST_POSITIVES) & (F.col("neg_count") >= LEAST_NEGATIVES))
    gap = lambda x: F.col(f"{x}_m1") - F.col(f"{x}_m0")
    spread = lambda x: F.col(f"{x}_v1") + F.col(f"{x}_v0")
    for x in features:
        got = got.withColumn(f"w_{x}", gap(x) / (spread(x) + 1e-9))
    separation = F.sqrt(reduce(lambda a, b: a + b, [F.when(spread(x) > 0, gap(x) * gap(x) / spread(x)).otherwise(0.0) for x in features]))
    middle = reduce(lambda a, b: a + b, [F.col(f"w_{x}") * (F.col(f"{x}_m1") + F.col(f"{x}_m0")) / 2 for x in features])
    return got.select(key, "pos_count", "neg_count", *[f"w_{x}" for x in features], middle.alias("mid"), separation.alias("separation"))


def calibration_errors(df: DataFrame, key: str, positive: Column) -> DataFrame:
    """key, error of the keys that have too few rows of a class for ``fisher``."""
    counts = df.groupBy(key).agg(F.count_if(positive).alias("pos_count"), F.count_if(~positive).alias("neg_count"))
    bad = counts.filter((F.col("pos_count") < LEAST_POSITIVES) | (F.col("neg_count") < LEAST_NEGATIVES))
    return bad.select(key, F.format_string(f"calibration needs {LEAST_POSITIVES} positive and {LEAST_NEGATIVES} negative frames, has %d and %d", "pos_count", "neg_count").alias("error"))


def scored(df: DataFrame, weights: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Adds score = w . x minus the class midpoint. weights: one row a key."""
    total = reduce(lambda a, b: a + b, [F.col(f"w_{x}") * F.col(x) for x in features])
    return df.join(weights, key).withColumn("score", total - F.col("mid"))


def midpoints(df: DataFrame, key: str, positive: Column, x: str) -> DataFrame:
    """Per key the middle of the mean inside and the mean outside the positive rows."""
    return df.groupBy(key).agg(((F.avg(F.when(positive, F.col(x))) + F.avg(F.when(~positive, F.col(x)))) / 2).alias("threshold")).filter("threshold IS NOT NULL")


def level_gate(levels: DataFrame, exemplars: DataFrame, key: str, slack: float) -> DataFrame:
    """Segments (key, level) at most slack below the unweighted mean of the key's exemplar levels. A segment without level drops out."""
    reference = exemplars.groupBy(key).agg(F.avg("level").alias("reference"))
    return levels.join(reference, key).filter(F.col("level") >= F.col("reference") - slack)


def z_mean(columns: dict[str, Column], constants: dict[str, tuple[float, float]] | None = None) -> Column:
    """Mean of the z scores of the named series under fixed means and deviations."""
    constants = constants or SPEECH_CONSTANTS
    parts = [(columns[k] - m) / s for k, (m, s) in constants.items()]
    return reduce(lambda a, b: a + b, parts) / len(parts)
