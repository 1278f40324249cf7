"""Operators over spectra in long form (key, f, k, mag): peaks, constellations, activation by prominence, pitch classes, periodicity.

A key's frames are dealt in blocks with the few frames around that a block needs, so no task holds a whole series.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.operators import vectors as V

FRAMES = 1024  # frames of a block
CLASSES = 12


def haloed(df: DataFrame, t: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """df with block and own: each row in its block of ``size`` and, with own false, in those that look back or ahead to it."""
    at = F.col(t)
    each = df.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((at - after) / size)), F.floor((at + before) / size))))
    return each.withColumn("own", F.col("block") == F.floor(at / size))


def level_db(power: Column, size: int) -> Column:
    """Level of a frame in dB from its ``power``, summed over its bins: the root mean square of its windowed samples, as the transform keeps the sum of squares."""
    return 20 * F.log10(F.sqrt(power) / size + 1e-12)


def bin_power(size: int) -> Column:
    """A bin's part of a frame's power: bins other than the first and the last stand for two of the full transform."""
    return F.when(F.col("k").isin(0, size // 2), 1.0).otherwise(2.0) * F.col("mag") * F.col("mag")


def framed(spec: DataFrame, key: str, size: int) -> DataFrame:
    """key, f, mags: a spectrum in long form with a row a frame, its magnitudes by bin."""
    held = F.map_from_entries(F.collect_list(F.struct("k", "mag")))
    return spec.groupBy(key, "f").agg(held.alias("m")).select(key, "f", F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: F.try_element_at("m", k)).alias("mags"))


def frame_peaks(frames: DataFrame, keys: list[str], size: int, most: int = 3, silence_db: float | None = None) -> DataFrame:
    """frames (keys, f, mags) with p, (m, k) of the ``most`` loudest local peaks over bins and frames, instead of mags; those without any are left out.
    Magnitudes count to 6 decimals, then the lower bin. Frames under ``silence_db`` have no peaks and bound no neighbour; the first and last bin are none."""
    power = F.aggregate(F.transform("mags", lambda x, k: F.when(k.isin(0, size // 2), 1.0).otherwise(2.0) * x * x), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    loud = F.lit(True) if silence_db is None else F.exists("mags", lambda x: x.isNotNull()) & (F.round(level_db(power, size), 6) >= silence_db)
    held = frames.withColumn("mags", F.when(loud, F.transform("mags", lambda x: F.round(x, 6))))
    time = Window.partitionBy(*keys).orderBy("f")
    beside = lambda g, d: F.when(g("f").over(time) == F.col("f") + d, g("mags").over(time))
    near = held.withColumns({"__before": beside(F.lag, -1), "__after": beside(F.lead, 1)})

    def top(k: Column) -> Column:
        m, before, after = F.get("mags", k), F.get("__before", k), F.get("__after", k)
        return (m > F.get("mags", k - 1)) & (m >= F.get("mags", k + 1)) & (before.isNull() | (m >= before)) & (after.isNull() | (m >= after))

    inner = F.sequence(F.lit(1), F.lit(size // 2 - 1)) if size > 3 else F.array().cast("array<int>")
    most_loud = F.slice(F.sort_array(F.transform(F.filter(inner, top), lambda k: F.struct(F.get("mags", k).alias("m"), (-k).alias("k"))), asc=False), 1, most)
    found = near.withColumn("p", F.transform(most_loud, lambda z: F.struct(z["m"].alias("m"), (-z["k"]).alias("k"))))
    return found.filter(F.size("p") > 0).drop("mags", "__before", "__after")


def local_peaks(spec: DataFrame, key: str, size: int, most: int = 3, silence_db: float | None = None) -> DataFrame:
    """key, f, k, m, rank: the peaks of frame_peaks for a spectrum in long form, a row each."""
    near = haloed(framed(spec, key, size), "f", FRAMES, 1, 1).repartition(key, "block")
    found = frame_peaks(near, [key, "block"], size, most, silence_db).filter("own")
    return found.select(key, "f", F.posexplode("p").alias("i", "z")).select(key, "f", F.col("z.k").alias("k"), F.col("z.m").alias("m"), (F.col("i") + 1).alias("rank"))


def constellation(peaks: DataFrame, tops: DataFrame, key: str, max_dt: int = 32, targets: int = 4, quant: int = 2, occur: int = 8) -> DataFrame:
    """hash, key, t, r: landmarks of peak pairs, ((q1 * 1024 + q2) * 64 + dt) with q = round(bin / quant).

    The strongest peak of each of the next ``max_dt`` frames is a target, the ``targets`` strongest of those count (then the nearer); each
    peak of the frame anchors one landmark a target. Frames without max_dt frames after them (tops: key, top) anchor none. r = 0, 1, ..
    numbers a hash's places in the key by time, then by bin; the first ``occur`` are kept.
    """
    packed = F.array_sort(F.collect_list(F.struct("rank", "k", "m")))  # as many as a frame has peaks
    frames = peaks.groupBy(key, "f").agg(F.transform(packed, lambda z: F.struct(z["m"].alias("m"), z["k"].alias("k"))).alias("p"))
    near = haloed(frames, "f", FRAMES, 0, max_dt).join(tops, key).withColumn("own", F.col("own") & (F.col("f") <= F.col("top") - max_dt)).repartition(key, "block")
    return paired(near, key, max_dt, targets, quant, occur)


def frame_constellation(frames: DataFrame, key: str, size: int, most: int, silence_db: float | None, max_dt: int = 32, targets: int = 4, quant: int = 2, occur: int = 8) -> DataFrame:
    """The landmarks of constellation from frames that lie in their blocks (key, block, own, f, mags), each block with max_dt + 1 frames after it and one before."""
    later = F.lead("f", max_dt).over(Window.partitionBy(key, "block").orderBy("f")).isNotNull()
    near = frames.withColumn("own", F.col("own") & later)
    return paired(frame_peaks(near, [key, "block"], size, most, silence_db), key, max_dt, targets, quant, occur)


def paired(near: DataFrame, key: str, max_dt: int, targets: int, quant: int, occur: int) -> DataFrame:
    """Landmarks of frames in blocks (key, block, f, p); own: whether the frame anchors any in its block."""
    ahead = Window.partitionBy(key, "block").orderBy("f").rangeBetween(1, max_dt)
    best = F.struct(F.col("p")[0]["m"].alias("m"), (-F.col("f")).alias("f"), F.col("p")[0]["k"].alias("k"))
    held = near.withColumn("to", F.slice(F.sort_array(F.collect_list(best).over(ahead), asc=False), 1, targets)).filter("own")
    pairs = held.select(key, "f", F.explode("p").alias("a"), "to").select(key, "f", F.col("a.k").alias("k"), F.explode("to").alias("b"))
    q = lambda x: F.floor(x / quant + 0.5).cast("long")
    marks = pairs.select(key, F.col("f").alias("t"), "k", ((q(F.col("k")) * 1024 + q(F.col("b.k"))) * 64 - F.col("b.f") - F.col("f")).alias("hash"), (-F.col("b.f")).alias("bf"))
    place = F.row_number().over(Window.partitionBy(key, "hash").orderBy("t", "k", "bf"))
    return marks.withColumn("r", place - 1).filter(F.col("r") < occur).select("hash", key, "t", "r")


def outstanding(spec: DataFrame, key: str, half: int = 10, over_db: float = 0.1, depth_db: float = 120.0) -> DataFrame:
    """key, f, k, on: whether a bin's level is more than over_db above the mean of the 2 half + 1 bins around it, fewer at the ends.
    Levels are held at depth_db under the frame's loudest bin."""
    frame = Window.partitionBy(key, "f")
    db = F.when(F.col("mag") > 0, 20 * F.log10("mag"))
    loudest = F.max("db").over(frame)
    held = spec.withColumn("db", db).withColumn("db", F.coalesce(F.greatest("db", loudest - depth_db), loudest - depth_db, F.lit(-200.0)))
    around = F.avg("db").over(frame.orderBy("k").rowsBetween(-half, half))
    return held.withColumn("on", F.round(F.col("db") - around, 6) > over_db).select(key, "f", "k", "on")


def block_curves(on: DataFrame, tops: DataFrame, key: str, length: int = 100, step: int = 50) -> DataFrame:
    """key, block, k, n: in how many frames of each whole block of ``length`` frames every ``step`` a bin stands out."""
    f = F.col("f")
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((f - length) / step) + 1).cast("long"), F.floor(f / step).cast("long"))
    each = on.join(tops, key).withColumn("block", F.explode(blocks)).filter(F.col("block") * step + length - 1 <= F.col("top"))
    return each.groupBy(key, "block", "k").agg(F.count_if("on").alias("n"))


def prominences(curve: DataFrame, keys: list[str], k: str, x: str) -> DataFrame:
    """keys, k, drop, width of each local maximum of a curve: the smaller fall to the valleys beside it, and how far that valley is.

    A valley is where a walk downhill from the peak stops: on the left the last place before it that does not rise over its own left neighbour, on the
    right the first after it that does not rise over its right one; the ends of the curve are valleys. Equal falls take the right one.
    """
    order = Window.partitionBy(*keys).orderBy(k)
    left, right = F.lag(x).over(order), F.lead(x).over(order)
    held = curve.withColumns({"__l": left, "__r": right})
    down = held.withColumns({"__stop_l": F.when(F.col("__l").isNull() | (F.col(x) <= F.col("__l")), F.struct(k, x)), "__stop_r": F.when(F.col("__r").isNull() | (F.col(x) <= F.col("__r")), F.struct(k, x))})
    valleys = down.withColumns({
        "__a": F.last("__stop_l", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "__b": F.first("__stop_r", True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    peaks = valleys.filter((F.col(x) > F.col("__l")) & (F.col(x) >= F.col("__r")))
    fall_l, fall_r = F.col(x) - F.col("__a")[x], F.col(x) - F.col("__b")[x]
    return peaks.select(*keys, k, F.least(fall_l, fall_r).alias("drop"), F.when(fall_l < fall_r, F.col(k) - F.col("__a")[k]).otherwise(F.col("__b")[k] - F.col(k)).alias("width"))


def activation(curves: DataFrame, key: str, length: int = 100, top: int = 5) -> DataFrame:
    """key, block, value: the sum of the ``top`` steepest prominences (fall a bin) of each block's curve, 0 without any."""
    found = prominences(curves, [key, "block"], "k", "n").withColumn("p", F.col("drop") / F.col("width") / length)
    best = Window.partitionBy(key, "block").orderBy(F.desc("p"), "k")
    sums = found.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= top).groupBy(key, "block").agg(F.sum("p").alias("value"))
    return curves.select(key, "block").distinct().join(sums, [key, "block"], "left").select(key, "block", F.coalesce("value", F.lit(0.0)).alias("value"))


def class_weights(size: int, rate: float, low: float = 55, high: float = 4000) -> list[tuple[int, int, float]]:
    """(bin, pitch class from A, weight) of the bins of [low, high] Hz."""
    inside = [(k, k * rate / size) for k in range(size // 2 + 1) if low <= k * rate / size <= high]
    return [(k, math.floor(12 * math.log2(f / 440) + 0.5) % CLASSES, 1.0) for k, f in inside]


def chroma(spec: DataFrame, key: str, weights: list[tuple[int, int, float]], gate: float = 0.02) -> DataFrame:
    """key, t, c: per frame the magnitudes summed by class (a sparse matrix product, bins joined to their classes), less the key's mean, zero
    where the frame's sum is under ``gate`` times the key's upper median, else of unit length."""
    table = F.broadcast(spec.sparkSession.createDataFrame(weights, "k int, c int, w double"))  # at most a row a bin
    part = F.col("mag") * F.col("w")
    folded = spec.join(table, "k").groupBy(key, F.col("f").alias("t")).agg(F.array(*[F.sum(F.when(F.col("c") == c, part).otherwise(0.0)) for c in range(CLASSES)]).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return V.centred(folded, key, "v", gate, total).select(key, "t", "c")


def periodicity(df: DataFrame, key: str, frames: DataFrame, window: int, lags: range, x: str = "x") -> DataFrame:
    """key, frame, value: the greatest normalised autocorrelation over ``lags`` in the window of samples at each frame, at least 0.

    df: key, t, x; frames: key, frame, start (first sample). The window's mean is taken off; frames without a whole window, or with
    hardly any power, are 0. Samples meet their frames by an equi-join on pieces of the series as long as the window.
    """
    span = frames.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("start") + window - 1) / window))))
    each = df.select(key, "t", F.col(x).cast("double").alias("x"), F.floor(F.col("t") / window).alias("piece")).join(span, [key, "piece"]).withColumn("i", F.col("t") - F.col("start")).filter(F.col("i").between(0, window - 1))
    own = Window.partitionBy(key, "frame")
    flat = each.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("w", F.col("x") - F.avg("x").over(own)).filter(F.col("n") == window)
    later = own.orderBy("i")
    products = flat.select(key, "frame", (F.col("w") * F.col("w")).alias("r0"), *[(F.col("w") * F.lead("w", lag).over(later)).alias(f"r{lag}") for lag in lags])
    sums = products.groupBy(key, "frame").agg(F.sum("r0").alias("r0"), *[F.coalesce(F.sum(f"r{lag}"), F.lit(0.0)).alias(f"r{lag}") for lag in lags])
    best = reduce(lambda a, b: F.greatest(a, b), [F.col(f"r{lag}") for lag in lags])
    value = F.when(F.col("r0") > 1e-12, F.greatest(F.lit(0.0), best / F.col("r0"))).otherwise(0.0)
    return frames.select(key, "frame").join(sums.select(key, "frame", value.alias("value")), [key, "frame"], "left").select(key, "frame", F.coalesce("value", F.lit(0.0)).alias("value"))
