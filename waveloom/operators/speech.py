"""Speech over music: modulation of band envelopes, synchrony of the bands, frame grids, window scores.

All as windows and aggregates over long tables. Constants of the published rule: 4 Hz
modulation over 25 fine frames of 100 a second, synchrony over 200 fine frames every 20, windows of 6 s every 3 s.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.operators import detect as D
from waveloom.operators import filters as L
from waveloom.operators import windows as W
from waveloom.plans.shared import stored

MOD_HZ, FINE_RATE, MOD_WINDOW, SYNC_WINDOW, SYNC_STEP = 4.0, 100.0, 25, 200, 20
SECONDS, THRESHOLD = 6.0, 0.3
#: Envelope bands in Hz, and the centre and Q of the filter that picks their syllable rate.
ENVELOPE_BANDS, ENVELOPE_RATE, SYLLABLES = ((80, 300), (300, 800), (800, 2000), (2000, 4000)), 100.0, (4.5, 1.2)


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def modulation_weights(window: int, hz: float, rate: float) -> list[tuple[float, float]]:
    """Hann-weighted cosine and sine of the modulation frequency at each place of the window."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / window) for i in range(window)]
    return [(h * math.cos(2 * math.pi * hz * i / rate), -h * math.sin(2 * math.pi * hz * i / rate)) for i, h in enumerate(hann)]


def modulation(bands: DataFrame, key: str, window: int = MOD_WINDOW, hz: float = MOD_HZ, rate: float = FINE_RATE) -> DataFrame:
    """Adds depth: the modulation of a band's power at ``hz`` over a centred window, relative to the band's own mean there, so
    a louder band is no deeper. bands: key, band, t, power; what lies outside the series is 0."""
    half, order = (window - 1) // 2, Window.partitionBy(key, "band").orderBy("t")
    near = [F.coalesce(F.lag("power", half - i).over(order) if i <= half else F.lead("power", i - half).over(order), F.lit(0.0)) for i in range(window)]
    held = bands.withColumn("near", F.array(*near))
    weights = modulation_weights(window, hz, rate)
    re, im = (add([F.col("near")[i] * w[k] for i, w in enumerate(weights)]) for k in (0, 1))
    mean = add([F.col("near")[i] for i in range(window)]) / window
    return held.withColumns({"re": re, "im": im, "mean": mean}).withColumn("depth", F.when(F.col("mean") > 1e-20, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("mean")).otherwise(0.0)).drop("near", "re", "im", "mean")


def speech_modulation(depths: DataFrame, key: str) -> DataFrame:
    """key, t, mod_speech: logarithm of the summed depths of the speech bands."""
    return depths.groupBy(key, "t").agg(F.log10(F.sum("depth") + 1e-12).alias("mod_speech"))


def synchrony(depths: DataFrame, key: str, n_bands: int, window: int = SYNC_WINDOW, step: int = SYNC_STEP) -> DataFrame:
    """key, t, band_sync: one minus the mean correlation of all pairs of bands' depths over a trailing window, taken every ``step``
    rows and held until the next; 0 before the first whole window. With each band standardised within its window,
    the pairs' correlations are half of (the squares of the sums less the sums of the squares), so no pair is formed."""
    top = depths.groupBy(key).agg(F.max("t").alias("top"))
    first = F.greatest(F.ceil(F.col("t") / step), F.lit(math.ceil((window - 1) / step)))
    last = F.floor((F.col("t") + window - 1) / step)
    each = depths.select(key, "band", "t", "depth").filter(last >= first).withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("win", F.col("k") * step)
    each = each.join(top, key).filter("win <= top")
    stats = each.groupBy(key, "win", "band").agg(F.avg("depth").alias("m"), F.sqrt(F.var_pop("depth") * window).alias("s"))
    z = each.join(stats, [key, "win", "band"]).withColumn("z", F.when(F.col("s") > 1e-6, (F.col("depth") - F.col("m")) / F.col("s")).otherwise(0.0))
    rows = z.groupBy(key, "win", "t").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    pairs = n_bands * (n_bands - 1) / 2
    mean = rows.groupBy(key, "win").agg((F.lit(1.0) - F.sum(F.col("s") * F.col("s") - F.col("q")) / 2 / pairs).alias("value"))
    frames = depths.select(key, "t").distinct().withColumn("win", F.floor(F.col("t") / step) * step)
    return frames.join(mean, [key, "win"], "left").select(key, "t", F.coalesce("value", F.lit(0.0)).alias("band_sync"))


def to_frames(fine: DataFrame, key: str, x: str, per_frame: float) -> DataFrame:
    """key, frame, value: mean of the fine rows t in [floor(frame * per_frame), floor((frame + 1) * per_frame))."""
    guess = F.floor(F.col("t") / per_frame)
    frame = F.when(F.floor((guess + 1) * per_frame) <= F.col("t"), guess + 1).when(F.floor(guess * per_frame) > F.col("t"), guess - 1).otherwise(guess)
    return fine.withColumn("frame", frame).groupBy(key, "frame").agg(F.avg(x).alias("value"))


def envelope_modulation(df: DataFrame, key: str, rate: float, frame_rate: float, bands: tuple = ENVELOPE_BANDS, envelope_rate: float = ENVELOPE_RATE, syllables: tuple[float, float] = SYLLABLES, smooth: int | None = None) -> DataFrame:
    """key, frame, mod4: share of the envelopes' power at the syllable rate, mean over the bands. df: key, t, x. Each band is filtered, rectified,
    smoothed and thinned to an envelope; its mean taken off, it is filtered again, and moving mean squares after and before are divided."""
    thin, width = max(1, round(rate / envelope_rate)), max(4, round(envelope_rate))
    smooth = max(1, round(0.02 * rate)) if smooth is None else smooth
    centre = [math.sqrt(low * high) for low, high in bands]
    y = L.filter_bank(df, key, [[L.bandpass(rate, c, max(0.5, c / (high - low)))] for c, (low, high) in zip(centre, bands)])
    named = y.withColumn("series", F.concat_ws("|", F.col(key).cast("string"), "band"))
    size = df.groupBy(key).agg(F.floor(F.count(F.lit(1)) / thin).alias("n"))
    envelope = W.moving_mean(named, "series", F.abs("y"), smooth, "e").filter(F.col("t") % thin == 0).select(key, "series", F.floor(F.col("t") / thin).alias("t"), "e")
    named = stored(envelope.join(size, key).filter(F.col("t") < F.col("n")).drop("n"), "envelopes")
    mean = named.groupBy("series").agg(F.avg("e").alias("mean"))
    flat = named.join(mean, "series").select(key, "series", "t", (F.col("e") - F.col("mean")).alias("x"))
    again = L.filtered(flat, "series", [L.bandpass(envelope_rate, *syllables)])
    both = flat.join(again, ["series", "t"])
    ratio = W.moving_mean(W.moving_mean(both, "series", F.col("y") * F.col("y"), width, "num"), "series", F.col("x") * F.col("x"), width, "den")
    total = ratio.groupBy(key, "t").agg((F.sum(F.when(F.col("den") > 1e-12, F.col("num") / F.col("den")).otherwise(0.0)) / len(bands)).alias("mod4"))
    frames = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("last", F.floor(F.col("n") / thin) - 1).withColumn("frame", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") * frame_rate / rate) - 1)))
    at = frames.select(key, "frame", F.least("last", F.floor(F.col("frame") / frame_rate * envelope_rate + 0.5)).alias("t"))  # the nearest envelope sample
    return at.join(total, [key, "t"]).select(key, "frame", "mod4")


def dialog_scores(frames: DataFrame, segments: DataFrame, key: str, fps: float, constants: dict[str, tuple[float, float]], seconds: float = SECONDS, threshold: float = THRESHOLD) -> DataFrame:
    """key, s, e, score, has_dialog: the best of a segment's windows, each the mean z score of the series' maxima after a trailing
    mean of one second. Windows start every half window, and one ends with the segment; a short segment is its own window."""
    width = max(1, round(fps))
    trailing = Window.partitionBy(key).orderBy("t").rowsBetween(-(width - 1), 0)
    smooth = frames.select(key, "t", *[F.avg(x).over(trailing).alias(x) for x in constants])
    span = F.col("e") - F.col("s")
    steps = F.transform(F.sequence(F.lit(0), F.floor((span - seconds) / (seconds / 2)).cast("int")), lambda k: F.col("s") + k * (seconds / 2))
    starts = F.when(span <= seconds, F.array(F.col("s"))).otherwise(F.array_union(steps, F.array(F.col("e") - seconds)))
    windows = segments.select(key, "s", "e", F.explode(starts).alias("at")).withColumn("for", F.when(span <= seconds, F.greatest(F.lit(0.5), span)).otherwise(F.lit(seconds)))
    first, last = F.greatest(F.lit(0), F.floor(F.col("at") * fps)), F.ceil((F.col("at") + F.col("for")) * fps) - 1
    each = windows.withColumn("t", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    top = each.join(smooth, [key, "t"], "left").groupBy(key, "s", "e", "at").agg(*[F.coalesce(F.max(x), F.lit(0.0)).alias(x) for x in constants])
    scores = top.withColumn("score", D.z_mean({x: F.col(x) for x in constants}, constants))
    return scores.groupBy(key, "s", "e").agg(F.max("score").alias("score")).withColumn("has_dialog", F.col("score") >= threshold)
