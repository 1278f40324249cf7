"""Signal queries: spectral features of short blocks in plain expressions, filters, and the analysis of synthetic episodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveloom.functions import synth
from waveloom.operators import consensus as C
from waveloom.operators import filters as L
from waveloom.operators import frames as R
from waveloom.operators import segments as S
from waveloom.plans.base import EV, query, series
from waveloom.plans.shared import stored

SIZE, HOP = 8, 4
BAND = L.bandpass(100, 4.5, 1.2)
B0, B1, B2, A1, A2 = BAND


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, t, value AS x1, 0.0::DOUBLE AS x2, {B0!r}::DOUBLE * value AS y1, 0.0::DOUBLE AS y2 FROM ev WHERE t = 0
UNION ALL SELECT ev.user_id, ev.t, ev.value, r.x1, {B0!r}::DOUBLE * ev.value + {B1!r}::DOUBLE * r.x1 + {B2!r}::DOUBLE * r.x2 - ({A1!r})::DOUBLE * r.y1 - {A2!r}::DOUBLE * r.y2, r.y1
FROM r JOIN ev ON ev.user_id = r.user_id AND ev.t = r.t + 1) SELECT user_id, t, round(y1, 5) AS y FROM r""")
def iir_biquad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.filtered(series(spark, sf_dir), "user_id", [BAND], "value").select("user_id", "t", F.round("y", 5).alias("y"))


@query(f"""WITH {EV}, m AS (SELECT user_id, max(t) AS top FROM ev GROUP BY 1), k AS (SELECT user_id, top, unnest(range(0, CAST(top / 1.37 AS BIGINT) + 2)) AS k FROM m),
p AS (SELECT user_id, k, k * 1.37::DOUBLE AS pos, CAST(floor(k * 1.37::DOUBLE) AS BIGINT) AS i FROM k WHERE k * 1.37::DOUBLE < top)
SELECT p.user_id, k, round(a.value + (pos - i) * (b.value - a.value), 5) AS y FROM p JOIN ev a ON a.user_id = p.user_id AND a.t = i JOIN ev b ON b.user_id = p.user_id AND b.t = i + 1""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resampled(series(spark, sf_dir), "user_id", 1.37, "value").select("user_id", "k", F.round("y", 5).alias("y"))


def _dft(size: int) -> list[tuple[int, int, float, float, float]]:
    """Bin, place, window, cosine and sine of the transform of ``size`` values."""
    return [(k, j, 0.5 - 0.5 * math.cos(2 * math.pi * j / (size - 1)), math.cos(2 * math.pi * k * j / size), -math.sin(2 * math.pi * k * j / size)) for k in range(size // 2 + 1) for j in range(size)]


def dft_sql(size: int, hop: int) -> str:
    return f"""{EV}, m AS (SELECT user_id, max(t) AS top FROM ev GROUP BY 1), f AS (SELECT user_id, unnest(range(0, CASE WHEN top + 1 >= {size} THEN (top + 1 - {size}) // {hop} + 1 ELSE 0 END)) AS f FROM m),
w(k, j, h, c, s) AS (VALUES {', '.join(str((k, j)) [:-1] + f', {h!r}::DOUBLE, {c!r}::DOUBLE, {s!r}::DOUBLE)' for k, j, h, c, s in _dft(size))}),
sp AS (SELECT f.user_id, f, k, sqrt(sum(value * h * c) * sum(value * h * c) + sum(value * h * s) * sum(value * h * s)) AS mag FROM f JOIN w ON true JOIN ev ON ev.user_id = f.user_id AND ev.t = f * {hop} + j GROUP BY 1, 2, 3)"""


DFT_SQL = dft_sql(SIZE, HOP)


def frames(ev: DataFrame, keys: list[str], size: int, hop: int, *carried: str) -> DataFrame:
    """keys, f, carried, mags: Hann-windowed transform of each whole block of ``size`` values every ``hop``, a row a block with its magnitudes by bin.

    ev: keys, t, value. Each hop's values are put beside each other and then the hops, by windows in one order, so that the values are neither
    copied to every block nor to every bin. Blocks are short, so the transform is a product with a constant. Null values count as 0, unless all are.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    ahead = lambda x, n: F.lead(x, n).over(order) if n else F.col(x)
    hops = ev.withColumns({"__0": F.array(*[ahead("value", j) for j in range(min(hop, size))]), "__end": F.lead("t", size - 1).over(order)}).filter(F.col("t") % hop == 0)
    beside = hops.withColumns({f"__{i}": ahead("__0", i) for i in range(1, -(-size // hop))}).filter("__end IS NOT NULL")
    x = [F.get(f"__{j // hop}", F.lit(j % hop)) for j in range(size)]
    table = _dft(size)
    windowed = F.array(*[F.coalesce(x[j] * h, F.lit(0.0)) for k, j, h, _, _ in table if k == 0])
    rows = F.array(*[F.struct(*[F.array(*[F.lit(row[i]) for row in table if row[0] == k]).alias(n) for i, n in ((3, "c"), (4, "s"))]) for k in range(size // 2 + 1)])  # a constant
    dot = lambda w: F.aggregate(F.zip_with("__x", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    parts = F.transform(rows, lambda w: F.struct(dot(w["c"]).alias("re"), dot(w["s"]).alias("im")))
    mags = F.transform(parts, lambda p: F.when(F.col("__some"), F.sqrt(p["re"] * p["re"] + p["im"] * p["im"])))
    held = beside.select(*keys, F.floor(F.col("t") / hop).alias("f"), *carried, windowed.alias("__x"), F.coalesce(*x).isNotNull().alias("__some"))
    return held.select(*keys, "f", *carried, mags.alias("mags"))


def spectrum(spark: SparkSession, sf_dir: str, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """user_id, f, k, mag: Hann-windowed transform of blocks of ``size`` values every ``hop``."""
    ev = series(spark, sf_dir).filter("user_id IS NOT NULL").select("user_id", "t", F.col("value").cast("double").alias("value"))
    return frames(ev, ["user_id"], size, hop).select("user_id", "f", F.posexplode_outer("mags").alias("k", "mag"))


@query(f"WITH {DFT_SQL}, d AS (SELECT user_id, f, k, mag, lag(mag) OVER (PARTITION BY user_id, k ORDER BY f) AS prev FROM sp) SELECT user_id, f, round(sum(greatest(0.0, mag - coalesce(prev, mag))) / sum(mag), 5) AS flux FROM d GROUP BY 1, 2")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = F.coalesce(F.lag("mag").over(Window.partitionBy("user_id", "k").orderBy("f")), F.col("mag"))
    held = spectrum(spark, sf_dir).withColumn("rise", F.greatest(F.lit(0.0), F.col("mag") - prev))
    return held.groupBy("user_id", "f").agg(F.round(F.sum("rise") / F.sum("mag"), 5).alias("flux"))


@query(f"WITH {DFT_SQL} SELECT user_id, f, round(exp(avg(ln(mag * mag + 1e-12))) / avg(mag * mag), 5) AS flatness, round(sum(CASE WHEN k <= 1 THEN mag * mag ELSE 0 END) / sum(mag * mag), 5) AS low_ratio FROM sp GROUP BY 1, 2")
def spectral_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("mag") * F.col("mag")
    return spectrum(spark, sf_dir).groupBy("user_id", "f").agg(
        F.round(F.exp(F.avg(F.log(p + 1e-12))) / F.avg(p), 5).alias("flatness"), F.round(F.sum(F.when(F.col("k") <= 1, p).otherwise(0.0)) / F.sum(p), 5).alias("low_ratio"))


@query(f"""WITH {DFT_SQL}, n AS (SELECT *, lag(mag) OVER b AS lo, lead(mag) OVER b AS hi, lag(mag) OVER w AS before, lead(mag) OVER w AS after FROM sp WINDOW b AS (PARTITION BY user_id, f ORDER BY k), w AS (PARTITION BY user_id, k ORDER BY f))
SELECT user_id, f, k, round(mag, 4) AS mag, row_number() OVER (PARTITION BY user_id, f ORDER BY round(mag, 6) DESC, k) AS rank FROM n
WHERE round(mag, 6) > round(lo, 6) AND round(mag, 6) >= round(hi, 6) AND round(mag, 6) >= coalesce(round(before, 6), 0) AND round(mag, 6) >= coalesce(round(after, 6), 0) QUALIFY rank <= 2""")
def spectral_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two loudest local peaks over bins and frames of each frame; the first and last bin are none."""
    bins, time = Window.partitionBy("user_id", "f").orderBy("k"), Window.partitionBy("user_id", "k").orderBy("f")
    m = F.round("mag", 6)
    held = spectrum(spark, sf_dir).withColumn("m", m).withColumns({"lo": F.lag("m").over(bins), "hi": F.lead("m").over(bins), "before": F.coalesce(F.lag("m").over(time), F.lit(0.0)), "after": F.coalesce(F.lead("m").over(time), F.lit(0.0))})
    top = held.filter("m > lo AND m >= hi AND m >= before AND m >= after")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "f").orderBy(F.desc("m"), "k"))).filter("rank <= 2").select("user_id", "f", "k", F.round("mag", 4).alias("mag"), "rank")


@query(f"""WITH {DFT_SQL}, d AS (SELECT user_id, f, k, 20 * log10(greatest(mag, 1e-12)) AS db FROM sp), o AS (SELECT user_id, k, round(db - avg(db) OVER (PARTITION BY user_id, f ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) > 0.1 AS stands_out FROM d)
SELECT user_id, k, round(avg(CASE WHEN stands_out THEN 1.0::DOUBLE ELSE 0 END), 6) AS active FROM o GROUP BY 1, 2""")
def bin_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each bin stands out from the mean of the bins around it."""
    db = 20 * F.log10(F.greatest("mag", F.lit(1e-12)))
    around = Window.partitionBy("user_id", "f").orderBy("k").rowsBetween(-1, 1)
    held = spectrum(spark, sf_dir).withColumn("db", db).withColumn("on", F.round(F.col("db") - F.avg("db").over(around), 6) > 0.1)
    return held.groupBy("user_id", "k").agg(F.round(F.avg(F.col("on").cast("double")), 6).alias("active"))


# Analyses of the sample signals, which tests use; they read no table, so they are no registered queries.


def theme_peaks(spark: SparkSession) -> DataFrame:
    """Offset peaks of the episodes against references among them, from their landmarks; ids are numbered by name."""
    marks = R.landmarks(synth.episodes(spark)).select("hash", F.substring("id", 2, 9).cast("long").alias("doc_id"), "t")
    places = Window.partitionBy("hash", "doc_id").orderBy("t")
    held = stored(C.recurring(marks.withColumn("r", F.row_number().over(places) - 1).filter(F.col("r") < C.MAX_OCCUR)), "landmarks")
    bins = stored(C.votes_of(held, C.references(held)), "votes")
    return C.merged(bins, C.top_peaks(C.peaks(C.offset_votes(bins)), 1))


def planted_theme(spark: SparkSession) -> DataFrame:
    """Offsets in seconds at which the planted theme lines up between episodes."""
    return theme_peaks(spark).select("a", "b", (F.col("delta") / S.FPS).alias("offset_s"), "votes", (F.col("a_from") / S.FPS).alias("from_s"), (F.col("a_to") / S.FPS).alias("to_s"))


def music_segments(spark: SparkSession) -> DataFrame:
    """Segments of each episode that sound like its first five seconds of theme."""
    episodes = synth.episodes(spark)
    frames = R.features(episodes)
    exemplars = episodes.select("id", F.col("theme_at").alias("s"), (F.col("theme_at") + 5).alias("e"))
    seconds = episodes.select("id", (F.size("x") / synth.RATE).alias("duration"))
    return S.music(frames, exemplars, seconds)
