"""Queries over the spectra of events: constellations, activation by prominence, pitch classes, periodicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import filters as L
from waveloom.operators import spectral as P
from waveloom.operators.nearest import backward_forward
from waveloom.plans.base import EV, query, series
from waveloom.plans.signals import dft_sql, frames, spectrum

SIZE, HOP, QUIET = 16, 4, 24.0
MAX_DT, TARGETS, QUANT, OCCUR = 4, 2, 2, 3
HALF, OVER, BLOCK, STEP, TOP = 2, 0.1, 6, 3, 2
RATE, GATE = 1000.0, 0.3
SPEC = dft_sql(SIZE, HOP)
TOPS = f"tops AS (SELECT user_id, (top + 1 - {SIZE}) // {HOP} AS last FROM m WHERE top + 1 >= {SIZE})"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum(spark, sf_dir, SIZE, HOP)


def tops(spec: DataFrame) -> DataFrame:
    return spec.groupBy("user_id").agg(F.max("f").alias("top"))


PEAKS = f"""{SPEC}, {TOPS}, lv AS (SELECT *, round(mag, 6) AS m, round(20 * log10(sqrt(sum(CASE WHEN k IN (0, {SIZE // 2}) THEN 1 ELSE 2 END * mag * mag) OVER (PARTITION BY user_id, f)) / {SIZE} + 1e-12), 6) AS level FROM sp),
loud AS (SELECT *, lag(m) OVER b AS lo, lead(m) OVER b AS hi FROM lv WHERE level >= {QUIET} WINDOW b AS (PARTITION BY user_id, f ORDER BY k)),
pk AS (SELECT a.user_id, a.f, a.k, a.m, row_number() OVER (PARTITION BY a.user_id, a.f ORDER BY a.m DESC, a.k) AS rank FROM loud a LEFT JOIN loud p ON p.user_id = a.user_id AND p.k = a.k AND p.f = a.f - 1
LEFT JOIN loud q ON q.user_id = a.user_id AND q.k = a.k AND q.f = a.f + 1 WHERE a.m > a.lo AND a.m >= a.hi AND (p.m IS NULL OR a.m >= p.m) AND (q.m IS NULL OR a.m >= q.m) QUALIFY rank <= 3)"""


@query(f"WITH {SPEC} SELECT user_id, f, round(20 * log10(sqrt(sum(CASE WHEN k IN (0, {SIZE // 2}) THEN 1 ELSE 2 END * mag * mag)) / {SIZE} + 1e-12), 5) AS level FROM sp GROUP BY 1, 2")
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).groupBy("user_id", "f").agg(F.round(P.level_db(F.sum(P.bin_power(SIZE)), SIZE), 5).alias("level"))


@query(f"""WITH {PEAKS}, tg AS (SELECT a.user_id, a.f, t.f - a.f AS dt, t.k AS k2, row_number() OVER (PARTITION BY a.user_id, a.f ORDER BY t.m DESC, t.f) AS n FROM pk a
JOIN pk t ON t.user_id = a.user_id AND t.rank = 1 AND t.f BETWEEN a.f + 1 AND a.f + {MAX_DT} WHERE a.rank = 1 QUALIFY n <= {TARGETS}),
lm AS (SELECT pk.user_id, pk.f AS t, pk.k, f2.dt, CAST((floor(pk.k / {QUANT}::DOUBLE + 0.5) * 1024 + floor(k2 / {QUANT}::DOUBLE + 0.5)) * 64 + f2.dt AS BIGINT) AS hash
FROM pk JOIN tg f2 ON f2.user_id = pk.user_id AND f2.f = pk.f JOIN tops ON tops.user_id = pk.user_id AND pk.f <= last - {MAX_DT})
SELECT hash, user_id, t, row_number() OVER (PARTITION BY user_id, hash ORDER BY t, k, dt) - 1 AS r FROM lm QUALIFY r < {OCCUR}""")
def constellation_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks of pairs of spectral peaks; quiet frames have no peaks."""
    ev = series(spark, sf_dir).filter("user_id IS NOT NULL").select("user_id", "t", F.col("value").cast("double").alias("value"))
    dealt = P.haloed(ev, "t", P.FRAMES * HOP, HOP, MAX_DT * HOP + SIZE).repartition("user_id", "block")  # as far as the targets of a block's last frame, their neighbours and those frames' values
    spec = frames(dealt, ["user_id", "block"], SIZE, HOP, "own")
    return P.frame_constellation(spec, "user_id", SIZE, 3, QUIET, MAX_DT, TARGETS, QUANT, OCCUR)


ACTIVATION = f"""{SPEC}, {TOPS}, d AS (SELECT user_id, f, k, CASE WHEN mag > 0 THEN 20 * log10(mag) END AS db FROM sp), e AS (SELECT user_id, f, k, coalesce(greatest(db, max(db) OVER w - 120), max(db) OVER w - 120, -200.0) AS db FROM d WINDOW w AS (PARTITION BY user_id, f)),
o AS (SELECT user_id, f, k, round(db - avg(db) OVER (PARTITION BY user_id, f ORDER BY k ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING), 6) > {OVER} AS up FROM e),
bl AS (SELECT user_id, unnest(range(0, CASE WHEN last + 1 >= {BLOCK} THEN (last + 1 - {BLOCK}) // {STEP} + 1 ELSE 0 END)) AS block FROM tops),
cu AS (SELECT o.user_id, block, k, count(*) FILTER (up) AS n FROM bl JOIN o ON o.user_id = bl.user_id AND f >= block * {STEP} AND f < block * {STEP} + {BLOCK} GROUP BY 1, 2, 3),
nb AS (SELECT *, lag(n) OVER w AS l, lead(n) OVER w AS r FROM cu WINDOW w AS (PARTITION BY user_id, block ORDER BY k)),
pr AS (SELECT p.user_id, p.block, p.k, (SELECT max((a.k, a.n)) FROM nb a WHERE a.user_id = p.user_id AND a.block = p.block AND a.k < p.k AND (a.l IS NULL OR a.n <= a.l)) AS a,
(SELECT min((b.k, b.n)) FROM nb b WHERE b.user_id = p.user_id AND b.block = p.block AND b.k > p.k AND (b.r IS NULL OR b.n <= b.r)) AS b, p.n FROM nb p WHERE p.n > p.l AND p.n >= p.r),
st AS (SELECT user_id, block, k, least(n - a[2], n - b[2]) AS fall, CASE WHEN n - a[2] < n - b[2] THEN k - a[1] ELSE b[1] - k END AS width FROM pr),
s5 AS (SELECT *, fall / width::DOUBLE / {BLOCK} AS p FROM st QUALIFY row_number() OVER (PARTITION BY user_id, block ORDER BY fall / width::DOUBLE / {BLOCK} DESC, k) <= {TOP}),
val AS (SELECT bl.user_id, bl.block, coalesce(sum(p), 0) AS value FROM bl LEFT JOIN s5 ON s5.user_id = bl.user_id AND s5.block = bl.block GROUP BY 1, 2)"""


def curves(spec: DataFrame) -> DataFrame:
    return P.block_curves(P.outstanding(spec, "user_id", HALF, OVER), tops(spec), "user_id", BLOCK, STEP)


@query(f"WITH {ACTIVATION} SELECT user_id, block, k, fall, width FROM st")
def peak_prominences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local maximum of the blocks' activation curves with its fall and the distance of the valley."""
    return P.prominences(curves(wide(spark, sf_dir)), ["user_id", "block"], "k", "n").select("user_id", "block", "k", F.col("drop").alias("fall"), "width")


@query(f"""WITH {ACTIVATION}, fr AS (SELECT user_id, unnest(range(0, last + 1)) AS frame FROM tops)
SELECT fr.user_id, frame, round(value, 6) AS value FROM fr JOIN val ON val.user_id = fr.user_id
QUALIFY row_number() OVER (PARTITION BY fr.user_id, frame ORDER BY abs(frame * {2 * HOP} - ((2 * block * {STEP} + {BLOCK}) * {HOP} + {SIZE})), block) = 1""")
def activation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' activation on the grid of frames, each frame with the block whose centre is nearest, the earlier of two."""
    spec = wide(spark, sf_dir)
    blocks = P.activation(curves(spec), "user_id", BLOCK, TOP).withColumn("at", ((2 * F.col("block") * STEP + BLOCK) * HOP + SIZE).cast("long"))  # in half samples
    frames = tops(spec).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("frame")).withColumn("at", F.col("frame") * 2 * HOP).withColumn("row_id", F.xxhash64("user_id", "frame"))
    near = backward_forward(frames, blocks, "user_id", "at", "at", "value").filter("near_at IS NOT NULL")
    return near.select("user_id", "frame", F.round("near_value", 6).alias("value"))


WEIGHTS = P.class_weights(SIZE, RATE)


@query(f"""WITH {SPEC}, wt(k, c, w) AS (VALUES {', '.join(f'({k}, {c}, {w}::DOUBLE)' for k, c, w in WEIGHTS)}), cl AS (SELECT unnest(range(0, {P.CLASSES})) AS c),
raw AS (SELECT a.user_id, a.f, cl.c, coalesce(sum(mag * wt.w), 0) AS v FROM (SELECT DISTINCT user_id, f FROM sp) a CROSS JOIN cl LEFT JOIN wt ON wt.c = cl.c LEFT JOIN sp ON sp.user_id = a.user_id AND sp.f = a.f AND sp.k = wt.k GROUP BY 1, 2, 3),
tot AS (SELECT user_id, f, sum(v) AS e FROM raw GROUP BY 1, 2), med AS (SELECT user_id, list_sort(list(e))[count(*) // 2 + 1] AS median FROM tot GROUP BY 1),
cen AS (SELECT user_id, f, c, v - avg(v) OVER (PARTITION BY user_id, c) AS y FROM raw), len AS (SELECT user_id, f, sqrt(sum(y * y)) AS size FROM cen GROUP BY 1, 2)
SELECT cen.user_id, cen.f AS t, CAST(c AS INT) AS pitch_class, round(CASE WHEN e < {GATE} * median OR size = 0 THEN 0 ELSE y / size END, 5) AS value
FROM cen JOIN tot ON tot.user_id = cen.user_id AND tot.f = cen.f JOIN len ON len.user_id = cen.user_id AND len.f = cen.f JOIN med ON med.user_id = cen.user_id""")
def chroma_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra folded to twelve pitch classes, centred, gated and of unit length."""
    made = P.chroma(wide(spark, sf_dir), "user_id", WEIGHTS, GATE)
    return made.select("user_id", "t", F.posexplode("c").alias("pitch_class", "value")).withColumn("value", F.round("value", 5))


THIN, WINDOW, LAGS, JUMP = 2, 10, range(2, 6), 3
SMOOTH = L.butterworth(1.0, 0.2, 2)[0]
_LAGGED = ", ".join(f"coalesce(sum(w * w{g}), 0) AS r{g}" for g in LAGS)


@query(f"""WITH RECURSIVE {EV}, y(k, t, x1, x2, y1, y2) AS (SELECT user_id, t, value, 0.0::DOUBLE, {SMOOTH[0]!r}::DOUBLE * value, 0.0::DOUBLE FROM ev WHERE t = 0
UNION ALL SELECT s.user_id, s.t, s.value, r.x1, {SMOOTH[0]!r}::DOUBLE * s.value + {SMOOTH[1]!r}::DOUBLE * r.x1 + {SMOOTH[2]!r}::DOUBLE * r.x2 - ({SMOOTH[3]!r})::DOUBLE * r.y1 - ({SMOOTH[4]!r})::DOUBLE * r.y2, r.y1 FROM y r JOIN ev s ON s.user_id = r.k AND s.t = r.t + 1),
th AS (SELECT k, t // {THIN} AS t, y1 AS x FROM y WHERE t % {THIN} = 0), n AS (SELECT k, max(t) AS top FROM th GROUP BY 1), fr AS (SELECT k, top, unnest(range(0, top // {JUMP} + 1)) AS frame FROM n),
ea AS (SELECT fr.k, frame, t - frame * {JUMP} AS i, x - avg(x) OVER (PARTITION BY fr.k, frame) AS w FROM fr JOIN th ON th.k = fr.k AND t >= frame * {JUMP} AND t < frame * {JUMP} + {WINDOW} WHERE frame * {JUMP} + {WINDOW} - 1 <= top),
le AS (SELECT *, {', '.join(f'lead(w, {g}) OVER o AS w{g}' for g in LAGS)} FROM ea WINDOW o AS (PARTITION BY k, frame ORDER BY i)), su AS (SELECT k, frame, sum(w * w) AS r0, {_LAGGED} FROM le GROUP BY 1, 2)
SELECT fr.k AS user_id, fr.frame, round(coalesce(CASE WHEN r0 > 1e-12 THEN greatest(0, greatest({', '.join(f'r{g}' for g in LAGS)}) / r0) ELSE 0 END, 0), 5) AS value FROM fr LEFT JOIN su ON su.k = fr.k AND su.frame = fr.frame""")
def periodicity_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest autocorrelation of each frame's window of the low-passed, thinned series; frames without a whole window are 0."""
    y = L.filtered(series(spark, sf_dir), "user_id", [SMOOTH], "value")
    thin = y.filter(F.col("t") % THIN == 0).select("user_id", F.floor(F.col("t") / THIN).alias("t"), F.col("y").alias("x"))
    places = thin.groupBy("user_id").agg(F.max("t").alias("top")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / JUMP))).alias("frame")).withColumn("start", F.col("frame") * JUMP)
    return P.periodicity(thin, "user_id", places, WINDOW, LAGS).withColumn("value", F.round("value", 5))
