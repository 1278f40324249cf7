"""Speech and refinement queries: modulation and synchrony over bands of embeddings, window scores over events, exact bounds of occurrences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import filters as L
from waveloom.operators import refine as R
from waveloom.operators import speech as S
from waveloom.operators import windows as W
from waveloom.operators.windows import ranked
from waveloom.plans.base import EV, query, series, table
from waveloom.plans.shared import stored

BANDS, WINDOW, HZ, SYNC, STEP = 6, 9, 10.0, 16, 4
_WEIGHTS = ", ".join(f"({i}, {c!r}::DOUBLE, {s!r}::DOUBLE)" for i, (c, s) in enumerate(S.modulation_weights(WINDOW, HZ, S.FINE_RATE)))
DEPTHS = f"""em AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings),
bands AS (SELECT label, t, unnest(range(0, {BANDS})) AS band, CAST(unnest(embedding[1:{BANDS}]) AS DOUBLE) AS x FROM em),
w(i, c, s) AS (VALUES {_WEIGHTS}), sums AS (SELECT a.label, a.band, a.t, sum(b.x * b.x * c) AS re, sum(b.x * b.x * s) AS im, sum(b.x * b.x) / {WINDOW} AS m
FROM bands a JOIN w ON true JOIN bands b ON b.label = a.label AND b.band = a.band AND b.t = a.t + i - {WINDOW // 2} GROUP BY 1, 2, 3),
depths AS (SELECT label, band, t, CASE WHEN m > 1e-20 THEN sqrt(re * re + im * im) / m ELSE 0 END AS depth FROM sums)"""


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = ranked(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    bands = em.select("label", "t", F.posexplode(F.slice("embedding", 1, BANDS)).alias("band", "x")).select("label", "band", "t", (F.col("x").cast("double") * F.col("x").cast("double")).alias("power"))
    return S.modulation(bands, "label", WINDOW, HZ)


@query(f"WITH {DEPTHS} SELECT label, t, round(log10(sum(depth) + 1e-12), 6) AS mod_speech FROM depths GROUP BY 1, 2")
def speech_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.speech_modulation(depths(spark, sf_dir), "label").select("label", "t", F.round("mod_speech", 6).alias("mod_speech"))


@query(f"""WITH {DEPTHS}, pairs AS (SELECT w.label, w.t AS win, a.band AS x, b.band AS y, coalesce(corr(a.depth, b.depth), 0) AS r FROM (SELECT DISTINCT label, t FROM depths WHERE t % {STEP} = 0 AND t >= {SYNC - 1}) w
JOIN depths a ON a.label = w.label AND a.t BETWEEN w.t - {SYNC - 1} AND w.t JOIN depths b ON b.label = a.label AND b.t = a.t AND b.band > a.band GROUP BY 1, 2, 3, 4),
sync AS (SELECT label, win, 1 - avg(r) AS v FROM pairs GROUP BY 1, 2) SELECT f.label, f.t, round(coalesce(v, 0), 6) AS band_sync FROM (SELECT DISTINCT label, t FROM depths) f LEFT JOIN sync ON sync.label = f.label AND win = f.t // {STEP} * {STEP}""")
def band_synchrony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.synchrony(depths(spark, sf_dir), "label", BANDS, SYNC, STEP).select("label", "t", F.round("band_sync", 6).alias("band_sync"))


@query(f"""WITH {EV}, m AS (SELECT user_id, max(t) AS top FROM ev GROUP BY 1), f AS (SELECT user_id, unnest(range(0, CAST(floor((top + 1) / 2.56) AS BIGINT) + 1)) AS frame FROM m)
SELECT f.user_id, frame, round(avg(value), 6) AS value FROM f JOIN ev ON ev.user_id = f.user_id AND t >= floor(frame * 2.56::DOUBLE) AND t < floor((frame + 1) * 2.56::DOUBLE) GROUP BY 1, 2""")
def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_frames(series(spark, sf_dir), "user_id", "value", 2.56).select("user_id", "frame", F.round("value", 6).alias("value"))


FPS = 2.0
CONSTANTS = {"loud": (0.5, 0.3), "quick": (0.4, 0.2)}
SEGMENTS = """isl AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM ev WHERE value > 50), runs AS (SELECT user_id, min(t) AS a, max(t) AS b FROM isl GROUP BY user_id, g),
z AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a) <= 4 THEN 0 ELSE 1 END AS new FROM runs), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS part FROM z),
seg AS (SELECT user_id, min(a) / 2.0::DOUBLE AS s, (max(b) + 1) / 2.0::DOUBLE AS e FROM y GROUP BY user_id, part)"""


@query(f"""WITH {EV}, {SEGMENTS}, sm AS (SELECT user_id, t, avg(value / 100) OVER w AS loud, avg((event_id % 10) / 10.0::DOUBLE) OVER w AS quick FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
win AS (SELECT user_id, s, e, s AS beg, greatest(0.5, e - s) AS d FROM seg WHERE e - s <= 6 UNION SELECT user_id, s, e, unnest(list_transform(range(0, CAST(floor((e - s - 6) / 3) AS BIGINT) + 1), lambda k: s + k * 3.0)), 6.0 FROM seg WHERE e - s > 6
UNION SELECT user_id, s, e, e - 6 AS beg, 6.0 FROM seg WHERE e - s > 6),
top AS (SELECT w.user_id, s, e, beg, coalesce(max(loud), 0) AS loud, coalesce(max(quick), 0) AS quick FROM win w LEFT JOIN sm ON sm.user_id = w.user_id AND t >= floor(beg * 2) AND t < ceil((beg + d) * 2) GROUP BY 1, 2, 3, 4)
SELECT user_id, s, e, round(max(((loud - 0.5) / 0.3 + (quick - 0.4) / 0.2) / 2), 6) AS score, max(((loud - 0.5) / 0.3 + (quick - 0.4) / 0.2) / 2) >= 0.3 AS has_dialog FROM top GROUP BY 1, 2, 3""")
def dialog_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = series(spark, sf_dir)
    found = W.bridged(W.runs(ev, "user_id", F.col("value") > 50), "user_id", 4).select("user_id", (F.col("a") / FPS).alias("s"), ((F.col("b") + 1) / FPS).alias("e"))
    frames = ev.select("user_id", "t", (F.col("value") / 100).alias("loud"), (F.pmod("event_id", F.lit(10)) / 10).alias("quick"))
    return S.dialog_scores(frames, found, "user_id", FPS, CONSTANTS).select("user_id", "s", "e", F.round("score", 6).alias("score"), "has_dialog")


RATE, ENVELOPE, FRAMES, TWO = 8.0, 4.0, 1.6, ((0.5, 1.5), (1.5, 3.0))


def _iir(name: str, source: str, section: tuple[float, ...]) -> str:
    b0, b1, b2, a1, a2 = (f"({x!r})::DOUBLE" for x in section)
    return f"""{name}(k, t, x1, x2, y1, y2) AS (SELECT k, t, x, 0.0::DOUBLE, {b0} * x, 0.0::DOUBLE FROM {source} WHERE t = 0
UNION ALL SELECT s.k, s.t, s.x, r.x1, {b0} * s.x + {b1} * r.x1 + {b2} * r.x2 - {a1} * r.y1 - {a2} * r.y2, r.y1 FROM {name} r JOIN {source} s ON s.k = r.k AND s.t = r.t + 1)"""


def _mod4_sql() -> str:
    bands = [L.bandpass(RATE, (lo * hi) ** 0.5, max(0.5, (lo * hi) ** 0.5 / (hi - lo))) for lo, hi in TWO]
    parts = ", ".join(_iir(f"y{i}", "src", c) for i, c in enumerate(bands))
    envelopes = " UNION ALL ".join(f"SELECT k || '|{i}' AS k, k AS u, t // 2 AS t, e FROM (SELECT k, t, avg(abs(y1)) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM y{i}) WHERE t % 2 = 0" for i in range(len(TWO)))
    again = _iir("again", "flat", L.bandpass(ENVELOPE, 0.9, 1.2))
    return f"""WITH RECURSIVE {EV}, src AS (SELECT CAST(user_id AS VARCHAR) AS k, t, value AS x FROM ev), size AS (SELECT k, count(*) AS n FROM src GROUP BY 1), {parts},
env AS (SELECT x.* FROM ({envelopes}) x JOIN size ON size.k = x.u WHERE t < n // 2), flat AS (SELECT k, u, t, e - avg(e) OVER (PARTITION BY k) AS x FROM env), {again},
ms AS (SELECT f.k, u, f.t, avg(y1 * y1) OVER w AS num, avg(x * x) OVER w AS den FROM flat f JOIN again a ON a.k = f.k AND a.t = f.t WINDOW w AS (PARTITION BY f.k ORDER BY f.t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
tot AS (SELECT u, t, sum(CASE WHEN den > 1e-12 THEN num / den ELSE 0 END) / {len(TWO)} AS m FROM ms GROUP BY 1, 2),
fr AS (SELECT k, n, unnest(range(0, CAST(floor(n * {FRAMES}::DOUBLE / {RATE}::DOUBLE) AS BIGINT))) AS frame FROM size)
SELECT CAST(k AS BIGINT) AS user_id, frame, round(m, 5) AS mod4 FROM fr JOIN tot ON u = k AND t = least(n // 2 - 1, CAST(floor(frame / {FRAMES}::DOUBLE * {ENVELOPE}::DOUBLE + 0.5) AS BIGINT))"""


@query(_mod4_sql())
def envelope_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as a signal of 8 values a second: two bands, envelopes at 4 a second, frames at 1.6."""
    x = series(spark, sf_dir).select("user_id", "t", F.col("value").alias("x"))
    made = S.envelope_modulation(x, "user_id", RATE, FRAMES, TWO, ENVELOPE, (0.9, 1.2), smooth=3)
    return made.select("user_id", "frame", F.round("mod4", 5).alias("mod4"))


A, B, RULE = 10, 24, R.Rule(search=3, pad=5, smooth=4, threshold=0.10, fall=0.04, least_run=3, least_sim=0.02, longest=20, least_pairs=4)
PROFILES = f"""em AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
nf AS (SELECT count(*) AS n FROM em WHERE label = 0), est AS (SELECT DISTINCT label AS id, CAST({A} + label % 3 AS BIGINT) AS beg, CAST({B} + label % 3 AS BIGINT) AS until, label <> 4 AS present FROM em WHERE label > 0),
sims AS (SELECT id, d, avg(list_dot_product(r.v, o.v)) AS sim FROM (SELECT id, unnest(range(beg - {A} - 3, beg - {A} + 4)) AS d FROM est WHERE present) g JOIN em r ON r.label = 0 AND r.t >= {A} + 2 AND r.t < {B} - 2 JOIN em o ON o.label = id AND o.t = r.t + d GROUP BY 1, 2),
off AS (SELECT id, d FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 6) DESC, d) = 1),
raw AS (SELECT id, d, rt, coalesce(list_dot_product(r.v, o.v), 0) AS raw FROM (SELECT id, d, unnest(range({A - 5}, {B + 5})) AS rt FROM off) x LEFT JOIN em r ON r.label = 0 AND r.t = rt LEFT JOIN em o ON o.label = id AND o.t = rt + d WHERE rt < (SELECT n FROM nf)),
hi AS (SELECT max(rt) AS top FROM raw), sm AS (SELECT a.id, a.d, a.rt, avg(b.raw) AS sm FROM raw a CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) CROSS JOIN hi JOIN raw b ON b.id = a.id AND b.rt = least(greatest(a.rt + k, {A - 5}), top) GROUP BY 1, 2, 3),"""
BY_THRESHOLD = f"""lev AS (SELECT id, d, k, rt, rt - row_number() OVER (PARTITION BY id, k ORDER BY rt) AS g FROM sm CROSS JOIN (VALUES (0, 0.10::DOUBLE), (1, 0.10::DOUBLE - 0.04::DOUBLE), (2, 0.10::DOUBLE - 2 * 0.04::DOUBLE)) l(k, over_) WHERE round(sm, 9) > over_),
run AS (SELECT id, d, k, min(rt) AS t0, count(*) AS n FROM lev GROUP BY id, d, k, g), one AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY n DESC, t0) = 1),
cut AS (SELECT id, d, t0, t0 + n - 1 AS t1 FROM one QUALIFY row_number() OVER (PARTITION BY id ORDER BY n >= 3 DESC, CASE WHEN n >= 3 THEN k END, n DESC, k) = 1),"""
BY_GRADIENT = f"""lead AS (SELECT id, d, rt, sm, coalesce(lead(sm) OVER (PARTITION BY id ORDER BY rt) - sm, 0) AS g FROM sm),
gs AS (SELECT a.id, a.d, a.rt, round(a.sm, 9) AS v, round(avg(b.g), 9) AS g FROM lead a CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) CROSS JOIN hi JOIN lead b ON b.id = a.id AND b.rt = least(greatest(a.rt + k, {A - 5}), top) GROUP BY ALL),
top AS (SELECT id, rt AS peak FROM gs QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, rt) = 1),
up AS (SELECT gs.id, d, rt AS t0 FROM gs JOIN top USING (id) WHERE rt <= peak QUALIFY row_number() OVER (PARTITION BY gs.id ORDER BY g DESC, rt) = 1),
down AS (SELECT gs.id, rt + 1 AS t1 FROM gs JOIN top USING (id) WHERE rt >= peak QUALIFY row_number() OVER (PARTITION BY gs.id ORDER BY g, rt) = 1),
cut AS (SELECT id, d, t0, t1 FROM up JOIN down USING (id)),"""


def _refined(cut: str, least: int) -> str:
    return f"""{PROFILES} {cut} ins AS (SELECT cut.id, avg(raw) AS sim FROM cut JOIN raw ON raw.id = cut.id AND rt >= t0 AND rt < t1 GROUP BY 1),
ea AS (SELECT est.*, d, t0, t1, sim, coalesce(t1 > t0 AND t1 - t0 >= 3, false) AND present AS read FROM est LEFT JOIN cut USING (id) LEFT JOIN ins USING (id)), ev2 AS (SELECT *, read AND round(sim, 9) >= 0.02 AS sure FROM ea),
sh AS (SELECT count(*) AS n, list_sort(list(t0))[CAST(floor(0.1 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS lo, list_sort(list(t1))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS hi,
list_sort(list(t0))[count(*) // 2 + 1] AS m0, list_sort(list(t1))[count(*) // 2 + 1] AS m1, list_sort(list(sim))[count(*) // 2 + 1] AS ms FROM ev2 WHERE sure HAVING count(*) > 0),
mem AS (SELECT id, present AND (sure OR NOT read) AS present, CASE WHEN sure THEN CASE WHEN n >= {least} THEN lo ELSE t0 END + d WHEN NOT read THEN beg END AS start, CASE WHEN sure THEN CASE WHEN n >= {least} THEN hi ELSE t1 END + d WHEN NOT read THEN until END AS stop,
CASE WHEN read THEN sim ELSE 0 END AS sim, sure AS refined, CASE WHEN sure THEN d END AS d, false AS is_reference FROM ev2 CROSS JOIN sh UNION ALL SELECT NULL, true, CASE WHEN n >= {least} THEN lo ELSE m0 END, CASE WHEN n >= {least} THEN hi ELSE m1 END, ms, true, NULL, true FROM sh),
fin AS (SELECT * REPLACE (present AND stop - start <= 20 AS present) FROM mem)"""


@query(f"WITH {_refined(BY_THRESHOLD, 4)} SELECT id, present, CASE WHEN present THEN start END AS start, CASE WHEN present THEN stop END AS stop, round(sim, 5) AS sim, refined, d, is_reference FROM fin")
def refined_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of embeddings as members, their rows in order as frames; label 0 is the reference."""
    return _bounds(spark, sf_dir, RULE)


@query(f"WITH {_refined(BY_GRADIENT, 1000)} SELECT id, present, CASE WHEN present THEN start END AS start, CASE WHEN present THEN stop END AS stop, round(sim, 5) AS sim, refined, d, is_reference FROM fin")
def refined_by_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the boundary at the steepest rise and fall, each member with its own extent."""
    return _bounds(spark, sf_dir, replace(RULE, boundary="gradient", extent="member"))


def _bounds(spark: SparkSession, sf_dir: str, rule: R.Rule) -> DataFrame:
    em = stored(ranked(table(spark, sf_dir, "embeddings"), "label", "vec_id").select(F.col("label").alias("id"), "t", F.col("embedding").alias("v")), "frames")
    reference, others = em.filter("id = 0"), em.filter("id > 0")
    estimates = others.select("id").distinct().select("id", (A + F.col("id") % 3).cast("long").alias("at"), (B + F.col("id") % 3).cast("long").alias("until"), (F.col("id") != 4).alias("present"))
    found = R.refined(reference, others, estimates, A, B, reference.count(), rule=rule)
    return found.select("id", "present", "start", "stop", F.round("sim", 5).alias("sim"), "refined", "d", "is_reference")
