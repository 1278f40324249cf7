"""Segmentation per episode with errors, the export plan, and small formatters, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import detect as D
from waveloom.operators import export as X
from waveloom.operators import segments as S
from waveloom.plans.base import EV, query, seconds, series, table
from waveloom.plans.intervals import BOUNDS, IV, bounds, merged, spans
from waveloom.plans.shared import stored

FPS, FEATURES = 3.0, ["level", "phase"]
POSITIVE = "(t >= 6 AND t < 15) OR (t >= 24 AND t < 30)"
FRAMES = f"fr AS (SELECT user_id AS id, t, value AS level, (event_id % 7) / 7.0::DOUBLE AS phase, ({POSITIVE}) AS pos FROM ev), top AS (SELECT id, max(t) AS top FROM fr GROUP BY 1)"


def _segments(score: str, floor: str) -> str:
    """SQL from sc (id, t, score) and fl (id, floor) to seg (id, s, e, peak, mean_score, first, last)."""
    clamp = "SELECT a.id, a.t, b.{x} AS x FROM {src} a JOIN top USING (id) CROSS JOIN (SELECT unnest(range(-3, 4)) AS k) JOIN {src} b ON b.id = a.id AND b.t = least(greatest(a.t + k, 0), top)"
    return f"""{score}, {floor}, md AS (SELECT id, t, list_sort(list(x))[4] AS x FROM ({clamp.format(x='score', src='sc')}) GROUP BY 1, 2), sm AS (SELECT id, t, avg(x) AS v FROM ({clamp.format(x='x', src='md')}) GROUP BY 1, 2),
isl AS (SELECT id, t, t - row_number() OVER (PARTITION BY id ORDER BY t) AS g FROM sm WHERE v > 0), rn AS (SELECT id, min(t) AS a, max(t) AS b FROM isl GROUP BY id, g),
br AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY id ORDER BY a) <= 2 THEN 0 ELSE 1 END AS new FROM rn), bs AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a) AS part FROM br), bd AS (SELECT id, min(a) AS a, max(b) AS b FROM bs GROUP BY id, part),
rm AS (SELECT id, a, b, coalesce(floor((lag(b) OVER w + a) / 2) + 1, 0) AS lo, coalesce(floor((b + lead(a) OVER w) / 2), top) AS hi FROM bd JOIN top USING (id) WINDOW w AS (PARTITION BY id ORDER BY a)),
nr AS (SELECT rm.*, t, v, max(CASE WHEN t BETWEEN a AND b THEN v END) OVER (PARTITION BY id, a) AS peak FROM rm JOIN sm USING (id) WHERE t BETWEEN lo AND hi),
eg AS (SELECT *, coalesce(max(CASE WHEN t < a AND v <= -0.1 * peak THEN t END) OVER (PARTITION BY id, a) + 1, min(t) OVER (PARTITION BY id, a)) AS f, coalesce(min(CASE WHEN t > b AND v <= -0.1 * peak THEN t END) OVER (PARTITION BY id, a) - 1, max(t) OVER (PARTITION BY id, a)) AS l FROM nr),
ct AS (SELECT id, a, b, min(t) AS first, max(t) AS last, any_value(peak) AS peak, avg(v) AS mean_score FROM eg WHERE t BETWEEN f AND l GROUP BY 1, 2, 3),
seg AS (SELECT id, first / 3.0::DOUBLE AS s, (last + 1) / 3.0::DOUBLE AS e, peak, mean_score, first, last FROM ct JOIN fl USING (id) WHERE (b - a + 1) / 3.0::DOUBLE >= 4 AND peak >= floor)"""


CALIBRATED = """m AS (SELECT id, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn, avg(level) FILTER (pos) AS l1, avg(level) FILTER (NOT pos) AS l0, var_pop(level) FILTER (pos) + var_pop(level) FILTER (NOT pos) AS lv,
avg(phase) FILTER (pos) AS p1, avg(phase) FILTER (NOT pos) AS p0, var_pop(phase) FILTER (pos) + var_pop(phase) FILTER (NOT pos) AS pv FROM fr GROUP BY 1),
cal AS (SELECT *, (l1 - l0) / (lv + 1e-9) AS wl, (p1 - p0) / (pv + 1e-9) AS wp, sqrt((l1 - l0) * (l1 - l0) / lv + (p1 - p0) * (p1 - p0) / pv) AS separation FROM m WHERE np >= 10 AND nn >= 50)"""
ERROR = "'calibration needs 10 positive and 50 negative frames, has ' || np || ' and ' || nn"
MUSIC = _segments("sc AS (SELECT id, t, pos, wl * level + wp * phase - (wl * (l1 + l0) / 2 + wp * (p1 + p0) / 2) AS score FROM fr JOIN cal USING (id))", "fl AS (SELECT id, 0.7 * avg(score) AS floor FROM sc WHERE pos GROUP BY 1)")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select(F.col("user_id").alias("id"), "t", F.col("value").alias("level"), (F.pmod("event_id", F.lit(7)) / 7).alias("phase"))


def exemplars(held: DataFrame) -> DataFrame:
    return held.select("id").distinct().select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((2.0, 5.0), (8.0, 10.0))])).alias("x")).select("id", "x.s", "x.e")


def durations(held: DataFrame) -> DataFrame:
    return held.groupBy("id").agg((F.count(F.lit(1)) / FPS).alias("duration"))


def rounded(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"), F.round("peak", 5).alias("peak"), F.round("mean_score", 5).alias("mean_score"))


@query(f"""WITH {EV}, {FRAMES}, {CALIBRATED}, {MUSIC}, ref AS (SELECT id, avg(l) AS r FROM (SELECT id, avg(level) AS l FROM fr WHERE pos GROUP BY id, t >= 20) GROUP BY 1),
lv AS (SELECT seg.id, s, any_value(e) AS e, any_value(peak) AS peak, any_value(mean_score) AS mean_score, avg(level) AS lev FROM seg JOIN fr ON fr.id = seg.id AND t BETWEEN first AND last GROUP BY 1, 2), kept AS (SELECT lv.* FROM lv JOIN ref USING (id) WHERE lev >= r - 40)
SELECT id, round(s, 6) AS s, round(e, 6) AS e, round(peak, 5) AS peak, round(mean_score, 5) AS mean_score, round(separation, 6) AS separation, NULL AS error FROM cal LEFT JOIN kept USING (id)
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, {ERROR} FROM m WHERE np < 10 OR nn < 50""")
def music_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an episode of three frames a second with two exemplars; users with too few events have an error row."""
    held = frames(spark, sf_dir)
    found = S.ranges_for(held, exemplars(held), durations(held), features=FEATURES, fps=FPS, slack=40.0, ceiling=1.0)
    return found.select("id", *[F.round(c, k).alias(c) for c, k in (("s", 6), ("e", 6), ("peak", 5), ("mean_score", 5), ("separation", 6))], "error")


@query(f"""WITH {EV}, {FRAMES}, mid AS (SELECT id, (avg(-level) FILTER (pos) + avg(-level) FILTER (NOT pos)) / 2 AS th, avg(-level) FILTER (pos) AS mean FROM fr GROUP BY 1),
{_segments("sc AS (SELECT id, t, -level - th AS score FROM fr JOIN mid USING (id) WHERE th IS NOT NULL)", "fl AS (SELECT id, 0.7 * (mean - th) AS floor FROM mid)")}
SELECT id, round(s, 6) AS s, round(e, 6) AS e, round(peak, 5) AS peak, round(mean_score, 5) AS mean_score FROM seg""")
def low_side_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by one series whose low side is sought."""
    held = frames(spark, sf_dir)
    return rounded(S.by_series(held, exemplars(held), durations(held), "level", -1, FPS, 1.0))


@query(f"""WITH {EV}, {FRAMES}, m AS (SELECT id, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM fr GROUP BY 1) SELECT id, {ERROR} AS error FROM m WHERE np < 10 OR nn < 50""")
def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = frames(spark, sf_dir)
    return D.calibration_errors(S.marked(held, exemplars(held), FPS), "id", F.col("positive"))


EXTRAS, DIALOG, CEILING = [("third", 1), ("phase", -1)], {"loud": (0.5, 0.3), "quick": (0.4, 0.2)}, 0.4
WIDE = FRAMES.replace("AS pos FROM ev)", "AS pos, CASE WHEN user_id % 4 > 0 THEN (event_id % 5) / 5.0::DOUBLE END AS third, value / 100 AS loud, (event_id % 10) / 10.0::DOUBLE AS quick FROM ev)")


def _gated(name: str, body: str, detector: str) -> str:
    """Segments of one detector under the ceiling whose level is at most 40 under the exemplars'."""
    return f"""{name} AS (WITH {body}, lv AS (SELECT seg.id, s, any_value(e) AS e, any_value(peak) AS peak, any_value(mean_score) AS mean_score, avg(level) AS lev FROM seg JOIN fr ON fr.id = seg.id AND t BETWEEN first AND last GROUP BY 1, 2)
SELECT lv.id, s, e, peak, mean_score, '{detector}' AS detector FROM lv JOIN ref ON ref.id = lv.id JOIN top ON top.id = lv.id WHERE lev >= r - 40 AND e - s <= {CEILING} * (top + 1) / 3.0::DOUBLE)"""


def _by(x: str, side: int) -> str:
    return _segments(
        f"mid AS (SELECT id, (avg({side} * {x}) FILTER (pos) + avg({side} * {x}) FILTER (NOT pos)) / 2 AS th, avg({side} * {x}) FILTER (pos) AS mean FROM fr JOIN cal USING (id) GROUP BY 1), sc AS (SELECT id, t, {side} * {x} - th AS score FROM fr JOIN mid USING (id) WHERE th IS NOT NULL)",
        "fl AS (SELECT id, 0.7 * (mean - th) AS floor FROM mid WHERE th IS NOT NULL)")


_NO = "NOT EXISTS (SELECT 1 FROM {k} k WHERE k.id = x.id AND x.s < k.e AND k.s < x.e)"
FULL = f"""{EV}, {WIDE}, {CALIBRATED}, ref AS (SELECT id, avg(l) AS r FROM (SELECT id, avg(level) AS l FROM fr WHERE pos GROUP BY id, t >= 20) GROUP BY 1),
{_gated('g0', MUSIC, 'exemplar')}, {_gated('g1', _by(*EXTRAS[0]), 'third')}, {_gated('g2', _by(*EXTRAS[1]), 'phase')},
k1 AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1 x WHERE {_NO.format(k='g0')}), k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM g2 x WHERE {_NO.format(k='k1')}),
ex AS (SELECT DISTINCT id, 12.0::DOUBLE AS s, 13.5::DOUBLE AS e FROM fr WHERE id % 2 = 0), kept AS (SELECT * FROM k2 x WHERE {_NO.format(k='ex')}),
dm AS (SELECT id, t, avg(loud) OVER w AS loud, avg(quick) OVER w AS quick FROM fr WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
win AS (SELECT id, s, e, s AS beg, greatest(0.5, e - s) AS d FROM kept WHERE e - s <= 6 UNION SELECT id, s, e, unnest(list_transform(range(0, CAST(floor((e - s - 6) / 3) AS BIGINT) + 1), lambda k: s + k * 3.0)), 6.0 FROM kept WHERE e - s > 6
UNION SELECT id, s, e, e - 6 AS beg, 6.0 FROM kept WHERE e - s > 6),
dt AS (SELECT w.id, s, e, beg, ((coalesce(max(loud), 0) - 0.5) / 0.3 + (coalesce(max(quick), 0) - 0.4) / 0.2) / 2 AS score FROM win w LEFT JOIN dm ON dm.id = w.id AND t >= floor(beg * 3) AND t < ceil((beg + d) * 3) GROUP BY 1, 2, 3, 4),
fg AS (SELECT id, s, e, max(score) AS score FROM dt GROUP BY 1, 2, 3)"""


@query(f"""WITH {FULL} SELECT cal.id, round(kept.s, 6) AS s, round(kept.e, 6) AS e, round(peak, 5) AS peak, round(mean_score, 5) AS mean_score, detector, round(fg.score, 5) AS dialog_score, fg.score >= 0.3 AS has_dialog, round(separation, 6) AS separation,
CASE WHEN cal.id % 4 = 0 THEN 'third has no values inside or outside the exemplars' END AS extra_error, NULL AS error FROM cal LEFT JOIN kept ON kept.id = cal.id LEFT JOIN fg ON fg.id = kept.id AND fg.s = kept.s AND fg.e = kept.e
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {ERROR} FROM m WHERE np < 10 OR nn < 50""")
def music_ranges_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exemplars' detector with two others in its gaps, ranges left out, dialog marked, errors by name; one user in four lacks a series."""
    ev = series(spark, sf_dir)
    lacking = F.when(F.col("user_id") % 4 > 0, F.pmod("event_id", F.lit(5)) / 5)
    held = stored(ev.select(F.col("user_id").alias("id"), "t", F.col("value").alias("level"), (F.pmod("event_id", F.lit(7)) / 7).alias("phase"), lacking.alias("third"), (F.col("value") / 100).alias("loud"), (F.pmod("event_id", F.lit(10)) / 10).alias("quick")), "frames")
    taken = held.filter("id % 2 = 0").select("id").distinct().select("id", F.lit(12.0).alias("s"), F.lit(13.5).alias("e"))
    found = S.full_ranges(held, exemplars(held), durations(held), EXTRAS, taken, DIALOG, features=FEATURES, fps=FPS, slack=40.0, ceiling=CEILING)
    places = {"s": 6, "e": 6, "peak": 5, "mean_score": 5, "dialog_score": 5, "separation": 6}
    return found.withColumns({c: F.round(c, k) for c, k in places.items()})


@query(f"""WITH {EV}, x AS (SELECT user_id AS id, t, value - 30 * ((event_id % 7) / 7.0::DOUBLE) AS x FROM ev), n AS (SELECT id, least(30, count(*) // 2) AS n FROM x GROUP BY 1),
w AS (SELECT a.id, a.t, n, round(sum(b.x), 6) AS s FROM x a JOIN n ON n.id = a.id AND n >= 12 JOIN x b ON b.id = a.id AND b.t >= a.t AND b.t < a.t + n WHERE a.t % 2 = 0 GROUP BY 1, 2, 3 HAVING count(*) = n)
SELECT id, t / 3.0::DOUBLE AS s, (t + n) / 3.0::DOUBLE AS e FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, t) = 1""")
def foreground_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudest and least modulated stretch of each user's events, at most half of them."""
    return S.foreground(frames(spark, sf_dir), "level", "phase", FPS)


CONTAINERS = ["wav", "flac", "webm", "mp4", "unknown"]


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = bounds(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(c) for c in CONTAINERS]), (F.col("user_id") % len(CONTAINERS) + 1).cast("int"))
    files = whole.select(F.col("user_id").alias("id"), F.concat(F.lit("show."), F.col("user_id").cast("string"), F.lit(".bin")).alias("name"), kind.alias("container"), (F.col("hi") - F.col("lo")).cast("double").alias("duration"))
    cut = spans(spark, sf_dir, "event_type = 'purchase'").join(whole, "user_id").select(F.col("user_id").alias("id"), (F.col("s") - F.col("lo")).cast("double").alias("s"), (F.col("e") - F.col("lo")).cast("double").alias("e"))
    return X.plan(files, cut)


PLAN = f"""{IV}, {BOUNDS}, {merged('u', "event_type = 'purchase'")}, f AS (SELECT user_id, (['wav', 'flac', 'webm', 'mp4', 'unknown'])[user_id % 5 + 1] AS c, CAST(hi - lo AS DOUBLE) AS d, lo, hi FROM bounds),
t AS (SELECT f.user_id AS id, c, d, count(s) AS n_ranges, CAST(coalesce(sum(least(e, hi) - greatest(s, lo)), 0) AS DOUBLE) AS inside FROM f LEFT JOIN u USING (user_id) GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN n_ranges = 0 THEN 'nothing to remove' WHEN c = 'webm' THEN 'cutting webm is not implemented' WHEN c = 'unknown' THEN 'unknown container' WHEN inside >= d THEN 'every sample would be removed' END AS refusal FROM t),
p AS (SELECT id, n_ranges, CASE WHEN refusal IS NULL THEN inside ELSE 0 END AS removed, d - CASE WHEN refusal IS NULL THEN inside ELSE 0 END AS output, CASE WHEN refusal IS NULL THEN 'show.' || id || '.' || CASE c WHEN 'mp4' THEN 'm4a' ELSE c END END AS target, refusal FROM r)"""


@query(f"WITH {PLAN} SELECT * FROM p")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases of a user as what is cut from a file; every file has a row, with its target or the reason why not."""
    return planned(spark, sf_dir)


@query(f"WITH {PLAN} SELECT count(target) AS written, sum(removed) AS removed, count(*) - count(target) AS skipped FROM p")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.report(planned(spark, sf_dir))


@query("SELECT event_id, CAST(floor(x / 60) AS BIGINT) || ':' || printf('%04.1f', x - 60 * floor(x / 60)) AS clock FROM (SELECT event_id, floor(value) + 0.5 AS x FROM events)")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.clock(F.floor("value") + F.lit(0.5)).alias("clock"))


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, t, value AS y FROM ev WHERE t = 0 UNION ALL SELECT ev.user_id, ev.t, 0.5 * r.y + 0.5 * ev.value FROM r JOIN ev ON ev.user_id = r.user_id AND ev.t = r.t + 1)
SELECT user_id, round(y, 6) AS value FROM r QUALIFY t = max(t) OVER (PARTITION BY user_id)""")
def smoothed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.smoothed_share(series(spark, sf_dir), "user_id", "value").select("user_id", F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT user_id, epoch_us(ts) // 1000000 // 3600 AS h, value FROM events), n AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000000 / 3600.0 + 0.5) AS BIGINT) AS h FROM events WHERE event_type = 'purchase')
SELECT event_id, count(p.user_id) AS n, round(coalesce(sum(value), 0), 4) AS total FROM n LEFT JOIN p USING (user_id, h) GROUP BY 1""")
def nearest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with what happened in the hour nearest to it: an equi-join on the rounded time."""
    ev = table(spark, sf_dir, "events").withColumn("sec", seconds())
    near = ev.filter("event_type = 'purchase'").select("event_id", "user_id", F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1000000 / 3600.0 + 0.5).alias("h"))
    hours = ev.select("user_id", F.floor(F.col("sec") / 3600).alias("h"), "value")
    return near.join(hours, ["user_id", "h"], "left").groupBy("event_id").agg(F.count("value").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))
