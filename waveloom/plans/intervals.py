"""Interval queries: each event opens an interval of 1 to 12 hours for its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import intervals as I
from waveloom.operators.nearest import backward_forward
from waveloom.plans.base import EV, query, seconds, table

WIDTH = 6 * 3600


def spans(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(where).withColumn("s", seconds())
    return ev.select("user_id", "s", (F.col("s") + 3600 * (1 + F.pmod("event_id", F.lit(12)))).alias("e"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("s", seconds()).groupBy("user_id").agg(F.min("s").alias("lo"), (F.max("s") + 86400).alias("hi"))


IV = f"{EV}, iv AS (SELECT user_id, event_type, sec AS s, sec + 3600 * (1 + event_id % 12) AS e FROM ev)"
BOUNDS = "bounds AS (SELECT user_id, min(sec) AS lo, max(sec) + 86400 AS hi FROM ev GROUP BY 1)"


def merged(name: str, where: str = "true") -> str:
    return f"""{name}_z AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM iv WHERE {where}),
{name}_y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM {name}_z),
{name} AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}_y GROUP BY user_id, part)"""


@query(f"WITH {IV}, {merged('u')} SELECT user_id, s, e, n FROM u")
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.coalesce(spans(spark, sf_dir), "user_id")


@query(f"""WITH {IV}, {BOUNDS}, {merged('u')}, c AS (SELECT user_id, greatest(s, lo) AS s, least(e, hi) AS e, lo, hi FROM u JOIN bounds USING (user_id)),
g AS (SELECT user_id, lo AS s, min(s) AS e FROM c GROUP BY 1, 2 UNION ALL SELECT user_id, e, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), hi) FROM c)
SELECT user_id, s, e FROM g WHERE e > s""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.complement(I.coalesce(spans(spark, sf_dir), "user_id"), bounds(spark, sf_dir), "user_id")


KEEP = "SELECT user_id, s, e FROM iv a WHERE event_type = 'click' AND {} EXISTS (SELECT 1 FROM iv b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND a.s < b.e AND b.s < a.e)"


@query(f"WITH {IV} {KEEP.format('')}")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlapping(spans(spark, sf_dir, "event_type = 'click'"), spans(spark, sf_dir, "event_type = 'error'"), "user_id", WIDTH)


@query(f"WITH {IV} {KEEP.format('NOT')}")
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlapping(spans(spark, sf_dir, "event_type = 'click'"), spans(spark, sf_dir, "event_type = 'error'"), "user_id", WIDTH, keep=False)


@query(f"""WITH {IV}, {merged('p', "event_type = 'purchase'")}, {merged('c', "event_type = 'click'")}, {merged('v', "event_type = 'view'")},
two AS (SELECT user_id, s, e FROM p UNION ALL SELECT user_id, s, e FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = c.user_id AND p.s < c.e AND c.s < p.e))
SELECT user_id, s, e FROM two UNION ALL SELECT user_id, s, e FROM v WHERE NOT EXISTS (SELECT 1 FROM two WHERE two.user_id = v.user_id AND two.s < v.e AND v.s < two.e)""")
def union_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [I.coalesce(spans(spark, sf_dir, f"event_type = '{k}'"), "user_id").select("user_id", "s", "e") for k in ("purchase", "click", "view")]
    return I.union_without_overlap(groups, "user_id", WIDTH)


def _greedy(name: str, source: str) -> str:
    """Rows of source accepted in order of (s, e) when they overlap none accepted before: each next one is the first that starts at or after the last one's end."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS i FROM {source}),
{name}_p AS (SELECT a.*, (SELECT min(b.i) FROM {name}_n b WHERE b.user_id = a.user_id AND b.s >= a.e) AS nxt FROM {name}_n a),
{name}_r AS (SELECT user_id, s, e, i, nxt FROM {name}_p WHERE i = 1 UNION ALL SELECT p.user_id, p.s, p.e, p.i, p.nxt FROM {name}_r r JOIN {name}_p p ON p.user_id = r.user_id AND p.i = r.nxt),
{name} AS (SELECT user_id, s, e FROM {name}_r)"""


_FREE = "SELECT DISTINCT user_id, s, e FROM iv a WHERE event_type = '{}' AND NOT EXISTS (SELECT 1 FROM {} k WHERE k.user_id = a.user_id AND a.s < k.e AND k.s < a.e)"


@query(f"""WITH RECURSIVE {IV}, k0 AS (SELECT DISTINCT user_id, s, e FROM iv WHERE event_type = 'purchase'), f1 AS ({_FREE.format('click', 'k0')}), {_greedy('g1', 'f1')},
k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM g1), f2 AS ({_FREE.format('view', 'k1')}), {_greedy('g2', 'f2')} SELECT user_id, s, e FROM k1 UNION ALL SELECT user_id, s, e FROM g2""")
def union_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as they are, then clicks, then views: each kind's intervals overlap one another, and one is taken if it overlaps nothing taken before."""
    return I.union_without_overlap([spans(spark, sf_dir, f"event_type = '{k}'").distinct() for k in ("purchase", "click", "view")], "user_id", WIDTH)


@query(f"""WITH RECURSIVE {IV}, a0 AS (SELECT DISTINCT user_id, s, e FROM iv), {_greedy('g', 'a0')} SELECT user_id, s, e FROM g""")
def greedy_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intervals of a user in order of start, each taken if it overlaps none taken before."""
    return I.accepted(spans(spark, sf_dir).distinct(), "user_id")


@query(f"""WITH {IV}, {BOUNDS}, {merged('u', "event_type = 'purchase'")}
SELECT user_id, round(coalesce(sum(greatest(0, least(e, hi) - greatest(s, lo))), 0) / max(hi - lo), 6) AS fraction FROM bounds LEFT JOIN u USING (user_id) GROUP BY 1""")
def coverage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = I.covered(I.coalesce(spans(spark, sf_dir, "event_type = 'purchase'"), "user_id"), bounds(spark, sf_dir), "user_id")
    return held.select("user_id", F.round("fraction", 6).alias("fraction"))


@query(f"""WITH {IV} SELECT a.user_id, a.s, a.e, count(*) AS n, round(sum(p.value), 4) AS total FROM iv a JOIN ev p ON p.user_id = a.user_id AND p.sec >= a.s AND p.sec < a.e
WHERE a.event_type = 'error' GROUP BY 1, 2, 3""")
def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("user_id", "value", seconds().alias("sec"))
    held = I.rows_in(points, spans(spark, sf_dir, "event_type = 'error'"), "user_id", F.col("sec"), WIDTH)
    return held.groupBy("user_id", F.col("o_s").alias("s"), F.col("o_e").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {EV}, a AS (SELECT event_id, user_id, sec FROM ev WHERE event_type = 'purchase'), b AS (SELECT user_id, sec, event_id AS id, value FROM ev WHERE event_type = 'click')
SELECT a.event_id, a.sec AS at, b.sec AS near_at, b.value AS near_value FROM a JOIN b USING (user_id) QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.sec - b.sec), b.sec, b.value DESC) = 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("sec", seconds())
    left = ev.filter("event_type = 'purchase'").select("user_id", F.col("sec").alias("at"), F.col("event_id").alias("row_id"))
    near = backward_forward(left, ev.filter("event_type = 'click'"), "user_id", "at", "sec", "value")
    return near.filter("near_at IS NOT NULL").select(F.col("row_id").alias("event_id"), "at", "near_at", "near_value")
