"""Calibration, scores, thresholds, gates and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import detect as D
from waveloom.operators import orders as O
from waveloom.operators import windows as W
from waveloom.plans.base import EV, query, series, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
POSITIVE = "l_returnflag = 'R'"


def _sql_fisher() -> str:
    moments = ", ".join(f"avg({x}) FILTER ({c}) AS {x}_m{k}, var_pop({x}) FILTER ({c}) AS {x}_v{k}" for x in FEATURES for k, c in ((1, POSITIVE), (0, f"NOT ({POSITIVE})")))
    weights = ", ".join(f"({x}_m1 - {x}_m0) / ({x}_v1 + {x}_v0 + 1e-9) AS w_{x}" for x in FEATURES)
    mid = " + ".join(f"({x}_m1 - {x}_m0) / ({x}_v1 + {x}_v0 + 1e-9) * ({x}_m1 + {x}_m0) / 2" for x in FEATURES)
    gap = " + ".join(f"({x}_m1 - {x}_m0) * ({x}_m1 - {x}_m0) / ({x}_v1 + {x}_v0)" for x in FEATURES)
    return f"""m AS (SELECT l_linenumber, count(*) FILTER ({POSITIVE}) AS pos_count, count(*) FILTER (NOT ({POSITIVE})) AS neg_count, {moments} FROM lineitem GROUP BY 1),
f AS (SELECT l_linenumber, pos_count, neg_count, {weights}, {mid} AS mid, sqrt({gap}) AS separation FROM m WHERE pos_count >= 10 AND neg_count >= 50)"""


FISHER = _sql_fisher()
ROUNDED = ", ".join(f"round(w_{x}, 8) AS w_{x}" for x in FEATURES)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fisher(table(spark, sf_dir, "lineitem"), "l_linenumber", F.expr(POSITIVE), FEATURES)


@query(f"WITH {FISHER} SELECT l_linenumber, pos_count, neg_count, {ROUNDED}, round(mid, 6) AS mid, round(separation, 6) AS separation FROM f")
def fisher_lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).select("l_linenumber", "pos_count", "neg_count", *[F.round(f"w_{x}", 8).alias(f"w_{x}") for x in FEATURES], F.round("mid", 6).alias("mid"), F.round("separation", 6).alias("separation"))


@query(f"""WITH {FISHER} SELECT l_linenumber, l_returnflag, count(*) AS n, round(avg({' + '.join(f'w_{x} * {x}' for x in FEATURES)} - mid), 6) AS mean_score,
round(max({' + '.join(f'w_{x} * {x}' for x in FEATURES)} - mid), 6) AS top_score FROM lineitem JOIN f USING (l_linenumber) GROUP BY 1, 2""")
def lda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = D.scored(table(spark, sf_dir, "lineitem"), F.broadcast(weights(spark, sf_dir)), "l_linenumber", FEATURES)  # seven line numbers
    return held.groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("top_score"))


@query(f"""WITH {EV}, th AS (SELECT user_id, (avg(value) FILTER (event_type = 'purchase') + avg(value) FILTER (event_type <> 'purchase')) / 2 AS threshold FROM ev GROUP BY 1),
f AS (SELECT ev.user_id, t FROM ev JOIN th USING (user_id) WHERE value > threshold)
SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS n FROM (SELECT *, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM f) GROUP BY user_id, g""")
def midpoint_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = series(spark, sf_dir)
    found = D.midpoints(held, "user_id", F.col("event_type") == "purchase", "value")
    return W.runs(held.join(found, "user_id"), "user_id", F.col("value") > F.col("threshold"))


@query(f"""WITH {EV}, r AS (SELECT user_id, min(t) AS a, max(t) AS b, round(avg(value), 6) AS level FROM (SELECT *, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM ev WHERE value > 50) GROUP BY user_id, g),
x AS (SELECT user_id, avg(value) AS reference FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, a, b, level FROM r JOIN x USING (user_id) WHERE level >= reference + 20""")
def level_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = series(spark, sf_dir)
    from pyspark.sql import Window

    loud = held.filter("value > 50").withColumn("g", F.col("t") - F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    levels = loud.groupBy("user_id", "g").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.round(F.avg("value"), 6).alias("level"))
    exemplars = held.filter("event_type = 'purchase'").select("user_id", F.col("value").alias("level"))
    return D.level_gate(levels, exemplars, "user_id", -20.0).select("user_id", "a", "b", "level")


@query(f"""WITH {EV}, x AS (SELECT user_id, avg(value) / 100 AS m, max(value) / 100 AS s, stddev_pop(value) / 100 AS b FROM ev GROUP BY 1)
SELECT user_id, round(((m - 0.2906) / 0.0918 + (s - 1.9010) / 0.0368 + (b - 0.5730) / 0.1600) / 3, 6) AS score,
((m - 0.2906) / 0.0918 + (s - 1.9010) / 0.0368 + (b - 0.5730) / 0.1600) / 3 >= 0.3 AS has_dialog FROM x""")
def dialog_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("m"), (F.max("value") / 100).alias("s"), (F.stddev_pop("value") / 100).alias("b"))
    score = D.z_mean({"mod4": F.col("m"), "mod_speech": F.col("s"), "band_sync": F.col("b")})
    return held.select("user_id", F.round(score, 6).alias("score"), (score >= 0.3).alias("has_dialog"))


@query("""SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(0.1 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p10,
list_sort(list(o_totalprice))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p90 FROM orders GROUP BY 1""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranks(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", {"p10": lambda n: F.floor(0.1 * (n - 1) + 0.5), "p90": lambda n: F.floor(0.9 * (n - 1) + 0.5)})


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median_price FROM lineitem GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ranks(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"median_price": lambda n: F.floor(n / 2)})


@query("""WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT a.event_type AS x, b.event_type AS y, round(coalesce(corr(a.v, b.v), 0), 6) AS r FROM d a JOIN d b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""")
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    other = daily.select(F.col("event_type").alias("y"), "day", F.col("v").alias("w"))
    return daily.join(other, "day").filter("event_type < y").groupBy(F.col("event_type").alias("x"), "y").agg(F.round(F.coalesce(F.corr("v", "w"), F.lit(0.0)), 6).alias("r"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def asset_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query("""SELECT event_type, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS loud, count(*) FILTER (value > 50) AS n_loud, round(sum(value * event_id) / sum(event_id), 6) AS weighted FROM events GROUP BY 1""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.sum(F.when(loud, F.col("value")).otherwise(0.0)), 4).alias("loud"), F.count_if(loud).alias("n_loud"),
        F.round(F.sum(F.col("value") * F.col("event_id")) / F.sum("event_id"), 6).alias("weighted"))
