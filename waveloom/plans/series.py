"""Window, run and block queries over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import windows as W
from waveloom.plans.base import EV, query, seconds, series, table

CLAMPED = """x AS (SELECT a.user_id, a.t, b.value FROM ev a JOIN (SELECT user_id, max(t) AS top FROM ev GROUP BY 1) m USING (user_id)
  CROSS JOIN (SELECT unnest(range(-{h}, {h} + 1)) AS k) s JOIN ev b ON b.user_id = a.user_id AND b.t = least(greatest(a.t + k, 0), m.top))"""
ISLANDS = """runs AS (SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS n FROM
  (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM ev WHERE value > 50) GROUP BY user_id, g)"""


@query(f"WITH {EV} SELECT user_id, t, round(avg(abs(value)) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS m FROM ev")
def moving_mean_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.moving_mean(series(spark, sf_dir), "user_id", F.abs("value"), 9).select("user_id", "t", F.round("m", 6).alias("m"))


@query(f"WITH {EV} SELECT user_id, t, round(avg(value * value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 7) AS m FROM ev")
def moving_mean_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.moving_mean(series(spark, sf_dir), "user_id", F.col("value") * F.col("value"), 7).select("user_id", "t", F.round("m", 7).alias("m"))


@query(f"WITH {EV}, {CLAMPED.format(h=4)} SELECT user_id, t, round(avg(value), 6) AS m FROM x GROUP BY 1, 2")
def moving_mean_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.edge_mean(series(spark, sf_dir), "user_id", "value", 4).select("user_id", "t", F.round("m", 6).alias("m"))


@query(f"WITH {EV}, {CLAMPED.format(h=3)} SELECT user_id, t, list_sort(list(value))[4] AS m FROM x GROUP BY 1, 2")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.edge_median(series(spark, sf_dir), "user_id", "value", 3).select("user_id", "t", "m")


@query(f"""WITH {EV}, x AS (SELECT user_id, t // 20 AS bucket, avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS m FROM ev)
SELECT user_id, bucket, round(max(m), 6) AS peak FROM x GROUP BY 1, 2""")
def trailing_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trailing_max(series(spark, sf_dir), "user_id", "value", 16, F.floor(F.col("t") / 20)).select("user_id", "bucket", F.round("peak", 6).alias("peak"))


@query(f"WITH {EV}, {ISLANDS} SELECT user_id, a, b, n FROM runs")
def islands_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.runs(series(spark, sf_dir), "user_id", F.col("value") > 50)


@query(f"""WITH {EV}, {ISLANDS}, z AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a) <= 3 THEN 0 ELSE 1 END AS new FROM runs),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS part FROM z)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n_runs FROM y GROUP BY user_id, part""")
def bridged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.bridged(W.runs(series(spark, sf_dir), "user_id", F.col("value") > 50), "user_id", 3)


@query(f"WITH {EV}, {ISLANDS} SELECT user_id, a, b, n FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, a) = 1")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.longest_run(W.runs(series(spark, sf_dir), "user_id", F.col("value") > 50), "user_id")


@query(f"""WITH {EV}, m AS (SELECT user_id, max(t) AS top FROM ev GROUP BY 1),
b AS (SELECT user_id, top, unnest(range(0, top // 5 + 1)) AS block FROM m)
SELECT b.user_id, block, round(avg(value), 6) AS mean, count(*) AS n FROM b JOIN ev ON ev.user_id = b.user_id AND t >= block * 5 AND t < block * 5 + 10
WHERE block * 5 + 9 <= top GROUP BY 1, 2""")
def hopping_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hopping(series(spark, sf_dir), "user_id", 10, 5, F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM x)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM y GROUP BY user_id, part""")
def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("s"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("s"))


@query(f"""WITH {EV}, x AS (SELECT user_id, t, round(sum(value) OVER w, 6) AS s, count(*) OVER w AS c FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, t AS start, s FROM x WHERE c = 10 AND t % 4 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, t) = 1""")
def window_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_window(series(spark, sf_dir), "user_id", "value", 10, 4)


@query(f"""WITH {EV}, x AS (SELECT user_id, event_type, list_sort(list(sec)) AS ts FROM ev GROUP BY 1, 2), k AS (SELECT *, len(ts) AS n, CAST(greatest(2, floor(0.85 * len(ts))) AS BIGINT) AS k FROM x),
w AS (SELECT user_id, event_type, n, ts, k, unnest(range(1, CASE WHEN n < 4 THEN 2 ELSE n - k + 2 END)) AS i FROM k),
v AS (SELECT user_id, event_type, n, CASE WHEN n < 4 THEN ts[1] ELSE ts[i] END AS s, CASE WHEN n < 4 THEN ts[n] ELSE ts[i + k - 1] END AS e, i FROM w)
SELECT user_id, event_type, n, s AS start, e AS "end" FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY e - s, s) = 1""")
def robust_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waveloom.operators.consensus import robust_span as spans

    return spans(table(spark, sf_dir, "events").withColumn("sec", seconds()), ["user_id", "event_type"], "sec")
