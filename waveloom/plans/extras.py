"""Relational operations the engine gets from Spark as they are: rollup, cube, outer joins, set operations, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.plans.base import query, table


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND value > 80 GROUP BY 1), b AS (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND value > 80 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, clicks, views FROM a FULL OUTER JOIN b ON a.user_id = b.user_id""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter("value > 80")
    side = lambda kind, name: ev.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return side("click", "clicks").join(side("view", "views"), "user_id", "full_outer")


@query("""SELECT user_id FROM events WHERE event_type = 'click' AND value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'view' AND value > 150""")
def intersect_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter("value > 150")
    return ev.filter("event_type = 'click'").select("user_id").intersect(ev.filter("event_type = 'view'").select("user_id"))


@query("""SELECT user_id FROM events WHERE event_type = 'click' AND value > 50 EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'view' AND value > 50""")
def except_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter("value > 50")
    return ev.filter("event_type = 'click'").select("user_id").exceptAll(ev.filter("event_type = 'view'").select("user_id"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))
