"""Vector queries over embeddings, in series by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators import vectors as V
from waveloom.operators.windows import ranked
from waveloom.plans.base import query, table

EM = "em AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query(f"""WITH {EM}, x AS (SELECT label, t, v, lead(v) OVER (PARTITION BY label ORDER BY t) AS w FROM em) SELECT label, t, round(list_dot_product(v, w), 4) AS sim FROM x WHERE w IS NOT NULL""")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("embedding").over(Window.partitionBy("label").orderBy("t"))
    return held(spark, sf_dir).withColumn("w", nxt).filter("w IS NOT NULL").select("label", "t", F.round(V.dot("embedding", "w"), 4).alias("sim"))


@query(f"""WITH {EM}, x AS (SELECT vec_id, v, lead(v, 8) OVER w AS a, lead(v, 16) OVER w AS b, lead(v, 31) OVER w AS c FROM em WINDOW w AS (PARTITION BY label ORDER BY t))
SELECT vec_id, round(greatest(0.0, coalesce(list_dot_product(v, a), 0.0), coalesce(list_dot_product(v, b), 0.0), coalesce(list_dot_product(v, c), 0.0)), 4) AS self_sim FROM x""")
def vector_self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.self_similarity(held(spark, sf_dir), "label", "embedding", [8, 16, 31]).select("vec_id", F.round("self_sim", 4).alias("self_sim"))


@query(f"""WITH {EM}, p AS (SELECT a.label AS pair, d, avg(list_dot_product(a.v, b.v)) AS sim FROM em a CROSS JOIN (SELECT unnest(range(-5, 6)) AS d) JOIN em b ON b.label = a.label + 1 AND b.t = a.t + d
GROUP BY 1, 2) SELECT pair, CAST(d AS INT) AS d, round(sim, 5) AS sim FROM p QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(sim, 6) DESC, d) = 1""")
def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = held(spark, sf_dir)
    a = em.select(F.col("label").alias("pair"), "t", "embedding")
    b = em.select((F.col("label") - 1).alias("pair"), "t", "embedding")
    return V.best_offset(V.offset_similarity(a, b, "embedding", 5)).select("pair", "d", F.round("sim", 5).alias("sim"))


@query(f"""WITH {EM}, u AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM em), m AS (SELECT label, i, avg(x) AS mean FROM u GROUP BY 1, 2),
l AS (SELECT label, vec_id, sqrt(list_dot_product(v, v)) AS len FROM em), g AS (SELECT label, list_sort(list(len))[count(*) // 2 + 1] AS median FROM l GROUP BY 1),
c AS (SELECT vec_id, label, i, x - mean AS y FROM u JOIN m USING (label, i)), s AS (SELECT vec_id, label, sqrt(sum(y * y)) AS size, min(y) FILTER (i = 1) AS y1, min(y) FILTER (i = 64) AS y64 FROM c GROUP BY 1, 2)
SELECT vec_id, round(CASE WHEN len < 0.02 * median THEN 0 ELSE y1 / size END, 5) AS first, round(CASE WHEN len < 0.02 * median THEN 0 ELSE y64 / size END, 5) AS last FROM s JOIN l USING (vec_id, label) JOIN g USING (label)""")
def center_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.centred(held(spark, sf_dir), "label", "embedding", 0.02)
    return out.select("vec_id", F.round(F.element_at("c", 1), 5).alias("first"), F.round(F.element_at("c", -1), 5).alias("last"))
