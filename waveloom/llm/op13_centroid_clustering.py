"""k-means over integer vectors with partial-distance search.

A vector's components become integers floor(256 x). Distances to all centroids are accumulated over a few dimensions at a time, those of
highest variance over all vectors first; a centroid is abandoned for a vector as soon as its part of the distance is strictly above the whole distance
of the best one known, and the survivors finish all dimensions. Everything is integer arithmetic, so the order of dimensions changes the work alone.

The integer vectors are written once to the shared folder and read in each round. A task returns one row of counts and sums for each of its centroids and
dimensions at most; the driver gets one row a centroid and dimension (k x 64) and nothing that grows with the data.

Defined cases: a vector without exactly 64 components, or with a null, NaN or infinite one, is left out; a component beyond 2**27 either way (|x| over
524,288) counts as 2**27, as squared distances would not fit a long; ties go to the smaller number; a row without vec_id starts no centroid and is
assigned like any other; an inertia beyond a long is null; rows that repeat a vec_id are vectors each, and their ties at the start go by components; fewer vectors than centroids give
fewer centroids; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import stored, table

DIMENSIONS, SCALE, MOST = 64, 256, 2**27
STEP = 16  # dimensions accumulated before centroids are abandoned
ROWS = 2048  # vectors handled at once


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, q (array of 64 longs) of the vectors that can be used."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = (F.size("x") == DIMENSIONS) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform("x", lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * SCALE, F.lit(2.0**40)), F.lit(-(2.0**40)))).cast("long"), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(fit, F.lit(False))).select("vec_id", held.alias("q"))


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, k rows of 64 at most."""
    first = vectors.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("digest"), "q").orderBy("digest", "q").limit(k)
    return np.array([r["q"] for r in first.collect()], np.int64).reshape(-1, DIMENSIONS)


def spread_order(vectors: DataFrame) -> np.ndarray:
    """Dimensions by falling variance over all vectors."""
    row = vectors.agg(*[F.var_pop(F.col("q")[d]).alias(f"v{d}") for d in range(DIMENSIONS)]).first()
    return np.argsort([-(v or 0.0) for v in row], kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of x, the smaller one of equals, and the squared distance."""
    x, c = x[:, order], centroids[:, order]
    n, k = len(x), len(c)
    part = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(axis=2)
    guess = part.argmin(axis=1)
    best = part[np.arange(n), guess] + ((x[:, step:] - c[guess, step:]) ** 2).sum(axis=1)
    row, to = np.nonzero(part <= best[:, None])
    part = part[row, to]
    for lo in range(step, x.shape[1], step):
        part = part + ((x[row, lo: lo + step] - c[to, lo: lo + step]) ** 2).sum(axis=1)
        alive = part <= best[row]
        row, to, part = row[alive], to[alive], part[alive]
    at = np.lexsort((to, part, row))
    first = np.flatnonzero(np.diff(row[at], prepend=-1))
    return to[at][first], part[at][first]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, DIMENSIONS)


def totals(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> list:
    """One row a centroid and dimension that has vectors: cluster, d, n, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x in _blocks(batches):
            to, _ = nearest(x, centroids, order)
            n += np.bincount(to, minlength=len(centroids))
            np.add.at(total, to, x)
        c, d = np.nonzero((n > 0)[:, None] & np.ones(DIMENSIONS, bool))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(n[c]), pa.array(total[c, d])], names=["cluster", "d", "n", "total"])

    parts = vectors.mapInArrow(run, "cluster int, d int, n long, total long")
    return parts.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()  # k x 64 at most


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            to, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array of longs) of every usable vector."""
    spark = vectors.sparkSession
    held = stored(integers(vectors), "vectors")
    centroids = starts(held, k)
    if not len(centroids):
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
        return spark.createDataFrame([], f"vec_id long, {none}") if held.isEmpty() else held.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in none.split(", "))])
    order = spread_order(held)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in totals(held, centroids, order):
            centroids[r["cluster"], r["d"]] = int(r["total"]) // int(r["n"])
    found = stored(assigned(held, centroids, order), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k at most
    fitting = lambda v: v if v < 2**63 else None
    known = [
        (i, fitting(sums[i]), fitting(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c)
        for i, c in enumerate(centroids.tolist()) if i in sums]
    per = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def _sql(k: int = 40, rounds: int = 5) -> str:
    squared = "list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
    steps = [f"""x AS (SELECT vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, q AS c FROM x WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, min((d, cluster)) AS best FROM (SELECT vec_id, q, cluster, {squared} AS d FROM x, c{r}) GROUP BY vec_id, q)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT best[2] AS cluster, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.best[2]::INTEGER AS cluster, a.best[1] AS distance, (sum(a.best[1]) OVER (PARTITION BY a.best[2]))::BIGINT AS cluster_inertia, (sum(a.best[1]) OVER ())::BIGINT AS inertia,
sha256(array_to_string(list_transform(c, lambda v: v::VARCHAR), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best[2]"""


SQL = _sql()
