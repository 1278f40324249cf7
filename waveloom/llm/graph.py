"""Connected components of a link table, by min-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.llm.common import stored

MOST_ROUNDS = 60
ROWS_PER_FILE = 100_000  # labels are kept in files of about so many rows, so small graphs don't become many tasks


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of links (a, b), all longs.

    Each round every node takes the least label among its neighbours' and its own,
    then that label's own label, so a star settles at once and a chain in
    logarithmic rounds. Rounds are written to the shared folder, never collected.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    files = edges.count() // ROWS_PER_FILE + 1
    start = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = stored(start.coalesce(files), "labels")
    for _ in range(MOST_ROUNDS):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        new = near.unionByName(labels.withColumn("own", F.col("label"))).groupBy("node").agg(F.min("label").alias("new"), F.max("own").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
        moved = stored(new.join(jump, "new", "left").select("node", F.least("new", F.coalesce("beyond", "new")).alias("label"), "old").coalesce(files), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise ValueError(f"components did not settle in {MOST_ROUNDS} rounds")
