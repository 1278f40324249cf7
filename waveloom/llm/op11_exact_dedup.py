"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are the same after lower-casing A-Z alone. The first scan writes two numbers a row, the length in bytes and a hash of the first
PREFIX characters. Rows whose length is shared stay in the race, of those the ones whose (length, prefix hash) is shared, and a second scan takes the
SHA-256 of the whole text for these alone. Which rows are still in the race is told by a filter of fixed size (16 MB); a row that it lets through
by chance has a digest of its own, so results are exact and the filter saves less where there are far over 100,000,000 shared prefixes.

Only numbers and digests are shuffled. Groups are aggregated map-side, and each member meets its group by ``looked_up``: the
commonest digests by broadcast (fewer than 50,000 by their share of the rows), the others by shuffle.

Defined cases: a null text is an empty one, and all empty texts are equal; of equal texts the largest doc_id stays, a row without a doc_id only where no
other is there; of rows that repeat with their doc_id exactly one stays; very long texts are hashed whole in their task; an empty table gives no
row; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import keyed_documents, stored, table
from waveloom.llm.hot import bitmaps, looked_up, perhaps

PREFIX = 64
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; in a text of ASCII alone that is what lower() does, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def exact_groups(docs: DataFrame, prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, n_bytes, digest for every row; digest (SHA-256 of the lowered text, hex) is null for texts that were told
    apart before their whole was read, unless digest_all."""
    texts = keyed_documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    measured = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("head", F.xxhash64(lowered(F.substring("text", 1, prefix))))
    length, start = F.col("n_bytes"), F.xxhash64("n_bytes", "head")

    marks = stored(measured.select("n_bytes", "head"), "marks")
    lengths = stored(bitmaps(marks.groupBy("n_bytes").count().filter("count > 1"), length), "lengths")
    racing = perhaps(marks, length, lengths, "shared").filter("shared").groupBy("n_bytes", "head").count().filter("count > 1")
    starts = stored(bitmaps(racing, start), "starts")

    whole = perhaps(measured, start, starts, "shared")
    digest = F.sha2(lowered(F.col("text")), 256)
    held = stored(
        whole.select("doc_id", "n_bytes", "shared", (digest if digest_all else F.when(F.col("shared"), digest)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()), "digests")

    found = held.filter("shared").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"))
    groups = stored(found.filter("group_size > 1"), "groups")
    members = looked_up(held.filter("shared"), groups, ["digest"], "group_size", held.count())
    alone = held.filter("NOT shared").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast("long"), "keep_row": F.lit(None).cast("long")})
    return members.unionByName(alone).select(
        "doc_id", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "n_bytes", "digest")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g ON g.text_sha256 = d.text_sha256"""
