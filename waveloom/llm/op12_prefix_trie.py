"""The prefix trie of conversations by smallest-member ownership.

Each node of the trie (a distinct sequence of first turns) is owned by its smallest member. A conversation that owns a node owns every deeper node of
its own path, so what it owns is a suffix of its path and one number tells it. A member's path holds, from a node on, the words of its own suffix and
words that others own; the latter are what sharing saves, so one group-by over the prefixes of all paths sums, for each node, occurrence words minus
owned words, owned children and leaf flags.

Prefixes are named by 128 bits: the exclusive or of hashes of (depth, digest of role and text), which windows sum along a path. A
conversation may hold any share of all turns: turns are dealt by ranges of (conv_id, turn), windows run within the part of a
conversation that one range holds, and what lies before comes from one row a part. Nodes that many conversations share, the root among them, are
pre-aggregated map-side; the owner of a parent is met by ``looked_up``. The digests of the conversations that end in a node come from streams: sorted ids are
joined to strings of at most ENDS ids where they lie, and the strings of one node pass one after the other through one SHA-256.

Defined cases: rows without a conv_id make no conversation; null role or text is empty, null turn comes first; turns that tie go by the hashes of role and
text, repeated rows are turns each; ``%`` is the remainder with the sign of the conv_id; long texts are hashed in their task, before any
exchange; an empty table gives no row, not even the root; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveloom.llm.common import stored, table
from waveloom.llm.hot import looked_up

FAMILY, MOST_BORROWED = 20, 3  # conversations c - c % 20 lend their first crc32(c) % 4 turns
ENDS = 4096
NODE = ["depth", "k1", "k2"]
HEAD, ROOT = -1, -2  # parts of a path before those that hold a conversation's own turns
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _earlier_parts():
    return Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def own_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (part, conv_id, i: place within the part, a, b: digest, words) and parts (part, conv_id, before: turns in earlier parts, n_turns)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("row")]
    dealt = stored(narrow, "turns").repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id().cast("long"))
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    turns = stored(dealt.withColumn("i", place.cast("long")).select("part", "conv_id", "i", "a", "b", "words"), "placed")
    counts = turns.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    parts = counts.withColumns({"before": F.coalesce(F.sum("n").over(_earlier_parts()), F.lit(0)), "n_turns": F.sum("n").over(whole)})
    return turns, stored(parts, "parts")


def rebuilt(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations (conv_id, part, depth, a, b, words, length), and a row of depth 0 for each conversation."""
    lent = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("i") < MOST_BORROWED)).join(parts, ["part", "conv_id"]).withColumn("r", F.col("i") + F.col("before")).filter(F.col("r") < MOST_BORROWED)
    heads = lent.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("r", "a", "b", "words"))).alias("lent"))
    shape = (
        parts.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1))
        .withColumn("head", F.coalesce(F.slice("lent", 1, F.col("h").cast("int")), F.slice(F.array(F.struct(*[F.lit(0).cast("long").alias(x) for x in ("r", "a", "b", "words")])), 1, 0)))
        .withColumn("m", F.size("head").cast("long")).withColumn("length", F.col("m") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))))
    shape = stored(shape.select("conv_id", "h", "m", "length", "head"), "shape")
    shifts = parts.join(shape.drop("head"), "conv_id").select("part", "conv_id", "before", "h", "m", "length")
    place = F.col("i") + F.col("before")
    own = turns.join(shifts, ["part", "conv_id"]).filter(place >= F.col("h")).select("conv_id", "part", (place - F.col("h") + F.col("m") + 1).alias("depth"), "a", "b", "words", "length")
    borrowed = shape.select("conv_id", F.lit(HEAD).cast("long").alias("part"), F.posexplode("head").alias("p", "x"), "length").select(
        "conv_id", "part", (F.col("p") + 1).cast("long").alias("depth"), "x.a", "x.b", "x.words", "length")
    zero = F.lit(0).cast("long")
    roots = shape.select("conv_id", F.lit(ROOT).cast("long").alias("part"), zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"), "length")
    return own.unionByName(borrowed).unionByName(roots)


def occurrences(path: DataFrame) -> DataFrame:
    """Every member of every node: conv_id, part, length, depth, k1, k2 (the node), p1, p2 (its parent), before (words of the path before the node), words."""
    z = {f"z{s}": F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(F.lit(s), "depth", "a", "b")).cast("long") for s in (1, 2)}
    path = stored(path.withColumns(z).drop("a", "b"), "path")
    sums = path.groupBy("part", "conv_id").agg(F.expr("bit_xor(z1)").alias("t1"), F.expr("bit_xor(z2)").alias("t2"), F.sum("words").alias("tw"))
    earlier = _earlier_parts()
    carried = sums.select("part", "conv_id", *[F.coalesce(F.expr(f"bit_xor(t{s})").over(earlier), F.lit(0)).alias(f"c{s}") for s in (1, 2)], F.coalesce(F.sum("tw").over(earlier), F.lit(0)).alias("cw"))
    here = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = path.withColumns({"l1": F.expr("bit_xor(z1)").over(here), "l2": F.expr("bit_xor(z2)").over(here), "lw": F.sum("words").over(here)})
    met = local.join(carried, ["part", "conv_id"]).withColumns({f"k{s}": F.col(f"l{s}").bitwiseXOR(F.col(f"c{s}")) for s in (1, 2)})
    return met.select("conv_id", "part", "length", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), (F.col("cw") + F.col("lw") - F.col("words")).alias("before"), "words")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv_id) to strings of at most ENDS ids of one node each."""
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        ids = batch.column(3).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(ids) else np.zeros(0, int)
        cuts = [(c, min(c + ENDS, b)) for a, b in zip(new, [*new[1:], len(ids)]) for c in range(a, b, ENDS)]
        at = np.array([a for a, _ in cuts], int)
        yield pa.RecordBatch.from_arrays([*[pa.array(keys[k, at], pa.int64()) for k in range(3)], pa.array(ids[at], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], pa.string())], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from its strings in order; the open node is carried from batch to batch."""
    at, held = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)]):
            if key == at:
                held.update(b",")
            else:
                if at:
                    out.append((*at, held.hexdigest()))
                at, held = key, hashlib.sha256()
            held.update(ids.encode())
        if out:
            yield _rows(out)
    if at:
        yield _rows([(*at, held.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 3 else pa.string()) for k in range(4)], names=[*NODE, "ends_sha256"])


def ends(found: DataFrame) -> DataFrame:
    """Nodes where conversations end: depth, k1, k2, ends_sha256."""
    last = stored(found.filter("depth = length").select(*NODE, "conv_id"), "ends")
    strings = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined_ids, "depth long, k1 long, k2 long, first long, ids string")
    return stored(strings, "strings").repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends."""
    found = stored(occurrences(rebuilt(*own_turns(conversations))), "occurrences")
    nodes = stored(found.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.max("length").alias("longest"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("before").alias("before")), "nodes")

    # what each conversation owns: its first node, that node's parent, the words before it, and whether its last node is a leaf
    least = {x: F.min_by(x, "depth").alias(x) for x in ("k1", "k2", "p1", "p2", "before")}
    owned = stored(nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("own_from"), F.max((F.col("depth") == F.col("longest")).cast("int")).alias("leaf"), *least.values()), "owned")
    ends_at = found.groupBy("part", "conv_id").agg(F.max(F.col("before") + F.col("words")).alias("reach"))
    per_conv = ends_at.groupBy("conv_id").agg(F.max("reach").alias("all_words")).join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("own_from", F.lit(2**62)).alias("own_from"), F.coalesce("before", "all_words").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    per_part = ends_at.select("part", "conv_id").join(per_conv, "conv_id")

    next_depth = F.col("depth") + 1
    summed = found.join(per_part, ["part", "conv_id"]).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(((next_depth <= F.col("length")) & (next_depth >= F.col("own_from"))).cast("long")).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"))
    summed = stored(summed, "summed")

    # only the first node that a conversation owns has a parent that another one owns
    firsts = stored(owned.filter("own_from > 0").select(F.col("own_from").alias("depth"), "k1", "k2", (F.col("own_from") - 1).alias("parent_depth"), "p1", "p2"), "firsts")
    parents = summed.select(F.col("depth").alias("parent_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    met = looked_up(firsts, parents, ["parent_depth", "p1", "p2"], "n_children", nodes.count()).select(*NODE, "parent_conv_id")
    own_parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return summed.join(met, NODE, "left").join(ends(found), NODE, "left").select(
        "conv_id", "depth", own_parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "n_ends")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("n_ends")


def _crc32_mod_4(digits: str) -> str:
    """The CRC-32 (polynomial EDB88320) of a string of digits, bit by bit, modulo 4."""
    step = "list_reduce(list_prepend(xor({c}, {x}), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)"
    codes = f"list_transform(string_split({digits}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {step.format(c='c', x='x')}), 4294967295::BIGINT) % 4"


SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {FAMILY} AS base, {_crc32_mod_4("conv_id::VARCHAR")} AS h FROM t GROUP BY 1),
head AS (SELECT c.conv_id, t.r, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.r < c.h),
m AS (SELECT c.conv_id, n, h, count(head.r) AS m FROM c LEFT JOIN head ON head.conv_id = c.conv_id GROUP BY ALL),
p AS (SELECT conv_id, r + 1 AS depth, role, text FROM head UNION ALL SELECT t.conv_id, t.r - h + m + 1, role, text FROM t JOIN m ON m.conv_id = t.conv_id AND t.r >= h),
len AS (SELECT conv_id, m + greatest(n - h, 0) AS length FROM m),
o AS (SELECT conv_id, depth, md5(string_agg(md5(role) || md5(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM p
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
k AS (SELECT o.*, lag(node) OVER (PARTITION BY o.conv_id ORDER BY depth) AS parent, length FROM o JOIN len ON len.conv_id = o.conv_id),
v AS (SELECT depth, node, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words, max(length) = depth AS leaf, string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ids FROM k GROUP BY depth, node),
up AS (SELECT a.depth, a.node, sum(CASE WHEN v.leaf THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens FROM v JOIN k a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM v JOIN up ON up.depth = v.depth AND up.node = v.node LEFT JOIN kids ON kids.depth = v.depth AND kids.node = v.node LEFT JOIN v q ON q.depth = v.depth - 1 AND q.node = v.parent"""
