"""Recurring passages by landmark hashes and offset consensus against reference documents.

A landmark is a pair of tokens ``dt`` apart; documents that share a passage
share its landmarks at one offset (delta). A landmark counts if it occurs in enough
documents (a minimum, no maximum), with its first ``occur`` places in each. A few reference
documents are chosen (the medoid, the one with most landmarks, some spread over all); every
other document votes for the offsets at which it lines up with a reference. So the work
grows with the documents, not with their pairs, however common a landmark is.

``owner_votes`` does without chosen references: every landmark has one owner, the longest of its documents, and its other documents vote
against that one. So every recurring landmark takes part, and the votes are as many as its places, not as pairs of them.

Hashes are 64-bit numbers. Copies that line up with the reference at one offset alone have one bin, whose mean is its own
votes: the threshold m + 5 sqrt(m) is then above them, as the published rule has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DT, MIN_DF, MAX_OCCUR = 4, 2, 3
TRIALS, SPREAD = 4, 2654435761  # references tried; multiplier of the hash that spreads them
MIN_VOTES, MAX_PEAKS, MERGE = 12, 5, 2
MIN_DENSITY, ABSENT, LONGEST, MIN_SUPPORT = 0.5, 0.25, 400, 3
KINDS = ("title-theme", "end-credits", "other-recurring", "sting")  # in order of priority
BROADCAST_MARKS = 2_000_000  # landmarks of the references sent whole up to here, joined by shuffle above


def tokens(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.filter("text IS NOT NULL").select("doc_id", F.split(F.lower("text"), " ").alias("w"), *carry)


TEXT_BYTES = 1 << 20  # text whose landmarks are made at once


def spread(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def token_pairs(ids: pa.Array, texts: pa.Array, max_dt: int, occur: int) -> pa.RecordBatch:
    """hash, doc_id, t, r, n of the token pairs of some texts: tokens are hashed once each, pairs by arithmetic, places numbered after one sort."""
    tokens = pc.split_pattern(texts, " ")
    at = tokens.offsets.to_numpy().astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    known = pd.util.hash_array(np.asarray(words.dictionary.to_pylist(), object)) if len(words.dictionary) else np.zeros(0, np.uint64)
    h, doc = known[words.indices.to_numpy()], np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(h)) - at[doc] + at[0]
    hashes, docs, places = [], [], []
    for dt in range(1, max_dt + 1):
        i = np.flatnonzero(doc[:-dt] == doc[dt:]) if len(h) > dt else np.zeros(0, int)
        hashes.append(spread(spread(h[i]) + h[i + dt] * np.uint64(2 * dt + 1) + np.uint64(dt)))
        docs.append(doc[i])
        places.append(place[i])
    x, d, t = (np.concatenate(v) for v in (hashes, docs, places))
    order = np.lexsort((t, x, d))
    x, d, t = x[order], d[order], t[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    r = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    keep = r < occur
    return pa.RecordBatch.from_arrays(
        [pa.array(x[keep].view(np.int64)), ids.take(pa.array(d[keep])), pa.array(t[keep]), pa.array(r[keep].astype(np.int32)), pa.array(np.diff(at)[d[keep]])], names=["hash", "doc_id", "t", "r", "n"])


def landmarks(docs: DataFrame, max_dt: int = MAX_DT, occur: int = MAX_OCCUR) -> DataFrame:
    """hash, doc_id, t, r, n of every token pair at most max_dt apart; r = 0, 1, .. numbers the places of a hash within
    its document, of which the first ``occur`` are kept (the published rule; a passage is still found by its other landmarks); n is the
    document's number of tokens. Made in Arrow batches of about 1 MB of text, so nothing is exchanged. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXT_BYTES, side="right")))
                yield token_pairs(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), max_dt, occur)
                lo = hi

    held = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return held.mapInArrow(run, "hash long, doc_id long, t long, r int, n long")


def recurring(marks: DataFrame, low: int = MIN_DF) -> DataFrame:
    """marks and df of the landmarks in at least ``low`` documents. marks is read twice, for the count and for the join, so it should be a stored table."""
    df = marks.filter("r = 0").groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= low)
    return marks.join(df, "hash")


def references(held: DataFrame, most: int = TRIALS, hint: list[int] | None = None) -> list[int]:
    """Ids of the reference documents: the hinted ones, the medoid (most landmarks shared with others, summed over them),
    the one with most landmarks, then some spread over all by a multiplicative hash of the id. Ties to the smaller id."""
    return chosen(held.filter("r = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("df") - 1).alias("shared")), most, hint)


def chosen(sizes: DataFrame, most: int = TRIALS, hint: list[int] | None = None) -> list[int]:
    """The references, of doc_id, n (recurring landmarks) and shared."""
    top = sizes.agg(F.max(F.struct("shared", -F.col("doc_id"))).alias("medoid"), F.max(F.struct("n", -F.col("doc_id"))).alias("largest")).first()
    spread = sizes.orderBy(F.pmod(F.col("doc_id") * SPREAD, F.lit(1 << 32)), "doc_id").limit(most).collect()  # at most `most` rows
    found = [*(hint or []), *(-x[1] for x in (top["medoid"], top["largest"]) if x), *(r["doc_id"] for r in spread)]
    return list(dict.fromkeys(found))[:most]


def votes_of(held: DataFrame, refs: list[int]) -> DataFrame:
    """a (a reference), b, delta = t in a minus t in b, hash, ta: each landmark once a bin, with its first place in a."""
    spark = held.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(x,) for x in refs], "a long"))  # a few ids
    left = held.join(chosen, F.col("doc_id") == F.col("a")).select("a", "hash", F.col("t").alias("ta"))
    left = F.broadcast(left) if left.count() <= BROADCAST_MARKS else left
    right = held.select("hash", F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    return right.join(left, "hash").filter("a <> b").groupBy("a", "b", (F.col("ta") - F.col("tb")).alias("delta"), "hash").agg(F.min("ta").alias("ta"))


def owner_votes(held: DataFrame) -> DataFrame:
    """a, b, delta, hash, ta as ``votes_of`` has them, with a the owner of each landmark: of the documents that hold it the longest, then the
    smaller id. A passage that some documents share has mostly landmarks of these alone, which all fall to the same one of them."""
    own = held.groupBy("hash").agg(F.min(F.struct((-F.col("n")).alias("n"), "doc_id"))["doc_id"].alias("a"))
    both = held.join(own, "hash")
    left = both.filter("doc_id = a").select("hash", F.col("t").alias("ta"))
    right = both.filter("doc_id <> a").select("hash", "a", F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    return right.join(left, "hash").groupBy("a", "b", (F.col("ta") - F.col("tb")).alias("delta"), "hash").agg(F.min("ta").alias("ta"))


def offset_votes(bins: DataFrame) -> DataFrame:
    """a, b, delta, votes: distinct hashes of a bin, and the places in a they come from."""
    return bins.groupBy("a", "b", "delta").agg(F.count(F.lit(1)).alias("votes"), F.min("ta").alias("a_from"), F.max("ta").alias("a_to"))


def with_threshold(votes: DataFrame, least: int = MIN_VOTES, others: bool = False) -> DataFrame:
    """Adds the pair's own threshold: max(least, m + 5 sqrt(m)), m the mean over all bins from the lowest delta to the highest. With
    ``others`` a bin's own votes are left out of its mean, so that copies that line up at one offset alone are over it."""
    if others:
        pair = votes.groupBy("a", "b").agg(F.sum("votes").alias("s"), (F.max("delta") - F.min("delta") + 1).alias("w"))
        held = votes.filter(F.col("votes") >= least).join(pair, ["a", "b"]).withColumn("m", (F.col("s") - F.col("votes")) / F.col("w"))
        return held.withColumn("threshold", F.greatest(F.lit(float(least)), F.col("m") + 5 * F.sqrt("m"))).drop("m", "s", "w")
    pair = votes.groupBy("a", "b").agg((F.sum("votes") / (F.max("delta") - F.min("delta") + 1)).alias("m"))
    return votes.filter(F.col("votes") >= least).join(pair, ["a", "b"]).withColumn("threshold", F.greatest(F.lit(float(least)), F.col("m") + 5 * F.sqrt("m"))).drop("m")


def peaks(votes: DataFrame, least: int = MIN_VOTES, others: bool = False) -> DataFrame:
    return with_threshold(votes, least, others).filter("votes >= threshold")


def probed(votes: DataFrame, known: DataFrame) -> DataFrame:
    """How each known offset (a, b, delta) fares: its votes (0 without any), its rank among all bins of the pair (votes first, then the smaller
    delta; null without votes), the pair's threshold and whether the bin is over it."""
    pair = votes.groupBy("a", "b").agg((F.sum("votes") / (F.max("delta") - F.min("delta") + 1)).alias("m"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("votes"), "delta"))
    bins = votes.select("a", "b", "delta", "votes", place.alias("rank"))
    met = known.join(bins, ["a", "b", "delta"], "left").join(pair, ["a", "b"], "left").withColumn("threshold", F.greatest(F.lit(float(MIN_VOTES)), F.coalesce(F.col("m") + 5 * F.sqrt("m"), F.lit(0.0))))
    return met.select("a", "b", "delta", F.coalesce("votes", F.lit(0).cast("long")).alias("votes"), "rank", "threshold", (F.coalesce("votes", F.lit(0)) >= F.col("threshold")).alias("passes"))


def ablated(marks: DataFrame, spans: DataFrame) -> DataFrame:
    """marks without those whose anchor lies in a span (doc_id, s, e) of their document, to see what is still found when a passage is gone from some."""
    hit = marks.join(spans.select("doc_id", "s", "e"), "doc_id").filter("t >= s AND t < e").select("hash", "doc_id", "t").distinct()
    return marks.join(hit, ["hash", "doc_id", "t"], "left_anti").drop("r").withColumn("r", F.row_number().over(Window.partitionBy("hash", "doc_id").orderBy("t")) - 1)


def top_peaks(found: DataFrame, most: int = MAX_PEAKS) -> DataFrame:
    """The strongest peaks of a pair: votes first, then the smaller delta."""
    order = Window.partitionBy("a", "b").orderBy(F.desc("votes"), "delta")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def suppressed(top: DataFrame, apart: int = 2 * MERGE) -> DataFrame:
    """Of the ranked peaks of a pair those not within ``apart`` of a stronger one that was taken. At most MAX_PEAKS a pair."""
    taken = F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "delta", "votes"))), F.array().cast("array<struct<rank:int,delta:bigint,votes:bigint>>"),
                        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["delta"] - x["delta"]) <= apart), acc).otherwise(F.array_append(acc, x)))
    return top.groupBy("a", "b").agg(taken.alias("p")).select("a", "b", F.explode("p").alias("p")).select("a", "b", "p.delta", "p.votes")


def merged(bins: DataFrame, taken: DataFrame, width: int = MERGE, share: float = 0.85) -> DataFrame:
    """Each taken peak with the bins up to ``width`` beside it: a landmark counts once, at its lowest delta. votes, and the
    passage's extent in a and in b as the densest window of its landmarks, which a few strays don't stretch."""
    near = taken.select("a", "b", F.col("delta").alias("peak"), F.explode(F.sequence(F.col("delta") - width, F.col("delta") + width)).alias("delta"))
    once = bins.join(near, ["a", "b", "delta"]).groupBy("a", "b", "peak", "hash").agg(F.min(F.struct("delta", "ta")).alias("x"))
    places = once.groupBy("a", "b", "peak").agg(F.count(F.lit(1)).alias("votes"), F.array_sort(F.collect_list("x.ta")).alias("ta"), F.array_sort(F.collect_list(F.col("x.ta") - F.col("x.delta"))).alias("tb"))  # as many as the peak has landmarks
    spans = places.select("a", "b", F.col("peak").alias("delta"), "votes", densest(F.col("ta"), share).alias("x"), densest(F.col("tb"), share).alias("y"))
    return spans.select("a", "b", "delta", "votes", F.col("x.start").alias("a_from"), (F.col("x.start") + F.col("x.span")).alias("a_to"), F.col("y.start").alias("b_from"), (F.col("y.start") + F.col("y.span")).alias("b_to"))


def densest(ts: Column, share: float = 0.85) -> Column:
    """Span and start of the narrowest window over sorted times that holds max(2, floor(share * n)) of them."""
    n = F.size(ts)
    k = F.greatest(F.lit(2), F.floor(share * n)).cast("int")
    windows = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct((F.element_at(ts, i + k - 1) - F.element_at(ts, i)).alias("span"), F.element_at(ts, i).alias("start")))
    return F.when(n < 4, F.struct((F.element_at(ts, -1) - F.element_at(ts, 1)).alias("span"), F.element_at(ts, 1).alias("start"))).otherwise(F.array_min(windows))


def robust_span(df: DataFrame, keys: list[str], time: str, share: float = 0.85) -> DataFrame:
    """Densest window that holds max(2, floor(share * n)) of the times; the earliest of equals; all of fewer than four."""
    order = Window.partitionBy(*keys).orderBy(time)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    k = F.when(n < 4, n).otherwise(F.greatest(F.lit(2), F.floor(share * n)))
    each = df.select(*keys, F.col(time).alias("__start"), F.row_number().over(order).alias("__i"), n.alias("__n"), k.alias("__k"))
    last = each.select(*keys, F.col("__start").alias("__end"), (F.col("__i") - F.col("__k") + 1).alias("__i"))
    spans = F.struct((F.col("__end") - F.col("__start")).alias("span"), F.col("__start").alias("start"), F.col("__end").alias("end"))
    windows = each.join(last, [*keys, "__i"]).groupBy(*keys, F.col("__n").alias("n")).agg(F.min(spans).alias("__b"))
    return windows.select(*keys, "n", "__b.start", "__b.end")


def upper_median(x: str) -> Column:
    """Element n >> 1 of the sorted values of a group, from counts of its distinct values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def grouped(found: DataFrame) -> DataFrame:
    """Peaks of a reference by passage: a, asset (0, 1, ..), ref_from, ref_to, ref_votes beside each peak's own columns.

    Peaks in order of votes (then b, delta) join the first passage that overlaps more than half of the shorter, or
    open one. Peaks of one extent go the same way, so the fold is over a reference's distinct extents,
    which its own length bounds. Peaks without extent are left out.
    """
    found = found.filter("a_to > a_from")
    extents = found.groupBy("a", "a_from", "a_to").agg(F.min(F.struct((-F.col("votes")).alias("v"), "b", "delta")).alias("lead"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("lead", "a_from", "a_to"))), lambda z: F.struct(z["a_from"].alias("f"), z["a_to"].alias("t"), (-z["lead"]["v"]).alias("v")))
    meets = lambda x, y: F.least(x["t"], y["t"]) - F.greatest(x["f"], y["f"]) > 0.5 * F.least(x["t"] - x["f"], y["t"] - y["f"])
    fold = F.aggregate(order, F.array().cast("array<struct<f:bigint,t:bigint,v:bigint>>"), lambda held, x: F.when(F.exists(held, lambda y: meets(x, y)), held).otherwise(F.array_append(held, x)))
    passages = extents.groupBy("a").agg(fold.alias("held"))
    first = F.array_position(F.transform("held", lambda y: meets(F.struct(F.col("a_from").alias("f"), F.col("a_to").alias("t")), y)), F.lit(True)).cast("int") - 1
    numbered = extents.select("a", "a_from", "a_to").join(passages, "a").select("a", "a_from", "a_to", first.alias("asset"), F.get("held", first).alias("p"))
    return found.join(numbered, ["a", "a_from", "a_to"]).select(*found.columns, "asset", F.col("p.f").alias("ref_from"), F.col("p.t").alias("ref_to"), F.col("p.v").alias("ref_votes"))


def members(found: DataFrame, density: float = MIN_DENSITY, share: float = ABSENT, longest: int = LONGEST) -> DataFrame:
    """One row per passage and document: its best peak, and the reference itself; present if its votes reach
    max(2, share * upper median) and its extent is at most ``longest``. Passages with scattered votes drop out."""
    passage = ["a", "asset", "ref_from", "ref_to", "ref_votes"]
    best = grouped(found).groupBy(*passage, "b").agg(F.min(F.struct((-F.col("votes")).alias("v"), "delta", "b_from", "b_to")).alias("x"))
    others = best.select(*passage, F.col("b").alias("doc_id"), F.col("x.b_from").alias("start"), F.col("x.b_to").alias("end"), (-F.col("x.v")).alias("votes"), F.lit(False).alias("is_reference"))
    own = best.select(*passage).distinct().select(*passage, F.col("a").alias("doc_id"), F.col("ref_from").alias("start"), F.col("ref_to").alias("end"), F.col("ref_votes").alias("votes"), F.lit(True).alias("is_reference"))
    dense = others.unionByName(own).filter(F.col("ref_votes") / F.greatest(F.col("ref_to") - F.col("ref_from"), F.lit(0.001)) >= density)
    medians = dense.groupBy("a", "asset").agg(upper_median("votes").cast("long").alias("median_votes"))
    cut = F.greatest(F.lit(2.0), share * F.col("median_votes"))
    present = (F.col("is_reference") | (F.col("votes") >= cut)) & (F.col("end") - F.col("start") <= longest)
    return dense.join(medians, ["a", "asset"]).withColumn("present", present)


def kind(start: Column, duration: Column, span: Column) -> Column:
    """A label by place and length: early and short, at the end, very short, or other."""
    return F.when(start > 0.85 * duration, "end-credits").when(span < 4, "sting").when((start < 0.35 * duration) & (span <= 90), "title-theme").otherwise("other-recurring")


def assets(held: DataFrame, lengths: DataFrame, documents: int, most_support: int = MIN_SUPPORT) -> DataFrame:
    """Passages present in at least max(2, min(most_support, ceil(0.6 documents))) documents, with their statistics over those.
    held: rows of members; lengths: doc_id, n."""
    least = max(2, min(most_support, -(-6 * documents // 10)))
    present = held.filter("present").join(lengths, "doc_id").withColumn("span", F.col("end") - F.col("start"))
    stats = present.groupBy("a", "asset", "ref_from", "ref_to", "median_votes").agg(
        F.count(F.lit(1)).alias("support"), upper_median("span").cast("long").alias("span"), F.avg("start").alias("mean_start"), F.avg("votes").alias("mean_votes"), upper_median("n").cast("long").alias("duration"))
    return stats.filter(F.col("support") >= least).withColumn("support_fraction", F.col("support") / documents).withColumn("kind", kind(F.col("mean_start"), F.col("duration"), F.col("span")))


def kind_priority() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))


def best_reference(found: DataFrame, refs: list[int]) -> DataFrame:
    """The passages of the reference whose first one (kinds in order, then support, votes, place) has most support times votes;
    of equals the one tried first."""
    order = Window.partitionBy("a").orderBy(kind_priority(), F.desc("support_fraction"), F.desc("mean_votes"), "mean_start", "asset")
    first = found.withColumn("r", F.row_number().over(order)).filter("r = 1").select("a", (F.col("support_fraction") * F.col("mean_votes")).alias("score"))
    tried = F.array_position(F.array(*[F.lit(x) for x in refs]) if refs else F.array().cast("array<bigint>"), F.col("a"))
    best = first.withColumn("tried", tried).orderBy(F.desc("score"), "tried").limit(1).select("a")
    return found.join(F.broadcast(best), "a")  # one row


def ranked_assets(found: DataFrame, by: str = "support", most: int | None = None) -> DataFrame:
    """rank 1, 2, ..: most common first, or by kind first. Passages of one reference, so they are few."""
    keys = [*([kind_priority()] if by == "kind" else []), F.desc("support_fraction"), F.desc("mean_votes"), "mean_start", "asset"]
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*keys)))
    return out if most is None else out.filter(F.col("rank") <= most)
