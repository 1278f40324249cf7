"""Exact bounds of an occurrence: re-lock its offset to the reference by similarity, read its extent off the similarity profile.

Everything is counted in frames. Members that don't hold the passage are marked absent, with no position, instead of being clipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveloom.operators import orders as O
from waveloom.operators import vectors as V
from waveloom.operators import windows as W
from waveloom.plans.shared import stored


@dataclass(frozen=True)
class Rule:
    """How an extent is read; in frames where no similarity."""

    search: int = 94  # offsets tried on each side of the estimate
    pad: int = 78  # profile beyond the passage on each side
    smooth: int = 8
    shrink: float = 0.15  # of the passage left out on each side when the offset is sought
    threshold: float = 0.95
    fall: float = 0.08  # the threshold is lowered by this, twice, until a run is long enough
    least_run: int = 31
    least_sim: float = 0.5
    longest: int = 1406
    least_pairs: int = 8  # from so many refined members the extent is the 10th to 90th percentile of theirs
    boundary: str = "threshold"  # or "gradient": the steepest rise before the profile's peak and the steepest fall after it
    grad_smooth: int = 4
    extent: str = "envelope"  # or "member": each member keeps its own extent


BROADCAST_FRAMES = 20_000  # frames of a passage's core sent whole up to here, joined by shuffle above

def windows(estimates: DataFrame, a: int, b: int, rule: Rule, frames: int) -> DataFrame:
    """id, lo, hi: the frames of each present member that any offset tried can set beside those around the passage."""
    low, high = max(0, a - rule.pad), min(frames, b + rule.pad)
    guess = F.col("at") - a
    return estimates.filter("present").groupBy("id").agg(F.greatest(F.lit(0), F.min(guess) + low - rule.search).cast("long").alias("lo"), F.greatest(F.lit(0), F.max(guess) + high + rule.search).cast("long").alias("hi"))


def relocked(reference: DataFrame, others: DataFrame, estimates: DataFrame, a: int, b: int, v: str, rule: Rule) -> DataFrame:
    """id, d: the offset with the greatest mean similarity over the passage's core (6 decimals, the least of equals), ``search`` around the estimate."""
    cut = int((b - a) * rule.shrink + 0.5)
    core = reference.filter((F.col("t") >= a + cut) & (F.col("t") < b - cut)).select(F.col("t").alias("rt"), F.col(v).alias("va"))
    guess = F.col("at") - a
    near = others.select("id", "t", F.col(v).alias("vb")).join(estimates.filter("present").select("id", "at"), "id")
    near = near.filter((F.col("t") - guess + rule.search >= a + cut) & (F.col("t") - guess - rule.search < b - cut))
    tried = near.withColumn("d", F.explode(F.sequence(guess - rule.search, guess + rule.search))).withColumn("rt", F.col("t") - F.col("d"))
    core = F.broadcast(core) if b - a <= BROADCAST_FRAMES else core  # at most a row a frame of the passage
    sims = tried.join(core, "rt").groupBy("id", "d").agg(F.avg(V.dot("va", "vb")).alias("sim"))
    best = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 6)), "d")
    return sims.withColumn("r", F.row_number().over(best)).filter("r = 1").select("id", "d")


def profiles(reference: DataFrame, others: DataFrame, offsets: DataFrame, a: int, b: int, v: str, rule: Rule, frames: int) -> DataFrame:
    """id, d, t, raw, smooth: similarity to the reference's frames around the passage, 0 where either has none; t counts from ``max(0, a - pad)``."""
    low, high = max(0, a - rule.pad), min(frames, b + rule.pad)
    around = reference.filter((F.col("t") >= low) & (F.col("t") < high)).select(F.col("t").alias("rt"), F.col(v).alias("va"))
    wanted = offsets.withColumn("rt", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")))).join(around, "rt", "left").withColumn("t", F.col("rt") + F.col("d"))
    raw = wanted.join(others.select("id", "t", F.col(v).alias("vb")), ["id", "t"], "left").select("id", "d", (F.col("rt") - low).alias("t"), F.coalesce(V.dot("va", "vb"), F.lit(0.0)).alias("raw"))
    return W.edge_mean(raw, "id", "raw", rule.smooth // 2, "smooth")


def extents(profile: DataFrame, low: int, rule: Rule) -> DataFrame:
    """id, d, t0, t1: the longest run over the threshold, or over the first lower one that gives a run long enough, or the longest of all."""
    levels = [rule.threshold - k * rule.fall for k in range(3)]
    tried = profile.withColumn("level", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("over")) for k, x in enumerate(levels)])))
    keyed = tried.select(F.struct("id", "d", "level.k").alias("key"), "t", (F.round("smooth", 9) > F.col("level.over")).alias("over"))
    found = W.longest_run(W.runs(keyed, "key", F.col("over")), "key").select("key.*", "a", "n")
    enough = F.col("n") >= rule.least_run
    best = Window.partitionBy("id").orderBy(F.desc(enough), F.when(enough, F.col("k")), F.desc("n"), "k")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").select("id", "d", (F.col("a") + low).alias("t0"), (F.col("a") + F.col("n") - 1 + low).alias("t1"))


def steepest(profile: DataFrame, low: int, rule: Rule) -> DataFrame:
    """id, d, t0, t1: from the steepest rise of the smoothed profile at or before its peak to the row after the steepest fall from there on. The
    slope is the step to the next row (0 at the end), smoothed in its turn; the first of equals counts."""
    order = Window.partitionBy("id").orderBy("t")
    slope = profile.withColumn("step", F.coalesce(F.lead("smooth").over(order) - F.col("smooth"), F.lit(0.0)))
    slope = W.edge_mean(slope, "id", "step", rule.grad_smooth // 2, "slope").select("id", "d", "t", F.round("smooth", 9).alias("v"), F.round("slope", 9).alias("g"))
    whole = Window.partitionBy("id")
    peak = slope.withColumn("peak", F.min(F.struct(-F.col("v"), F.col("t").alias("t"))).over(whole)["t"])
    rise = F.min(F.when(F.col("t") <= F.col("peak"), F.struct((-F.col("g")).alias("g"), "t")))
    fall = F.min(F.when(F.col("t") >= F.col("peak"), F.struct("g", "t")))
    return peak.groupBy("id", "d").agg((rise["t"] + low).alias("t0"), (fall["t"] + low + 1).alias("t1"))


BOUNDARIES = {"threshold": extents, "gradient": steepest}


def refined(reference: DataFrame, others: DataFrame | Callable[[DataFrame], DataFrame], estimates: DataFrame, a: int, b: int, frames: int, v: str = "v", rule: Rule = Rule()) -> DataFrame:
    """id, present, start, stop, sim, refined, d, is_reference: one row a member of ``estimates`` (id, at, until, present), and one of the reference (id null).

    An unconfirmed member (no run, or too short a one) keeps its estimate, one under ``least_sim`` or over ``longest`` is absent. A
    passage that no member confirms gives no row. How an extent is read is ``rule.boundary``, one of BOUNDARIES (more can be added:
    a function of profile, low and rule). ``others`` may be a function that gives the frames of a table of windows (id, lo, hi), where the
    whole table is long to make; only those frames are taken, once. Offsets, profiles and the members' own extents are written to the shared folder, each made once.
    """
    low = max(0, a - rule.pad)
    near = windows(estimates, a, b, rule, frames)
    others = others(near) if callable(others) else others.join(near, "id").filter("t >= lo AND t < hi").drop("lo", "hi")
    others = stored(others.select("id", "t", v), "near")
    offsets = stored(relocked(reference, others, estimates, a, b, v, rule), "offsets")
    profile = stored(profiles(reference, others, offsets, a, b, v, rule, frames), "profiles")
    cut = stored(BOUNDARIES[rule.boundary](profile, low, rule), "extents")
    inside = profile.withColumn("t", F.col("t") + low).join(cut, ["id", "d"]).filter("t >= t0 AND t < t1").groupBy("id").agg(F.avg("raw").alias("sim"))
    read = cut.join(inside, "id", "left").withColumn("long_enough", (F.col("t1") > F.col("t0")) & (F.col("t1") - F.col("t0") >= rule.least_run))
    each = estimates.join(read, "id", "left").withColumn("read", F.coalesce("long_enough", F.lit(False)) & F.col("present"))
    each = stored(each.withColumn("sure", F.col("read") & (F.round("sim", 9) >= rule.least_sim)).withColumn("one", F.lit(1)), "members")
    # the members that are sure share one extent if they are enough
    sure = each.filter("sure")
    rank, middle = (lambda q: lambda n: F.floor(q * (n - 1) + 0.5)), (lambda n: F.floor(n / 2))
    shared = sure.groupBy("one").agg(F.count(F.lit(1)).alias("n"))
    for x, wanted in (("t0", {"lo": rank(0.1), "mid0": middle}), ("t1", {"hi": rank(0.9), "mid1": middle}), ("sim", {"mid_sim": middle})):
        shared = shared.join(O.ranks(sure, "one", x, wanted), "one")
    shared = stored(shared, "extent")
    many = (F.col("n") >= rule.least_pairs) & F.lit(rule.extent == "envelope")
    held = each.join(F.broadcast(shared), "one")  # one row
    start = F.when(F.col("sure"), F.when(many, F.col("lo")).otherwise(F.col("t0")) + F.col("d")).when(~F.col("read"), F.col("at"))
    stop = F.when(F.col("sure"), F.when(many, F.col("hi")).otherwise(F.col("t1")) + F.col("d")).when(~F.col("read"), F.col("until"))
    members = held.select("id", (F.col("present") & (F.col("sure") | ~F.col("read"))).alias("present"), start.alias("start"), stop.alias("stop"), F.when(F.col("read"), F.col("sim")).otherwise(0.0).alias("sim"), F.col("sure").alias("refined"), F.when(F.col("sure"), F.col("d")).alias("d"), F.lit(False).alias("is_reference"))
    own = shared.select(F.lit(None).cast(estimates.schema["id"].dataType).alias("id"), F.lit(True).alias("present"), F.when(many, F.col("lo")).otherwise(F.col("mid0")).alias("start"), F.when(many, F.col("hi")).otherwise(F.col("mid1")).alias("stop"), F.col("mid_sim").alias("sim"), F.lit(True).alias("refined"), F.lit(None).cast("long").alias("d"), F.lit(True).alias("is_reference"))
    both = members.unionByName(own).withColumn("present", F.col("present") & (F.col("stop") - F.col("start") <= rule.longest))
    gone = lambda x: F.when(F.col("present"), F.col(x)).alias(x)
    return both.select("id", "present", gone("start"), gone("stop"), "sim", "refined", "d", "is_reference")
