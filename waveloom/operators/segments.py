"""Music inside an episode: calibrate on exemplar ranges, score frames, smooth, cut runs, gate, merge detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.operators import detect as D
from waveloom.operators import intervals as I
from waveloom.operators import speech as P
from waveloom.operators import windows as W
from waveloom.plans.shared import stored

FEATURES = ["log_rms", "low_ratio", "flatness", "flux", "chroma_self"]
FPS = 15.625
ROOM = 64  # frames of a bucket when frames meet ranges
SMOOTH, MIN_SECONDS, MAX_GAP, EDGE, PEAK, CEILING = 3, 4.0, 0.8, 0.10, 0.7, 0.25


def segments(scores: DataFrame, threshold: Column | float, floor: Column | float, seconds: DataFrame, fps: float = FPS, ceiling: float = CEILING) -> DataFrame:
    """id, s, e (seconds), peak, mean_score of runs over the threshold.

    scores: id, t, score. Median and mean of seven frames, runs above the threshold, gaps up to MAX_GAP
    bridged, runs of MIN_SECONDS and a peak over the floor kept, edges grown while the score stays above
    threshold - EDGE * (peak - threshold) and within the midpoints to the neighbouring runs, then at most
    ``ceiling`` of the episode.
    """
    smooth = W.edge_mean(W.edge_median(scores, "id", "score", SMOOTH, "med"), "id", "med", SMOOTH, "v").withColumn("thr", F.lit(threshold) if not isinstance(threshold, Column) else threshold)
    smooth = stored(smooth, "smooth")
    found = W.bridged(W.runs(smooth, "id", F.col("v") > F.col("thr")), "id", int(MAX_GAP * fps)).join(smooth.groupBy("id").agg(F.max("t").alias("top")), "id")
    order = Window.partitionBy("id").orderBy("a")
    found = found.withColumn("s", F.coalesce(F.floor((F.lag("b").over(order) + F.col("a")) / 2) + 1, F.lit(0))).withColumn("e", F.coalesce(F.floor((F.col("b") + F.lead("a").over(order)) / 2), F.col("top")) + 1)
    found = stored(found, "runs")
    # frames of a run and of the room around it: the rooms of an episode don't overlap, so each frame meets one
    near = I.rows_in(smooth.select("id", "t", "v", "thr"), found, "id", F.col("t"), ROOM).join(found.select("id", F.col("s").alias("o_s"), "a", "b"), ["id", "o_s"])
    run = Window.partitionBy("id", "a")
    inside = F.col("t").between(F.col("a"), F.col("b"))
    near = near.withColumn("peak", F.max(F.when(inside, F.col("v"))).over(run)).withColumn("edge", F.col("thr") - EDGE * (F.col("peak") - F.col("thr")))
    low = F.max(F.when((F.col("t") < F.col("a")) & (F.col("v") <= F.col("edge")), F.col("t"))).over(run)
    high = F.min(F.when((F.col("t") > F.col("b")) & (F.col("v") <= F.col("edge")), F.col("t"))).over(run)
    near = near.withColumn("from", F.coalesce(low + 1, F.min("t").over(run))).withColumn("to", F.coalesce(high - 1, F.max("t").over(run)))
    cut = near.filter(F.col("t").between(F.col("from"), F.col("to"))).groupBy("id", "a", "b").agg(F.min("t").alias("from"), F.max("t").alias("to"), F.first("peak").alias("peak"), F.avg("v").alias("mean_score"))
    floor_ = floor if isinstance(floor, Column) else F.lit(floor)
    kept = cut.filter(((F.col("b") - F.col("a") + 1) / fps >= MIN_SECONDS)).join(seconds, "id").filter(F.col("peak") >= floor_)
    out = kept.select("id", (F.col("from") / fps).alias("s"), ((F.col("to") + 1) / fps).alias("e"), "peak", "mean_score", "duration")
    most = ceiling * (F.col("duration") * fps) / fps  # of a whole number of frames, as s and e are: a run of just the ceiling isn't left to the rounding of a part of the seconds
    return out.filter(F.col("e") - F.col("s") <= most).drop("duration")


def marked(frames: DataFrame, exemplars: DataFrame, fps: float = FPS) -> DataFrame:
    """Adds positive: whether a frame is in one of its episode's exemplars (id, s, e), however many there are. One row a frame."""
    edge = lambda x: F.floor(F.col(x) * fps + 0.5)
    ranges = exemplars.groupBy("id").agg(F.collect_list(F.struct(edge("s").alias("a"), edge("e").alias("b"))).alias("__ranges"))  # a few an episode
    inside = F.exists("__ranges", lambda r: (F.col("t") >= r["a"]) & (F.col("t") < r["b"]))
    return frames.join(ranges, "id").withColumn("positive", inside).drop("__ranges")


def gated(found: DataFrame, frames: DataFrame, exemplars: DataFrame, level: str, slack: float, fps: float = FPS) -> DataFrame:
    """Segments whose mean level is at most ``slack`` below the mean of the exemplars' levels; all of them for slack 0."""
    if not slack:
        return found

    def levels(spans: DataFrame) -> DataFrame:
        of = spans.select("id", F.floor(F.col("s") * fps + 0.5).alias("s"), F.floor(F.col("e") * fps + 0.5).alias("e")).distinct()
        return I.rows_in(frames.select("id", "t", level), of, "id", F.col("t"), ROOM).groupBy("id", "o_s", "o_e").agg(F.avg(level).alias("level"))

    kept = D.level_gate(levels(found), levels(exemplars), "id", slack).select("id", F.col("o_s").alias("__s"), F.col("o_e").alias("__e"))
    here = found.withColumn("__s", F.floor(F.col("s") * fps + 0.5)).withColumn("__e", F.floor(F.col("e") * fps + 0.5))
    return here.join(kept, ["id", "__s", "__e"], "left_semi").drop("__s", "__e")


def music(frames: DataFrame, exemplars: DataFrame, seconds: DataFrame, features: list[str] = FEATURES, strictness: float = 0.0, slack: float = 0.0, fps: float = FPS, ceiling: float = CEILING) -> DataFrame:
    """Segments like the exemplars. frames: id, t, features (the first is the level); exemplars: id, s, e; seconds: id, duration.
    strictness 0 to 1 raises the floor of a segment's peak from PEAK of the exemplars' mean score to all of it."""
    held = stored(marked(frames, exemplars, fps), "marked")
    scored = stored(D.scored(held, D.fisher(held, "id", F.col("positive"), features), "id", features).select("id", "t", "positive", "score"), "scores")
    level = scored.filter("positive").groupBy("id").agg(((PEAK + (1 - PEAK) * strictness) * F.avg("score")).alias("floor"))
    found = segments(scored.select("id", "t", "score"), 0.0, F.col("floor"), seconds.join(level, "id"), fps, ceiling)
    return gated(found, frames, exemplars, features[0], slack, fps)


def by_series(frames: DataFrame, exemplars: DataFrame, seconds: DataFrame, x: str, direction: int = 1, fps: float = FPS, ceiling: float = CEILING) -> DataFrame:
    """Segments by one series and the midpoint of its class means; direction -1 where music is the low side."""
    held = stored(marked(frames, exemplars, fps).select("id", "t", "positive", (direction * F.col(x)).alias("score")), "marked")
    middle = D.midpoints(held, "id", F.col("positive"), "score")
    floor = held.filter("positive").groupBy("id").agg(F.avg("score").alias("mean")).join(middle, "id").select("id", (F.col("threshold") + PEAK * (F.col("mean") - F.col("threshold"))).alias("floor"))
    scores = held.join(middle, "id").select("id", "t", (F.col("score") - F.col("threshold")).alias("score"))
    lifted = floor.join(middle, "id").select("id", (F.col("floor") - F.col("threshold")).alias("floor"))
    return segments(scores, 0.0, F.col("floor"), seconds.join(lifted, "id"), fps, ceiling)


def ranges_for(frames: DataFrame, exemplars: DataFrame, seconds: DataFrame, exclude: DataFrame | None = None, **options) -> DataFrame:
    """id, s, e, peak, mean_score, separation, error: the segments of every episode with exemplars, without those that overlap ``exclude``
    (id, s, e). An episode that can't be calibrated has one row that says why, and costs the others nothing."""
    features, fps = options.get("features", FEATURES), options.get("fps", FPS)
    held = stored(marked(frames, exemplars, fps), "marked")
    separation = D.fisher(held, "id", F.col("positive"), features).select("id", "separation")
    found = music(frames, exemplars, seconds, **options)
    if exclude is not None:
        found = I.overlapping(found, exclude, "id", 60, keep=False)
    errors = D.calibration_errors(held, "id", F.col("positive"))
    good = separation.join(found, "id", "left").select("id", "s", "e", "peak", "mean_score", "separation", F.lit(None).cast("string").alias("error"))
    bad = errors.select("id", *[F.lit(None).cast("double").alias(c) for c in ("s", "e", "peak", "mean_score", "separation")], "error")
    return good.unionByName(bad)


SLACK, DIALOG = 8.0, 0.3


def full_ranges(
    frames: DataFrame, exemplars: DataFrame, seconds: DataFrame, extras: list[tuple[str, int]], exclude: DataFrame | None = None, dialog: dict[str, tuple[float, float]] | None = None,
    dialog_threshold: float = DIALOG, slack: float = SLACK, **options,
) -> DataFrame:
    """id, s, e, peak, mean_score, detector, dialog_score, has_dialog, separation, extra_error, error: everything proposed for each episode.

    The exemplars' detector comes first; each extra (a series and the side of it that is music) adds its segments where nothing is kept yet. What overlaps
    ``exclude`` (id, s, e) is left out. ``dialog`` names series of the frames with their mean and deviation: segments are marked, not dropped.
    An episode that can't be calibrated has one row with the error. An extra that can't be (no value inside or outside the exemplars) is named in
    extra_error and costs the episode nothing else; an episode without any segment keeps a row.
    """
    features, fps, ceiling = options.get("features", FEATURES), options.get("fps", FPS), options.get("ceiling", CEILING)
    held = stored(marked(frames, exemplars, fps), "marked")
    separation = stored(D.fisher(held, "id", F.col("positive"), features).select("id", "separation"), "separation")
    able = frames.join(separation.select("id"), "id", "left_semi")
    named = lambda df, name: df.select("id", "s", "e", "peak", "mean_score", F.lit(name).alias("detector"))
    groups = [stored(named(music(frames, exemplars, seconds, slack=slack, **options), "exemplar"), "segments")]
    groups += [stored(named(gated(by_series(able, exemplars, seconds, x, side, fps, ceiling), frames, exemplars, features[0], slack, fps), x), "segments") for x, side in extras]
    kept = I.union_without_overlap(groups, "id", ROOM)
    if exclude is not None:
        kept = I.overlapping(kept, exclude, "id", ROOM, keep=False)
    kept = stored(kept, "kept")
    if dialog:
        flags = P.dialog_scores(frames.select("id", "t", *dialog), kept.select("id", "s", "e"), "id", fps, dialog, threshold=dialog_threshold).withColumnRenamed("score", "dialog_score")
        kept = kept.join(flags, ["id", "s", "e"])
    else:
        kept = kept.withColumns({"dialog_score": F.lit(None).cast("double"), "has_dialog": F.lit(None).cast("boolean")})
    # an extra needs values on both sides
    sides = [F.when((F.count(F.when(F.col("positive"), F.col(x))) == 0) | (F.count(F.when(~F.col("positive"), F.col(x))) == 0), f"{x} has no values inside or outside the exemplars") for x, _ in extras]
    problems = held.groupBy("id").agg(F.concat_ws("; ", *sides).alias("p")).select("id", F.when(F.col("p") != "", F.col("p")).alias("extra_error"))
    errors = D.calibration_errors(held, "id", F.col("positive"))
    good = separation.join(problems, "id").join(kept, "id", "left").withColumn("error", F.lit(None).cast("string"))
    columns = ["id", "s", "e", "peak", "mean_score", "detector", "dialog_score", "has_dialog", "separation", "extra_error", "error"]
    return good.select(columns).unionByName(errors, allowMissingColumns=True).select(columns)


def foreground(frames: DataFrame, level: str, modulation: str, fps: float = FPS, seconds: float = 10.0, weight: float = 30.0) -> DataFrame:
    """id, s, e: the stretch of each episode that is loudest and least modulated at once, as its exemplar: at most half the episode, starts half a
    second apart; episodes that leave under four seconds have none."""
    scored = frames.select("id", "t", (F.col(level) - weight * F.col(modulation)).alias("x"))
    n = lambda sec: int(sec * fps + 0.5)
    found = W.best_stretch(scored, "id", "x", n(seconds), n(4.0), max(1, n(0.5)))
    return found.select("id", (F.col("start") / fps).alias("s"), ((F.col("start") + F.col("n")) / fps).alias("e"))
