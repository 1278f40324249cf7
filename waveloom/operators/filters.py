"""Recursive filters and rate conversion of (key, t, x) series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveloom.plans.shared import stored


def bandpass(rate: float, f0: float, q: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of the usual constant-peak band-pass biquad; q is at least 0.05."""
    w, q = 2 * math.pi * f0 / rate, max(q, 0.05)
    alpha = math.sin(w) / (2 * q)
    return alpha / (1 + alpha), 0.0, -alpha / (1 + alpha), -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)


def lowpass(rate: float, f0: float, q: float) -> tuple[float, float, float, float, float]:
    w, q = 2 * math.pi * f0 / rate, max(q, 0.05)
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return (1 - c) / 2 / (1 + alpha), (1 - c) / (1 + alpha), (1 - c) / 2 / (1 + alpha), -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)


#: Q of the sections of a second- and a fourth-order Butterworth low-pass.
BUTTERWORTH_Q = {2: (0.70710678,), 4: (0.5411961, 1.306563)}


def butterworth(rate: float, f0: float, order: int = 4) -> list[tuple[float, float, float, float, float]]:
    return [lowpass(rate, f0, q) for q in BUTTERWORTH_Q[4 if order >= 4 else 2]]


BLOCK, FAN = 256, 1024  # rows of a block; blocks whose states are carried on in one group


def cascade_step(sections: list[tuple[float, ...]], states: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One sample through the cascade for many series at once: states (series x 4 a section: x1, x2, y1, y2) move on in place."""
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        s = states[:, 4 * i: 4 * i + 4]
        y = b0 * x + b1 * s[:, 0] + b2 * s[:, 1] - a1 * s[:, 2] - a2 * s[:, 3]
        s[:, 1], s[:, 3] = s[:, 0], s[:, 2]
        s[:, 0], s[:, 2] = x, y
        x = y
    return x


def transition(sections: list[tuple[float, ...]]) -> np.ndarray:
    """What one sample of silence does to a state: state' = state @ transition."""
    states = np.eye(4 * len(sections))
    cascade_step(sections, states, np.zeros(len(states)))
    return states


def _blocks_run(sections: list[tuple[float, ...]], xs: list[np.ndarray], states: np.ndarray) -> np.ndarray:
    """Blocks side by side, shorter ones padded: outputs (blocks x longest); states become those at each block's own end."""
    n = np.array([len(x) for x in xs])
    padded = np.zeros((len(xs), n.max(initial=0)))
    for i, x in enumerate(xs):
        padded[i, : n[i]] = x
    out = np.empty_like(padded)
    for j in range(padded.shape[1]):
        live = n > j
        if live.all():
            out[:, j] = cascade_step(sections, states, padded[:, j])
        else:
            part = states[live]
            out[live, j] = cascade_step(sections, part, padded[live, j])
            states[live] = part
    return out


def _carried(sums: DataFrame, key: str, kind: str, step: np.ndarray, fan: int) -> DataFrame:
    """key, block, state: the state at each block's start. sums: key, block, n (rows), c (state at its end from silence). A block
    is an affine map, state -> state @ step**n + c, and so is a run of blocks, so runs of ``fan`` blocks are composed, carried on one level up
    in the same way, and opened again: no group has more than ``fan`` rows, whatever the length of a key."""
    size = len(step)
    powers: dict[int, np.ndarray] = {}

    def passed(pdf: pd.DataFrame, states: np.ndarray) -> list[np.ndarray]:
        """The states before the blocks of each run (a row each), runs side by side, one after the other in flat arrays; ``states`` moves on to the runs' ends."""
        lens = np.array([len(n) for n in pdf["n"]])
        first = np.cumsum(lens) - lens
        ns, cs = np.concatenate(list(pdf["n"])), np.concatenate(list(pdf["c"])).reshape(-1, size)
        before = np.empty_like(cs)
        for j in range(lens.max()):
            live = np.flatnonzero(lens > j)
            at = first[live] + j
            before[at] = states[live]
            for n in np.unique(ns[at]):
                same = ns[at] == n
                if n not in powers:
                    powers[n] = np.linalg.matrix_power(step, int(n))
                states[live[same]] = states[live[same]] @ powers[n] + cs[at[same]]
        return [v.ravel() for v in np.split(before, first[1:])]

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            states = np.array([np.zeros(size) if s is None else s for s in pdf["state"]], float).reshape(len(pdf), size)
            yield pdf.assign(states=passed(pdf, states))[[key, "blocks", "states"]]

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            states = np.zeros((len(pdf), size))
            passed(pdf, states)
            yield pd.DataFrame({key: pdf[key], "block": pdf["run"], "n": [sum(n) for n in pdf["n"]], "c": list(states)})

    rows = F.array_sort(F.collect_list(F.struct("block", "n", "c")))  # at most ``fan``
    each = sums.withColumn("run", F.floor(F.col("block") / fan).cast("long")).groupBy(key, "run").agg(rows.alias("r"))
    part = lambda name: F.transform("r", lambda z: z[name])
    runs = stored(each.select(key, "run", part("block").alias("blocks"), part("n").alias("n"), F.flatten(part("c")).alias("c")), "runs")
    if (runs.agg(F.max("run")).first()[0] or 0) == 0:
        held = runs.withColumn("state", F.lit(None).cast("array<double>"))
    else:
        above = _carried(stored(runs.select(key, "run", "n", "c").mapInPandas(composed, f"{key} {kind}, block long, n long, c array<double>"), "composed"), key, kind, step, fan)
        held = runs.join(above.select(key, F.col("block").alias("run"), "state"), [key, "run"])
    done = held.select(key, "blocks", "n", "c", "state").mapInPandas(opened, f"{key} {kind}, blocks array<long>, states array<double>")
    return done.select(key, F.inline(F.transform("blocks", lambda b, i: F.struct(b.alias("block"), F.slice("states", i * size + 1, size).alias("state")))))


def filter_bank(df: DataFrame, key: str, banks: list[list[tuple[float, float, float, float, float]]], x: str = "x", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """key, band, t, y: each cascade of ``banks`` applied to each key's series in order of t (0, 1, ..), by a blocked scan.

    A recursion has no window form, but the state at a block's end is an affine map of the one at its start. Blocks of ``block`` rows run from silence
    side by side, their end states are carried on by a prefix scan over the blocks, and the blocks run again from their true states. So a key
    of any length is dealt in blocks, and all bands share one pass. A null x counts as 0.
    """
    kind = df.schema[key].dataType.simpleString()
    each = df.select(key, "t", F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"), F.floor(F.col("t") / block).cast("long").alias("block"))
    rows = F.array_sort(F.collect_list(F.struct("t", "x")))  # at most ``block``
    packed = stored(each.groupBy(key, "block").agg(rows.alias("r")).select(key, "block", F.transform("r", lambda z: z["t"]).alias("ts"), F.transform("r", lambda z: z["x"]).alias("xs")), "blocks")
    ends = np.cumsum([0, *(4 * len(sections) for sections in banks)])
    step = np.zeros((ends[-1], ends[-1]))
    for sections, a, b in zip(banks, ends, ends[1:]):
        step[a:b, a:b] = transition(sections)

    def banked(xs: list[np.ndarray], states: np.ndarray) -> list[np.ndarray]:
        return [_blocks_run(sections, xs, states[:, a:b]) for sections, a, b in zip(banks, ends, ends[1:])]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            states = np.zeros((len(pdf), len(step)))
            banked(list(pdf["xs"]), states)
            yield pdf.assign(n=[len(v) for v in pdf["xs"]], c=list(states))[[key, "block", "n", "c"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            outs = banked(list(pdf["xs"]), np.array(pdf["state"].tolist(), float).reshape(len(pdf), len(step)))
            for band, out in enumerate(outs):
                yield pdf.assign(band=band, ys=[out[i, : len(v)] for i, v in enumerate(pdf["xs"])])[[key, "band", "ts", "ys"]]

    sums = stored(packed.mapInPandas(summed, f"{key} {kind}, block long, n long, c array<double>"), "states")
    met = packed.join(_carried(sums, key, kind, step, fan), [key, "block"])
    done = met.mapInPandas(run, f"{key} {kind}, band int, ts array<long>, ys array<double>")
    return done.select(key, "band", F.explode(F.arrays_zip("ts", "ys")).alias("z")).select(key, "band", F.col("z.ts").alias("t"), F.col("z.ys").alias("y"))


def filtered(df: DataFrame, key: str, sections: list[tuple[float, float, float, float, float]], x: str = "x", **dealt) -> DataFrame:
    """key, t, y: the cascade applied to each key's series in order of t."""
    return filter_bank(df, key, [sections], x, **dealt).drop("band")


def resampled(df: DataFrame, key: str, ratio: float, x: str = "x") -> DataFrame:
    """Linear interpolation at positions 0, ratio, 2 ratio, ... below the last sample: key, k, y. An equi-join on floor(position)
    by the rows themselves: each sample serves the positions in [t, t + 1), the next one comes from the same window."""
    nxt = F.lead(x).over(Window.partitionBy(key).orderBy("t"))
    lowest, highest = F.ceil(F.col("t") / ratio), F.ceil((F.col("t") + 1) / ratio) - 1
    held = df.withColumn("nxt", nxt).filter("nxt IS NOT NULL").withColumn("lo", lowest).withColumn("hi", highest).filter("hi >= lo")
    out = held.withColumn("k", F.explode(F.sequence("lo", "hi")))
    at = F.col("k") * ratio - F.col("t")
    return out.select(key, "k", (F.col(x) + at * (F.col("nxt") - F.col(x))).alias("y"))


def filter_block(x: np.ndarray, section: tuple[float, ...], state: np.ndarray) -> np.ndarray:
    """One section over a block, state (x1, x2, y1, y2) carried in place; for the streaming operator."""
    b0, b1, b2, a1, a2 = section
    x1, x2, y1, y2 = state
    out = np.empty(len(x))
    for i, v in enumerate(x):
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out[i] = y
    state[:] = x1, x2, y1, y2
    return out

