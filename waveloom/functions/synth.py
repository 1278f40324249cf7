"""Seeded sample signals at 8 kHz: a plucked tune, murmured noise with pauses, and episodes that share the tune."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RATE, THEME = 8000, 12.0
STEPS = (0, 3, 5, 7, 10)  # semitones of a minor pentatonic scale


def tune(seconds: float, seed: int = 3) -> np.ndarray:
    """Two plucked voices that wander over a scale: odd harmonics that die away, notes of uneven length."""
    rng, n = np.random.default_rng(seed), int(seconds * RATE)
    x = np.zeros(n)
    for base in (131.0, 262.0):
        at, place = 0, 0
        while at < n:
            m = min(int(RATE * rng.choice([0.31, 0.47, 0.83])), n - at)
            place = int(np.clip(place + rng.integers(-2, 3), -4, 8))
            f = base * 2 ** ((STEPS[place % 5] + 12 * (place // 5)) / 12)
            t = np.arange(m) / RATE
            x[at: at + m] += sum(np.exp(-t * (1.5 + k)) * np.sin(2 * np.pi * f * k * t) / k for k in (1, 3, 5))
            at += m
    return 0.2 * x


def murmur(seconds: float, seed: int) -> np.ndarray:
    """Noise through a wandering resonance, in swelling bursts with pauses between."""
    rng, n = np.random.default_rng(seed), int(seconds * RATE)
    x, at = np.zeros(n), 0
    while at < n:
        m = min(int(RATE * rng.uniform(0.09, 0.34)), n - at)
        spectrum = np.fft.rfft(rng.standard_normal(m))
        f = np.fft.rfftfreq(m, 1 / RATE)
        shape = sum(np.exp(-((f - c) / 110) ** 2) for c in (rng.uniform(250, 900), rng.uniform(1000, 2600)))
        x[at: at + m] = np.fft.irfft(spectrum * shape, m) * np.sin(np.pi * np.arange(m) / m) ** 2
        at += m + int(RATE * rng.uniform(0, 0.12))
    return 0.5 * x


def episodes(spark: SparkSession, n: int = 6) -> DataFrame:
    """id, x, theme_at: murmur, the shared tune, murmur; where the tune starts differs from episode to episode."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theme = tune(THEME)
        for batch in batches:
            for e in batch["id"]:
                before = 18.0 + 5.5 * (e * 3 % 5)
                x = np.concatenate([murmur(before, 10 + 2 * e), theme, murmur(48 - before, 11 + 2 * e)])
                yield pd.DataFrame({"id": [f"e{e}"], "x": [x], "theme_at": [before]})

    return spark.range(n).repartition(n).mapInPandas(make, "id string, x array<double>, theme_at double")
