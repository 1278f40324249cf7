"""Per-frame features, landmarks and series of signals: rows (id, rate, x array) in, long tables out.

A signal (an episode of minutes) is one row and one unit of work; rows are spread over the
cluster, one Arrow batch at a time. Only the asked-for columns are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from waveloom.functions import dsp


def _each(df: DataFrame, schema: str, of) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                made = pd.DataFrame(of(np.asarray(row.x, float)))
                made.insert(0, "id", row.id)
                yield made

    return df.select("id", "x").mapInPandas(run, schema)


def features(signals: DataFrame) -> DataFrame:
    def of(x: np.ndarray) -> dict:
        held = dsp.spectral_features(x)
        c = dsp.chroma(x)
        return {"t": np.arange(len(c)), **held, "chroma_self": dsp.self_similarity(c), "chroma": list(c)}

    return _each(signals, "id string, t long, log_rms double, low_ratio double, flatness double, flux double, chroma_self double, chroma array<double>", of)


def landmarks(signals: DataFrame) -> DataFrame:
    def of(x: np.ndarray) -> dict:
        h, t = dsp.landmarks(x)
        return {"hash": h, "t": t}

    return _each(signals, "id string, hash long, t long", of)


def activations(signals: DataFrame) -> DataFrame:
    def of(x: np.ndarray) -> dict:
        centre, value = dsp.activation(x)
        return {"centre": centre, "value": value}

    return _each(signals, "id string, centre double, value double", of)
