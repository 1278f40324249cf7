"""Streaming ingestion: chunks of an episode arrive in any order inside a batch and are resampled with state carried on.

State per episode: next expected chunk, filter memory of each section, last sample,
fractional position, and chunks that came early. A chunk without samples (x null) ends its episode: the last sample is flushed, chunks
that are still missing are named in an error row, and the state is dropped. A chunk of another rate is an error row of its own; the
stream goes on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waveloom.operators.filters import butterworth, filter_block

OUT_RATE, CUTOFF = 8000, 0.45
STATE = "held binary"
OUTPUT = "episode_id string, seq long, first long, y array<double>, error string"


class Resampler:
    """Low-pass (when the rate falls) and linear interpolation at steps of rate / out; the same for any chunking."""

    def __init__(self, rate: float, out: float = OUT_RATE, lowpass: bool = True):
        self.ratio = rate / out
        self.sections = butterworth(rate, CUTOFF * out) if rate > out and lowpass else []
        self.states = [np.zeros(4) for _ in self.sections]
        self.last, self.pos, self.made = None, 0.0, 0

    def process(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if not len(x) or self.ratio == 1:
            self.made += len(x)
            return x
        for section, state in zip(self.sections, self.states):
            x = filter_block(x, section, state)
        if self.last is not None:
            x = np.concatenate([[self.last], x])
        n = max(0, int(np.ceil((len(x) - 1 - self.pos) / self.ratio)))
        at = self.pos + self.ratio * np.arange(n)
        at = at[at < len(x) - 1]
        i = at.astype(int)
        y = x[i] + (at - i) * (x[i + 1] - x[i])
        self.pos = self.pos + self.ratio * len(at) - (len(x) - 1)
        self.last = x[-1]
        self.made += len(y)
        return y

    def flush(self) -> np.ndarray:
        """The last sample, if an output falls on it."""
        out = np.array([self.last]) if self.last is not None and self.ratio != 1 and abs(self.pos) < 1e-9 else np.zeros(0)
        self.made += len(out)
        return out


def resample_chunks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, lowpass: bool = True) -> Iterator[pd.DataFrame]:
    due, early, worker, end = pickle.loads(state.get[0]) if state.exists else (0, {}, None, None)
    for pdf in batches:
        for row in pdf.itertuples():
            if row.x is None:
                end = int(row.seq)
            elif row.seq >= due:
                early[int(row.seq)] = (float(row.sample_rate), np.asarray(row.x, float))
    rows = []

    def take(seq: int) -> None:
        nonlocal worker
        rate, x = early.pop(seq)
        worker = worker or Resampler(rate, lowpass=lowpass)
        if abs(worker.ratio * OUT_RATE - rate) > 1e-9:
            rows.append((key[0], seq, worker.made, None, f"rate {rate:g} instead of {worker.ratio * OUT_RATE:g}"))
        else:
            rows.append((key[0], seq, worker.made, worker.process(x), None))

    while due in early:
        take(due)
        due += 1
    if end is not None:
        missing = [k for k in range(due, end) if k not in early]
        for seq in sorted(early):
            take(seq)
        made = worker.made if worker else 0
        rows.append((key[0], end, made, worker.flush() if worker else np.zeros(0), f"chunks missing: {missing}" if missing else None))
        state.remove()
    else:
        state.update((pickle.dumps((due, early, worker, end)),))
    yield pd.DataFrame(rows, columns=["episode_id", "seq", "first", "y", "error"])


def resampled(chunks: DataFrame, lowpass: bool = True) -> DataFrame:
    """chunks: episode_id, seq, sample_rate, x (mono) as a streaming DataFrame -> the resampled pieces in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return resample_chunks(key, batches, state, lowpass)

    return chunks.groupBy("episode_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
