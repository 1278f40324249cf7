"""Streaming ingestion with timers: chunks of episodes arrive late and out of order, state per episode stays bounded, episodes close.

State of an episode: a map of chunks that came early (one entry a chunk, read and written one at a time), and one row of numbers (next chunk, chunks
waiting, place of the end, newest event time, resampler memory). Chunks that come early and are due within the same batch never enter the state. An episode closes when its end mark and all chunks before it are there, or when the
watermark passes its last chunk by ``patience``: what is there then comes out in order, and an error row names what is missing. A closed
episode keeps only a mark, for ``keep``; chunks that come after the close, twice, or behind one that was given up are error rows. At most
``most_early`` chunks wait: beyond that the first gap is given up with an error row, so no state grows without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waveloom.streaming.ingest import OUT_RATE, Resampler

OUTPUT = "episode_id string, seq long, first long, y array<double>, error string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, CLOSED = 0, 1
PATIENCE_MS, KEEP_MS, MOST_EARLY = 60_000, 3_600_000, 64


def packed(worker: Resampler | None) -> list[float]:
    """A resampler's memory as numbers; none yet is an empty list."""
    if worker is None:
        return []
    return [worker.ratio, worker.pos, float(worker.made), np.nan if worker.last is None else float(worker.last), *np.concatenate([np.zeros(0), *worker.states])]


def unpacked(memory: list[float], lowpass: bool) -> Resampler | None:
    if not memory:
        return None
    worker = Resampler(memory[0] * OUT_RATE, lowpass=lowpass)
    worker.ratio, worker.pos, worker.made, worker.last = memory[0], memory[1], int(memory[2]), None if np.isnan(memory[3]) else memory[3]
    worker.states = [np.array(memory[4 + 4 * i: 8 + 4 * i]) for i in range(len(worker.states))]
    return worker


class Episodes(StatefulProcessor):
    """Rows seq, sample_rate, x (null: the end mark) of an episode; see the module."""

    def __init__(self, lowpass: bool = True, patience_ms: int = PATIENCE_MS, keep_ms: int = KEEP_MS, most_early: int = MOST_EARLY):
        self.lowpass, self.patience, self.keep, self.most_early = lowpass, patience_ms, keep_ms, most_early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "seq long", "sample_rate double, x array<double>")
        self.head = handle.getValueState("head", "status int, due long, waiting long, end_seq long, newest long, memory array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load(key)
        for pdf in rows:
            self.newest = max(self.newest, int(pdf["at_ms"].max()))
            for seq, rate, x in zip(pdf["seq"], pdf["sample_rate"], pdf["x"]):
                self._arrive(int(seq), float(rate) if rate is not None else np.nan, x)
        if self.status == OPEN:
            self._drain()
        if self.status == OPEN:
            while self.waiting > self.most_early:
                self._skip("given up")
        if self.status == OPEN and self.end_seq is not None and self.due >= self.end_seq:
            self._close()
        self._save()
        yield self._out()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key)
        if self.status == CLOSED:
            self.head.clear()
        else:
            while self.waiting:
                self._skip("missing at the end")
            if self.end_seq is not None and self.due < self.end_seq:
                self._error(self.due, f"chunks missing at the end: {self.due} to {self.end_seq - 1}")
            self._close()
            self._save()
        yield self._out()

    # -------------------------------------------------------------- parts

    def _load(self, key: tuple) -> None:
        self.key, self.made_rows = key[0], []
        held = self.head.get()
        self.status, self.due, self.waiting, self.end_seq, self.newest, memory = held if held is not None else (OPEN, 0, 0, None, 0, [])
        self.timer = self._timer() if held is not None else None
        self.fresh, self.stored = {}, self.waiting  # early chunks of this batch, and how many the state holds
        self.worker = unpacked(list(memory), self.lowpass)

    def _save(self) -> None:
        """Keeps the state, and the one timer: ``patience`` after the newest chunk, and ``keep`` more once closed."""
        self.head.update((self.status, self.due, self.waiting, self.end_seq, self.newest, packed(self.worker)))
        for seq, (rate, x) in self.fresh.items():
            self.early.updateValue((seq,), (rate, [float(v) for v in x]))
        if self.timer != self._timer():
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(self._timer())

    def _timer(self) -> int:
        return self.newest + self.patience + (self.keep if self.status == CLOSED else 0)

    def _waits(self, seq: int) -> bool:
        return seq in self.fresh or self.stored > 0 and self.early.containsKey((seq,))

    def _out(self) -> pd.DataFrame:
        return pd.DataFrame(self.made_rows, columns=["episode_id", "seq", "first", "y", "error"])

    def _error(self, seq: int, why: str) -> None:
        self.made_rows.append((self.key, seq, self.worker.made if self.worker else 0, None, why))

    def _arrive(self, seq: int, rate: float, x) -> None:
        if self.status == CLOSED:
            self._error(seq, "after the end")
        elif x is None:
            self.end_seq = seq
        elif seq < self.due:
            self._error(seq, "late or twice")
        elif self._waits(seq):
            self._error(seq, "twice")
        elif seq == self.due:
            self._take(seq, rate, x)
        else:
            self.fresh[seq] = rate, x
            self.waiting += 1

    def _take(self, seq: int, rate: float, x) -> None:
        self.worker = self.worker or Resampler(rate, lowpass=self.lowpass)
        if not abs(self.worker.ratio * OUT_RATE - rate) <= 1e-9:
            self._error(seq, f"rate {rate:g} instead of {self.worker.ratio * OUT_RATE:g}")
        else:
            first = self.worker.made
            self.made_rows.append((self.key, seq, first, self.worker.process(np.asarray(x, float)), None))
        self.due = seq + 1

    def _drain(self) -> None:
        while self.waiting and self._waits(self.due):
            seq = self.due
            if seq in self.fresh:
                rate, x = self.fresh.pop(seq)
            else:
                rate, x = self.early.getValue((seq,))
                self.early.removeKey((seq,))
                self.stored -= 1
            self.waiting -= 1
            self._take(seq, rate, x)

    def _skip(self, why: str) -> None:
        """Gives up the gap before the first chunk that waits, and goes on from there."""
        first = min([*self.fresh, *(int(k[0]) for k in (self.early.keys() if self.stored else ()))])
        if first > self.due:
            self._error(self.due, f"chunks {why}: {self.due} to {first - 1}")
        self.due = first
        self._drain()

    def _close(self) -> None:
        made = self.worker.made if self.worker else 0
        self.made_rows.append((self.key, self.due, made, self.worker.flush() if self.worker else np.zeros(0), None))
        if self.stored:
            self.early.clear()
        self.fresh, self.stored = {}, 0
        self.status, self.waiting, self.worker = CLOSED, 0, None


def ingested(chunks: DataFrame, time: str = "at", delay: str = "0 seconds", **options) -> DataFrame:
    """chunks: a streaming table of episode_id, seq, sample_rate, x and an event time -> the resampled pieces and the errors as rows.
    ``delay``: how far behind the newest event time the watermark stays; Spark leaves out rows behind it. The session needs the RocksDB state store (``with_state_store``)."""
    held = chunks.withWatermark(time, delay).select("episode_id", "seq", "sample_rate", "x", time, F.unix_millis(time).alias("at_ms"))
    return held.groupBy("episode_id").transformWithStateInPandas(Episodes(**options), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark
