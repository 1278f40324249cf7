"""Token counts by a map-side two-tier lookup.

A pre-token is a run of spaces with the text up to the next run; no piece of
the model spans the start of such a run, so a text's token count is the sum
over its pre-tokens. Tier one is a compact sorted table (64-bit hash, length)
of frequent pre-tokens, at most ``FREQUENT`` entries, broadcast. Tier two: each
Python worker encodes what it misses once and keeps the lengths, up to
``CACHE`` entries. No pre-token is ever shuffled; the job has no exchange.

Only the choice of the frequent entries looks at a bounded sample (``SAMPLE_ROWS``
rows, ``SAMPLE_CHARS`` characters each); it changes speed, never a count.

Defined cases: null text and empty text have 0 bytes and 0 tokens; repeated
rows are counted each; a very long text is a batch of its own and counted whole; an empty table gives no row; a null doc_id stays null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import CHUNK_BYTES, chunks, driver_file, keyed_documents, prefix_sums, slice_hash, table, text_buffer

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
FREQUENT = 1 << 15
CACHE = 1 << 20
SAMPLE_ROWS, SAMPLE_CHARS = 2048, 20_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_worker: dict = {}


def _processor(path: str):
    if _worker.get("path") != path:
        import sentencepiece

        _worker.clear()
        _worker.update(path=path, model=sentencepiece.SentencePieceProcessor(model_file=path), keys=np.zeros(0, np.uint64), sizes=np.zeros(0, np.int32))
    return _worker["model"]


def pretokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token, and whether it begins a text. A run of spaces
    right after a literal U+2581 (which the model can't tell from a space) opens none."""
    n = len(raw)
    space = raw == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    if n > 3:
        mark = (raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81)
        start[3:] &= ~mark
    heads = at[:-1][at[1:] > at[:-1]]
    start[heads] = True
    lo = np.flatnonzero(start)
    hi = np.append(lo[1:], n)
    head = np.zeros(n + 1, dtype=bool)
    head[heads] = True
    return lo, hi, head[lo]


def _sizes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, head: np.ndarray, path: str) -> np.ndarray:
    """Lengths by the model itself; every encoded string gets one space in front, so one is taken off first."""
    lo = np.where(head, lo, lo + 1)
    data = raw.tobytes()
    found = _processor(path).encode([data[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist())], num_threads=1)
    sizes = np.fromiter(map(len, found), np.int32, len(found))
    sizes[lo == hi] = 1  # a last single space
    return sizes


def _keys(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, head: np.ndarray) -> np.ndarray:
    return slice_hash(prefix_sums(raw), lo, hi) ^ head.astype(np.uint64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def count_chunk(raw: np.ndarray, at: np.ndarray, keys: np.ndarray, sizes: np.ndarray, path: str) -> np.ndarray:
    lo, hi, head = pretokens(raw, at)
    wanted = _keys(raw, lo, hi, head)
    where, hit = _find(keys, wanted)
    out = np.where(hit, sizes[where] if len(sizes) else 0, 0).astype(np.int64)
    miss = np.flatnonzero(~hit)
    if len(miss):
        _processor(path)
        new, first, back = np.unique(wanted[miss], return_index=True, return_inverse=True)
        where, hit = _find(_worker["keys"], new)
        got = np.zeros(len(new), np.int32)
        got[hit] = _worker["sizes"][where[hit]]
        todo = miss[first[~hit]]
        if len(todo):
            got[~hit] = _sizes(raw, lo[todo], hi[todo], head[todo], path)
            kept = len(_worker["keys"]) + len(todo) <= CACHE
            merged = np.concatenate([_worker["keys"], new[~hit]]) if kept else new
            values = np.concatenate([_worker["sizes"], got[~hit]]) if kept else got
            order = np.argsort(merged)
            _worker.update(keys=merged[order], sizes=values[order])
        out[miss] = got[back]
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=total[1:])
    edges = np.searchsorted(lo, at)
    return total[edges[1:]] - total[edges[:-1]]


def frequent(docs: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    sample = docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).take(SAMPLE_ROWS)  # reads as many partitions as it needs
    raw, at = text_buffer(pa.array([r["text"] for r in sample], pa.large_string()))
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys, sizes = [], []
    for a in range(0, len(at) - 1, 256):
        b = min(a + 256, len(at) - 1)
        part, edges = raw[at[a]: at[b]], at[a: b + 1] - at[a]
        lo, hi, head = pretokens(part, edges)
        new, first, n = np.unique(_keys(part, lo, hi, head), return_index=True, return_counts=True)
        top = np.argsort(-n, kind="stable")[: FREQUENT]
        keys.append(np.stack([new[top], n[top].astype(np.uint64)]))
        sizes.append(_sizes(part, lo[first[top]], hi[first[top]], head[first[top]], path))
    keys, sizes = np.concatenate(keys, axis=1), np.concatenate(sizes)
    new, first, back = np.unique(keys[0], return_index=True, return_inverse=True)
    n = np.bincount(back, weights=keys[1].astype(float))
    top = np.sort(np.argsort(-n, kind="stable")[:FREQUENT])
    return new[top], sizes[first[top]]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    docs = keyed_documents(docs)
    path = model or driver_file(MODEL)
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = tier.value
        for batch, raw, at in chunks(batches, CHUNK_BYTES):
            n = count_chunk(raw, at, keys, sizes, path) if len(raw) else np.zeros(batch.num_rows, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
