"""Shared pieces of the text operators: table access, shared-folder tables,
and vectorised kernels over the byte buffers of an Arrow string column."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text handled at once by a kernel; one longer text is its own chunk
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a fresh one where none is set and Spark runs on this machine alone, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="waveloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def keyed_documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (long) and text (string) of a documents-like table, whatever else it carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def driver_file(name: str) -> str:
    """Local path of a public tokenizer file (installed alike on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- byte kernels

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept per worker."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = 1 << max(16, n.bit_length())
        one = np.full(m, BASE, dtype=np.uint64)
        one[0] = U(1)
        _powers["up"] = np.multiply.accumulate(one)
        one[1:] = BASE_INV
        _powers["down"] = np.multiply.accumulate(one)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of column ``text`` (or one row), with their bytes and offsets."""
    for batch in batches:
        raw, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
        n, lo = batch.num_rows, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo), raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
            lo = hi


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """n + 1 running sums of code(byte) * BASE**i: any slice's polynomial hash from two of them."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[raw] * powers(len(raw))[0], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[lo:hi] that depend on the bytes and the length alone."""
    down = powers(len(sums))[1]
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the running count of words at the n + 1 text offsets.
    A word is a run of bytes other than 0x20 and 0x09-0x0D that stays within its text."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~IS_SEP[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    lo = np.flatnonzero(first)
    return lo, np.flatnonzero(last) + 1, np.searchsorted(lo, at).astype(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
