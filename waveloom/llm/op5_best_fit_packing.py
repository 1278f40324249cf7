"""Best-fit packing planned on the length histogram.

1. Each document is tokenised once in its partition and cut into pieces (only
   longer ones; the first piece takes the remainder). The piece rows, without
   ids, are written to the shared folder.
2. The plan is best-fit decreasing over *counts*: at most ``capacity`` lengths,
   whatever the number of documents. Sequences stay intervals of numbers, so a
   step moves a whole interval and the plan is a short list of runs.
3. Pieces take planned slots by joining on their rank within their length. The
   rank is local to (length, bucket of doc_id) plus the bucket's offset, so a
   length shared by a third of all rows is ranked in many tasks.

The ids come from the rank file of the same vocabulary through the faster of
the two public libraries; tests hold them equal to the tokenizers file's. A text
that this library can't take (its regular expression gives up on very long runs
of white space) is encoded whole by the other.

Defined cases: null and empty texts are one piece holding only the end id 0;
repeated rows (and repeated ids) are packed each; pieces of one length tie and take their
slots by rank; a very long text is encoded whole in its task (its ids are about 20 times its size) and cut into pieces; an empty table packs to no
row; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveloom.llm.common import driver_file, keyed_documents, stored, table

CAPACITY = 2048
END_ID = 0
BROADCAST_RUNS = 1_000_000  # the plan is sent whole below this many runs, joined by shuffle above
RANKS, WHOLE, SPECIAL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, twin int"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_worker: dict = {}


def encoding(path: str):
    if _worker.get("path") != path:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _worker.update(path=path, encoding=tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL))
    return _worker["encoding"]


def library(path: str):
    if _worker.get("library_path") != path:
        from tokenizers import Tokenizer

        _worker.update(library_path=path, library=Tokenizer.from_file(path))
    return _worker["library"]


def token_ids(text: str, path: str) -> np.ndarray:
    """uint32 ids of a whole text, special strings inside it as the tokenizers library treats them."""
    try:
        return np.asarray(encoding(path).encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
    except ValueError:
        return np.asarray(library(os.path.join(os.path.dirname(path), WHOLE)).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what a whole number of full ones leaves."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts. Rows (length, first rank, n, first sequence, offset):
    ranks [first, first + n) of that length go to consecutive sequences at that offset."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: intervals of sequences
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        fit = length
        while left:
            while fit <= capacity and not room[fit]:
                fit += 1
            if fit > capacity:
                per = capacity // length
                room[capacity].append((opened, -(-left // per)))
                opened += -(-left // per)
                fit = capacity
            first, n = room[fit].pop()
            per = fit // length
            full = min(n, left // per)
            used, layers = (full, per) if full else (1, left)
            for k in range(layers):
                runs.append((length, rank, used, first, capacity - fit + k * length))
                rank += used
            left -= used * layers
            if n > used:
                room[fit].append((first + used, n - used))
            if rest := fit - layers * length:
                room[rest].append((first, used))
                fit = min(fit, max(length, rest)) if rest >= length else fit
    return runs


def pieces(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    docs, path = keyed_documents(docs), ranks or driver_file(RANKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", path), np.uint32(END_ID)).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s: s + n].tobytes()), zlib.crc32(ids.tobytes()) & 0x7FFFFFFF) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "twin"])

    return docs.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and offset."""
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = stored(pieces(docs, ranks, capacity), "pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs_rows = plan(histogram, capacity)
    runs = spark.createDataFrame(runs_rows, "run_length long, first long, n long, seq long, offset long")
    if len(runs_rows) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "twin", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    slot = ranked.join(runs, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return slot.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
