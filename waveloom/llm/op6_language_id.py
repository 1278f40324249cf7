"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed: the pieces of a public subword model plus its 256
single bytes, so any text can be segmented. Per language every piece has a
probability, learned by expectation-maximisation: the forward-backward pass
over all segmentations of the training words gives expected piece counts. A
text's likelihood under a language is the product over its words of the
forward sum over *all* segmentations of the word.

A word is a run of bytes outside 0x20 and 0x09-0x0D, lower-cased, with the word
mark in front, however long: in scripts without blanks a sentence is one word. Words up to ``SHORT`` bytes are summed in
batches of one length; longer ones, of any lengths, in logarithms and block by block, so memory doesn't grow with a word's length.
Likelihoods are computed once per distinct word and worker.

Training uses a bounded, documented sample: ``PER_LANGUAGE`` training rows of
each language on average, those lowest in a hash of doc_id. Prediction covers every row
and looks at the text alone.

Defined cases: text null or without a letter gives 'und' with score 0; ties go
to the language first in order; without training rows all are 'und'; rows with a
null doc_id are predicted but not learned from; repeated rows are predicted each; very long texts and words are scored whole; an
empty table gives no row; other columns are ignored. The model is broadcast: pieces x languages, 262 kB a language; batches shrink with the number of languages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waveloom.llm.common import BYTE_CODE, U, chunks, driver_file, mix, powers, prefix_sums, slice_hash, stored, table, words

MODEL = "piece_bpe_32k.model"
PER_LANGUAGE = 400
ROUNDS = 3
LITERAL_LANGUAGES = 1000  # up to here the counts by language are constants of the plan, beyond they are joined
SMOOTHING = 0.01
SHORT = 64
CELLS = 150_000  # bytes of words summed at once, fewer with many languages
BLOCK = 4096  # bytes of a long word looked up at once
CACHE = 1 << 19
MARK = "▁".encode()
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_worker: dict = {}


def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """Sorted slice hashes of the pieces, and the longest piece in bytes. Byte pieces come as single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).encode()
            if piece.rfind(MARK) <= 0:  # the mark only begins a word here
                found.add(piece)
    pieces = sorted(found)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    return np.sort(slice_hash(prefix_sums(raw), at[:-1], at[1:])), max(map(len, pieces))


class Pieces:
    """Piece numbers by hash: two direct tables, then a sorted search for what neither holds."""

    BITS = 20

    def __init__(self, keys: np.ndarray, longest: int):
        self.keys, self.longest, self.n = keys, longest, len(keys)
        self.tables = []
        left = np.arange(len(keys))
        for shift in (0, 22):
            slot = self._slot(keys[left], shift)
            place = np.full(1 << self.BITS, len(keys), np.int32)
            place[slot] = left
            left = left[place[slot] != left]
            self.tables.append((shift, place))
        self.rest = keys[left]
        self.rest_at = left
        self.padded = np.append(keys, U(0))

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> U(shift)) & U((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or n where there is none."""
        shift, place = self.tables[0]
        out = place[self._slot(h, shift)]
        miss = np.flatnonzero(self.padded[out] != h)
        if len(miss):
            shift, place = self.tables[1]
            second = place[self._slot(h[miss], shift)]
            second = np.where(self.padded[second] == h[miss], second, self.n).astype(np.int32)
            if len(self.rest):
                at = np.minimum(np.searchsorted(self.rest, h[miss]), len(self.rest) - 1)
                second = np.where(self.rest[at] == h[miss], self.rest_at[at], second).astype(np.int32)
            out[miss] = second
        return out


def _matrix(raw: np.ndarray, lo: np.ndarray, n: int) -> np.ndarray:
    """The marked words of n bytes as rows of bytes."""
    body = raw[lo[:, None] + np.arange(n)]
    return np.concatenate([np.broadcast_to(np.frombuffer(MARK, np.uint8), (len(lo), 3)), body], axis=1)


def _lattice(rows: np.ndarray, pieces: Pieces) -> dict[tuple[int, int], np.ndarray]:
    """Piece numbers (n for none) of every substring [i, j) of at most the longest piece's bytes."""
    width = rows.shape[1]
    up, down = powers(width + 1)
    sums = np.zeros((len(rows), width + 1), np.uint64)
    np.cumsum(BYTE_CODE[rows] * up[:width], axis=1, out=sums[:, 1:])
    out = {}
    for j in range(1, width + 1):
        for i in range(max(0, j - pieces.longest), j):
            h = mix((sums[:, j] - sums[:, i]) * down[i] + U((j - i) * 0xD6E8FEB86659FD93 % 2**64))
            found = pieces.find(h)
            if (found < pieces.n).any():
                out[i, j] = found
    return out


def forward(rows: np.ndarray, pieces: Pieces, theta: np.ndarray) -> np.ndarray:
    """log of the summed probability over all segmentations, rows x languages. theta: (n + 1) x languages, last row 0."""
    width, lattice = rows.shape[1], _lattice(rows, pieces)
    alpha = np.zeros((width + 1, len(rows), theta.shape[1]))
    alpha[0] = 1
    scale = np.zeros((len(rows), theta.shape[1]))
    for j in range(1, width + 1):
        for i in range(max(0, j - pieces.longest), j):
            if (i, j) in lattice:
                alpha[j] += alpha[i] * theta[lattice[i, j]]
        if j % 16 == 0 and j < width:
            low = max(0, j + 1 - pieces.longest)
            top = alpha[low: j + 1].max(axis=0)
            alpha[low: j + 1] /= top
            scale += np.log(top)
    return np.log(alpha[width]) + scale


def expected(rows: np.ndarray, weight: np.ndarray, lang: np.ndarray, pieces: Pieces, theta: np.ndarray, out: np.ndarray) -> None:
    """Adds each row's expected piece counts, times its weight, to out[language, piece]."""
    width, lattice = rows.shape[1], _lattice(rows, pieces)
    alpha, beta = np.zeros((width + 1, len(rows))), np.zeros((width + 1, len(rows)))
    alpha[0] = beta[width] = 1
    p = {k: theta[v, lang] for k, v in lattice.items()}
    order = sorted(lattice)
    for i, j in sorted(order, key=lambda k: k[1]):
        alpha[j] += alpha[i] * p[i, j]
    for i, j in reversed(order):
        beta[i] += beta[j] * p[i, j]
    z = np.maximum(alpha[width], 1e-300)
    for (i, j), found in lattice.items():
        np.add.at(out, (lang, found), weight * alpha[i] * p[i, j] * beta[j] / z)


def pieces_ending(raw: np.ndarray, lo: np.ndarray, n: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """For j = 1, 2, .. the piece numbers of the marked words' substrings that end at j, by their length; n counts the mark.
    What lies beyond a shorter word's end is other text and reaches no sum of its own."""
    width, mark = int(n.max()), np.frombuffer(MARK, np.uint8)
    for p in range(0, width, BLOCK):
        a, b = max(0, p - pieces.longest), min(width, p + BLOCK)
        k = np.arange(a, b)
        rows = raw[np.minimum(lo[:, None] + np.maximum(k - len(mark), 0), len(raw) - 1)]
        if a < len(mark):
            rows[:, : len(mark) - a] = mark[a:][: rows.shape[1]]
        up, down = powers(b - a + 1)
        sums = np.zeros((len(rows), b - a + 1), np.uint64)
        np.cumsum(BYTE_CODE[rows] * up[: b - a], axis=1, out=sums[:, 1:])
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for size in range(1, min(pieces.longest, b - a) + 1):
            first = max(0, p + 1 - size - a)  # the first start whose end is in this block
            h = mix((sums[:, first + size:] - sums[:, first: b - a + 1 - size]) * down[first: b - a + 1 - size] + U(size * 0xD6E8FEB86659FD93 % 2**64))
            ids = pieces.find(h.reshape(-1)).reshape(h.shape)
            for c in np.flatnonzero((ids < pieces.n).any(axis=0)).tolist():
                found.setdefault(a + first + c + size, []).append((size, ids[:, c]))
        for j in range(p + 1, b + 1):
            yield j, found.get(j, [])


def forward_long(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, pieces: Pieces, log_theta: np.ndarray) -> np.ndarray:
    """``forward`` for words of any lengths, in logarithms; only the last sums a piece can reach back to are held."""
    n = hi - lo + len(MARK)
    nothing = np.full((len(lo), log_theta.shape[1]), -np.inf)
    out, last = nothing.copy(), {0: np.zeros_like(nothing)}
    for j, ending in pieces_ending(raw, lo, n, pieces):
        total = nothing
        for size, ids in ending:
            total = np.logaddexp(total, last[j - size] + log_theta[ids])
        last[j] = total
        last.pop(j - pieces.longest, None)
        out[n == j] = total[n == j]
    return out


def expected_long(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, lang: np.ndarray, pieces: Pieces, log_theta: np.ndarray, out: np.ndarray) -> None:
    """``expected`` for words of any lengths, in logarithms."""
    n = hi - lo + len(MARK)
    steps = list(pieces_ending(raw, lo, n, pieces))
    width = len(steps)
    alpha, beta = np.full((width + 1, len(lo)), -np.inf), np.full((width + 1, len(lo)), -np.inf)
    alpha[0] = 0
    beta[n, np.arange(len(lo))] = 0
    for j, ending in steps:
        for size, ids in ending:
            alpha[j] = np.logaddexp(alpha[j], alpha[j - size] + log_theta[ids, lang])
    for j, ending in reversed(steps):
        for size, ids in ending:
            beta[j - size] = np.logaddexp(beta[j - size], beta[j] + log_theta[ids, lang])
    z = alpha[n, np.arange(len(lo))]
    for j, ending in steps:
        for size, ids in ending:
            np.add.at(out, (lang, ids), weight * np.exp(alpha[j - size] + log_theta[ids, lang] + beta[j] - z))


def by_length(lo: np.ndarray, hi: np.ndarray, cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """Batches of words of one length, up to SHORT bytes; longer ones in order of length, as length 0."""
    n = hi - lo
    order = np.argsort(n, kind="stable")
    short = int(np.searchsorted(n[order], SHORT, side="right"))
    edges = np.flatnonzero(np.diff(n[order[:short]])) + 1
    for part in np.split(order[:short], edges):
        step = max(1, cells // (3 + int(n[part[0]]))) if len(part) else 1
        for a in range(0, len(part), step):
            yield int(n[part[0]]), part[a: a + step]
    a = short
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * int(n[order[b]]) <= cells:
            b += 1
        yield 0, order[a:b]
        a = b


def score_chunk(raw: np.ndarray, at: np.ndarray, pieces: Pieces, theta: np.ndarray, log_theta: np.ndarray, cache: dict) -> np.ndarray:
    """Texts x languages log-likelihoods."""
    lo, hi, _ = words(raw, at)
    if not len(lo):
        return np.zeros((len(at) - 1, theta.shape[1]))
    keys = slice_hash(prefix_sums(raw), lo, hi)
    new, first, back = np.unique(keys, return_index=True, return_inverse=True)
    value = np.zeros((len(new), theta.shape[1]))
    known = cache.get("keys", np.zeros(0, np.uint64))
    hit = np.zeros(len(new), bool)
    if len(known):
        where = np.minimum(np.searchsorted(known, new), len(known) - 1)
        hit = known[where] == new
        value[hit] = cache["values"][where[hit]]
    todo = np.flatnonzero(~hit)
    if len(todo):
        a, b = lo[first[todo]], hi[first[todo]]
        for n, part in by_length(a, b, CELLS * 8 // max(8, theta.shape[1])):
            value[todo[part]] = forward(_matrix(raw, a[part], n), pieces, theta) if n else forward_long(raw, a[part], b[part], pieces, log_theta)
        merged, values = np.concatenate([known, new[todo]]), np.concatenate([cache["values"], value[todo]]) if len(known) else value[todo]
        if merged.size * theta.shape[1] > 2 * CACHE:
            merged, values = new, value
        order = np.argsort(merged)
        cache.update(keys=merged[order], values=values[order])
    edges = np.searchsorted(lo, at)
    out = np.zeros((len(at) - 1, theta.shape[1]))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    out[full] = np.add.reduceat(value[back], edges[:-1][full], axis=0)
    return out


def logs(theta: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(theta)


def train(docs: DataFrame, model: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, int]:
    """Languages, log priors, piece keys, theta ((n + 1) x languages) and the longest piece; docs: doc_id, text, lang."""
    spark = docs.sparkSession
    keys, longest = vocabulary(model)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    priors = {r["lang"]: r["n"] for r in sizes.collect()}
    share = F.least(F.lit(1.0), PER_LANGUAGE / F.col("n"))  # of a language's rows, by hash: no window, so no language in one task
    if not priors or len(priors) > LITERAL_LANGUAGES:
        chosen = known.join(sizes, "lang")
    else:
        chosen = known.withColumn("n", F.element_at(F.create_map(*[F.lit(x) for kv in sorted(priors.items()) for x in kv]), F.col("lang")))
    chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share * (1 << 32))
    counts = stored(
        chosen.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("text"))
        .filter(F.col("text") != "")
        .groupBy("lang", "text").agg(F.count(F.lit(1)).alias("n")), "language-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    theta = np.full((len(keys) + 1, len(langs)), 1 / len(keys))
    theta[-1] = 0
    number = {x: i for i, x in enumerate(langs)}
    for _ in range(ROUNDS if langs else 0):
        sent = spark.sparkContext.broadcast((keys, theta, longest))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, theta, longest = sent.value
            pieces, total, log_theta = Pieces(keys, longest), np.zeros((theta.shape[1], len(keys) + 1)), logs(theta)
            for batch, raw, at in chunks(batches):
                lang = np.array([number[x] for x in batch.column(0).to_pylist()])
                weight = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                for size, part in by_length(at[:-1], at[1:]):
                    if size:
                        expected(_matrix(raw, at[part], size), weight[part], lang[part], pieces, theta, total)
                    elif len(part):
                        expected_long(raw, at[part], at[part + 1], weight[part], lang[part], pieces, log_theta, total)
            total[:, -1] = 0
            i, j = np.nonzero(total)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["lang", "piece", "n"])

        got = counts.mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()  # languages x pieces at most
        theta = np.full((len(keys) + 1, len(langs)), SMOOTHING)
        theta[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        theta[-1] = 0
        theta /= theta.sum(axis=0)
    total = sum(priors.get(x, 0) for x in langs) or 1
    return langs, np.log(np.array([max(priors.get(x, 0), 1) / total for x in langs])), keys, theta, longest


def identify(docs: DataFrame, model: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; with carry also the row itself, as column ``row``."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row") if carry else F.lit(None).cast("struct<none:int>").alias("row")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), row)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, model or driver_file(MODEL)))
    stamp = uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, priors, keys, theta, longest = sent.value
        if _worker.get("stamp") != stamp:
            _worker.clear()
            _worker.update(stamp=stamp, pieces=Pieces(keys, longest), log_theta=logs(theta), cache={})
        for batch, raw, at in chunks(batches):
            known = batch.column(3).to_numpy(zero_copy_only=False)
            if langs:
                score = score_chunk(raw, at, _worker["pieces"], theta, _worker["log_theta"], _worker["cache"]) + priors
                best = score.argmax(axis=1)
                top = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
                name = np.where(known, np.array(langs, dtype=object)[best], UNKNOWN)
                top = np.where(known, top, 0.0)
            else:
                name, top = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(name, pa.string()), pa.array(top, pa.float64()), *([batch.column(4)] if carry else [])], names=["doc_id", "held_out", "lang_pred", "score", *(["row"] if carry else [])])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = docs.select("doc_id", F.lower("text").alias("text"), held.alias("held_out"), letter.alias("letter"), *(["row"] if carry else []))
    schema = StructType([*StructType.fromDDL(SCHEMA), *([docs.schema["row"]] if carry else [])])
    return given.mapInArrow(predict, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
