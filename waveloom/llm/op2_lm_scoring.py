"""Cross-entropy difference from matched bigram models.

The target model is trained on the documents labelled good, the background
model on all documents; same order, same smoothing, one vocabulary: every word of
the corpus, an unknown word and a start mark. Bigram probabilities are smoothed towards the unigram,
p(w|v) = (c(v,w) + K p(w)) / (c(v) + K), p(w) = (c(w) + 1) / (N + V).
A text's own counts are left out of all four (and of N) before it is scored, in the background model and, if it is a
target document, in the target model; so no text is judged by a model that has learned it by heart.
A document's score is the mean over its tokens of target loss minus background
loss (nats): the lower, the more like the target.

No word and no pair is left out, so the model grows with the corpus:

1. Words and pairs are counted per ``COMBINED`` bytes of text, dealt by hash as sorted, packed lists (``pack``), and
   summed part by part. What occurs once is not kept: without the text's own counts it has a count of 0.
2. The commonest words and pairs, at most ``HOT_WORDS`` and ``HOT_PAIRS``, are sent to the workers,
   which sum their losses per document. So no key that goes through a join is hot.
3. A Bloom filter over all pairs that occur twice (at most ``FILTER_BYTES``; beyond it is folded and only lets more through)
   tells the workers most pairs with a count of 0. Whatever passes goes out as one row per document and pair, is
   joined to the counts by an exchange and summed per document; so are the words beyond
   ``HOT_WORDS``, if there are any.

Keys of words and pairs are 64-bit hashes.

Defined cases: null and empty texts have 0 tokens and null losses and score; rows without a doc_id
count as background; repeated rows count each (one leaves the other's counts in); several texts of one doc_id are scored each; a very long text is scored in one
piece (a task holds about 40 times its size); ties at the cut to the commonest go to the join together; an empty table gives no row; without a
target document the target model is uniform; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import BASE, LOWER, U, chunks, keyed_documents, mix, prefix_sums, slice_hash, stored, table, words

HOT_WORDS, HOT_PAIRS = 3_000_000, 1_000_000  # the commonest are sent whole up to here, the others joined by shuffle
FILTER_BYTES = 64 << 20  # the most bytes of the filter over pairs; 8 bits a pair while it is smaller
PULL = 16.0  # K
START = U(0)
COMBINED = 8 << 20  # text whose counts are summed before they are dealt
SENT = 64  # packed lists in an Arrow batch
PARTS = 2  # lists per partition of the exchange
BLOB = 4096  # keys in a packed list at most
SCORED_BYTES = 1 << 20  # text counted or scored at once, beside the commonest words and pairs in memory
BROADCAST_TARGET = 2_000_000  # ids of target documents sent whole up to here, joined by shuffle above
COUNTS = ("t", "b", "ct", "cb")  # of a word: in target documents, in all, and the same before another word; of a pair t and b
PACKED = "word boolean, part int, keys binary, t binary, b binary, ct binary, cb binary"
TALLIES = "word boolean, key long, t long, b long, ct long, cb long, n long, part int, bits binary"
#: Of a pair to be looked up: tn, the text's hash and how often the pair occurs in it (negative in a target document), and k, the logarithms
#: of K p(w) in both models, two 32-bit numbers each; of a text: its size and sums.
ROWS = "doc_id long, tn long, p long, k long, size long, lt double, lb double"
COLD = ", cold_w long, nw int, cold_v long, of long"
STEPS = float(1 << 25)  # of a logarithm: half a step is 1.5e-8


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered) and the texts' offsets among them."""
    raw = LOWER[raw]
    lo, hi, edges = words(raw, at)
    return (slice_hash(prefix_sums(raw), lo, hi) if len(lo) else np.zeros(0, np.uint64)), edges


def pair_keys(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (START for the first of a text) and the key of the two."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[edges[:-1][edges[1:] > edges[:-1]]] = START
    return before, mix(before * BASE + hashes)


def summed(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], [np.add.reduceat(c[order], head) if len(head) else c for c in counts]


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte planes apart: the high planes are zero and compress away."""
    return np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def filter_bits(keys: np.ndarray, size: int) -> np.ndarray:
    """The four places of each key in a filter of ``size`` bits, a power of two (or an array of such, one a key)."""
    h = mix(keys ^ U(0x2545F4914F6CDD1D))
    mask = np.asarray(size, dtype=np.uint64) - U(1)
    return np.stack([(h >> U(s)) & mask for s in (0, 11, 22, 33)]).astype(np.int64)


def part_filter(keys: np.ndarray) -> bytes:
    """At least 8 bits a key, 64 at least, as a power of two."""
    size = 1 << max(6, int(8 * len(keys) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[filter_bits(keys, size).reshape(-1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(data: bytes, times: int) -> np.ndarray:
    """The filter of half the size, as often as asked, 8 bytes at least."""
    bits = np.frombuffer(data, np.uint8)
    for _ in range(times):
        if len(bits) > 8:
            bits = bits[: len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def tallies(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (word, key and counts) of all that occurs twice; of each part of the words one row without key: the sums over its n words;
    of each part of the pairs its filter. docs: text, target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(held: list) -> Iterator[pa.RecordBatch]:
            for word in (True, False):
                keys, counts = summed(np.concatenate([h[word][0] for h in held]), [np.concatenate([h[word][1][k] for h in held]) for k in range(4 if word else 2)])
                part = (mix(keys) % U(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                keys, counts, part = keys[order], [c[order] for c in counts], part[order]
                edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                cut = sorted({*edge.tolist(), *(x for a, b in zip(edge, np.append(edge[1:], len(part))) for x in range(int(a), int(b), BLOB))})
                ends = [*cut[1:], len(part)]
                for k in range(0, len(cut), SENT):
                    some = list(zip(cut[k: k + SENT], ends[k: k + SENT]))
                    column = lambda c: pa.array([c[a:b].astype(np.int32).tobytes() for a, b in some], pa.binary())  # noqa: B023, E731
                    blank = pa.array([b""] * len(some), pa.binary())
                    yield pa.record_batch([pa.array([word] * len(some)), pa.array(part[cut[k: k + SENT]]), pa.array([pack(keys[a:b]) for a, b in some], pa.binary()),
                                           *(column(counts[c]) if c < len(counts) else blank for c in range(4))], names=["word", "part", "keys", *COUNTS])

        for batch, raw, at in chunks(batches, SCORED_BYTES):
            hashes, edges = word_hashes(raw, at)
            target = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32), np.diff(edges))
            inner = np.ones(len(hashes), np.int32)
            inner[edges[1:][edges[1:] > edges[:-1]] - 1] = 0
            ones = np.ones(len(hashes), np.int32)
            held.append({True: summed(hashes, [target, ones, target * inner, inner]), False: summed(pair_keys(hashes, edges)[1], [target, ones])})
            size += len(raw)
            if size >= COMBINED:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(now: tuple, held: list) -> Iterator[pa.RecordBatch]:
            word, part = now
            keys, counts = summed(np.concatenate([h[0] for h in held]), [np.concatenate([h[1][k] for h in held]) for k in range(4 if word else 2)])
            often = counts[1] > 1
            n = int(often.sum())
            columns = [pa.array(keys[often].view(np.int64)), *(pa.array(c[often]) for c in counts), *([pa.nulls(n, pa.int64())] * (4 - len(counts)))]
            names = ["word", "key", *COUNTS, "n", "part", "bits"]
            yield pa.record_batch([pa.array(np.full(n, word)), *columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            sums = [int(c.sum()) for c in counts] if word else [None] * 4
            last = [word, None, *sums, len(keys), part, None if word else part_filter(keys[often])]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(last, (pa.bool_(), *[pa.int64()] * 6, pa.int32(), pa.binary()))], names=names)

        for batch in batches:
            for k in range(batch.num_rows):  # one list at a time: a batch may hold many
                row = batch.slice(k, 1).to_pylist()[0]
                if now != (row["word"], row["part"]):
                    if held:
                        yield from out(now, held)
                    now, held, waiting = (row["word"], row["part"]), [], 0
                held.append((unpack(row["keys"]), [np.frombuffer(row[c], np.int32).astype(np.int64) for c in COUNTS[: 4 if row["word"] else 2]]))
                waiting += len(held[-1][0])
                if waiting > 4 * len(held[0][0]) + (1 << 20):  # what came since the last sum outweighs it
                    held = [summed(np.concatenate([h[0] for h in held]), [np.concatenate([h[1][k] for h in held]) for k in range(len(held[0][1]))])]
                    waiting = 0
        if held:
            yield from out(now, held)

    dealt = docs.select("text", "target").mapInArrow(count, PACKED).repartition("word", "part").sortWithinPartitions("word", "part")
    return dealt.mapInArrow(merge, TALLIES)


def hot(counts: DataFrame, most: int) -> tuple[np.ndarray, list[np.ndarray], bool]:
    """Sorted keys and counts of the commonest rows, at most ``most``, and whether there are others."""
    upto, least, others = 0, None, False
    for r in sorted(counts.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # one row per frequency
        upto += r["n"]
        if others := upto > most:
            break
        least = r["b"]
    got = counts.filter(F.col("b") >= least if least is not None else F.lit(False)).toArrow()
    keys = got["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    narrow = np.int32 if got["b"].to_numpy().max(initial=0) < 2**31 else np.int64
    return keys[order], [got[c].to_numpy()[order].astype(narrow) for c in counts.columns if c != "key"], others


def gathered_filter(counts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filters of all parts end to end, where each starts (in bits) and its size in bits."""
    whole = counts.filter("bits IS NOT NULL")
    size = whole.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("n")).first()["n"]
    times = max(0, int(np.ceil(np.log2(max(size, 1) / FILTER_BYTES))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([folded(x, times).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["part", "bits"])

    got = whole.select("part", "bits").mapInArrow(fold, "part int, bits binary").toArrow()  # FILTER_BYTES at most, or 8 bytes a part
    by_part = dict(zip(got["part"].to_pylist(), got["bits"].to_pylist()))
    sizes = np.array([8 * len(by_part.get(p, bytes(8))) for p in range(parts)], np.int64)
    return np.frombuffer(b"".join(by_part.get(p, bytes(8)) for p in range(parts)), np.uint8), np.cumsum(sizes) - sizes, sizes


def maybe(keys: np.ndarray, filters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each key may be in the filters; none that is in is missed."""
    bits, start, sizes = filters
    part = (mix(keys) % U(len(sizes))).astype(np.int64)
    places = filter_bits(keys, sizes[part]) + start[part]
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def looked_up(keys: np.ndarray, table_keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which keys the table has, and their values; 0 where it has none."""
    if not len(table_keys) or not len(keys):
        return np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in columns]
    u, which = np.unique(keys, return_inverse=True)  # in order, so the search runs through the table once
    at = np.minimum(np.searchsorted(table_keys, u), len(table_keys) - 1)
    known = table_keys[at] == u
    return known[which], [np.where(known, c[at], 0)[which].astype(np.int64) for c in columns]


def two(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers in one of 64."""
    return (high.astype(np.int64) << 32) | (low.astype(np.int64) & 0xFFFFFFFF)


def halves(column: str) -> tuple[Column, Column]:
    return F.shiftright(column, 32), F.shiftright(F.shiftleft(column, 32), 32)


def times(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own text."""
    _, which, n = np.unique(mix(keys + owner.astype(np.uint64) * BASE), return_inverse=True, return_counts=True)
    return n[which]


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """target_ids: a column doc_id, distinct."""
    docs = keyed_documents(docs)
    chosen = target_ids.select("doc_id", F.lit(True).alias("target"))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_TARGET else chosen
    flagged = docs.join(chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(tallies(flagged, parts), "tallies")
    total = counts.filter("word AND key IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *COUNTS))).first()
    size = total["n"] + 2
    tokens = (total["t"], total["b"])
    starts = (total["t"] - total["ct"], total["b"] - total["cb"])
    often, pairs = counts.filter("word AND key IS NOT NULL").select("key", *COUNTS), counts.filter("NOT word AND key IS NOT NULL").select("key", "t", "b")
    word_keys, word_counts, others = hot(often, HOT_WORDS)
    keys, pair_counts, _ = hot(pairs, HOT_PAIRS)
    sent = docs.sparkSession.sparkContext.broadcast((word_keys, word_counts, keys, pair_counts, gathered_filter(counts, parts)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_keys, word_counts, keys, pair_counts, filters = sent.value
        for batch, raw, at in chunks(batches, SCORED_BYTES):
            hashes, edges = word_hashes(raw, at)
            before, pair = pair_keys(hashes, edges)
            n = np.diff(edges)
            owner = np.repeat(np.arange(len(n)), n)
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            own, first = target[owner], before == START
            nw, nv, np_ = times(owner, hashes), times(owner, before), times(owner, pair)
            known_w, (wt, wb, *_) = looked_up(hashes, word_keys, word_counts)
            known_v, (_, _, vt, vb) = looked_up(before, word_keys, word_counts)
            known, (pt, pb) = looked_up(pair, keys, pair_counts)
            cold_w, cold_v = ~known_w & others, ~known_v & ~first & others
            send = cold_w | cold_v
            unknown = np.flatnonzero(~known)
            send[unknown] |= maybe(pair[unknown], filters)
            # without the text's own: what no table has occurs in this text alone
            wt, wb = np.where(known_w, wt - own * nw, 0), np.where(known_w, wb - nw, 0)
            vt, vb = (np.where(first, s - o, np.where(known_v, v - o * nv, 0)) for s, v, o in zip(starts, (vt, vb), (own, 1)))
            pt, pb = np.where(known, pt - own * np_, 0), np.where(known, pb - np_, 0)
            base, prior = [], []
            for v, p, w, all_, o in zip((vt, vb), (pt, pb), (wt, wb), tokens, (target, 1)):
                k = (PULL / (all_ - o * n + size))[owner] * (w + 1)
                prior.append(k)
                base.append(np.bincount(owner, np.where(cold_v, 0.0, np.log(v + PULL)) - np.where(send, 0.0, np.log(p + k)), len(n)))
            rest = np.flatnonzero(send)
            _, head = np.unique(mix(pair[rest] + owner[rest].astype(np.uint64) * BASE), return_index=True)
            rest = rest[head]
            hash_, doc = batch.column(3).to_numpy(), batch.column(0)
            at_v = np.flatnonzero(cold_v)  # a context counts once for each time it precedes a word: nv is n here, and p is none
            _, head = np.unique(mix(before[at_v] + owner[at_v].astype(np.uint64) * BASE), return_index=True)
            at_v = at_v[head]
            none = lambda size, kind=pa.int64(): pa.nulls(size, kind)
            signed = lambda of, at: pa.array(two(hash_[owner[at]], np.where(own[at] > 0, -of[at], of[at])))  # noqa: B023, E731
            real = pa.float64()
            yield pa.record_batch([doc, pa.array(two(hash_, np.zeros(len(n)))), none(len(n)), none(len(n)), pa.array(n, pa.int64()), pa.array(base[0]), pa.array(base[1]),
                                   *([none(len(n)), none(len(n), pa.int32()), none(len(n)), none(len(n))] if others else [])], names=names)
            cold = [pa.array(hashes[rest].view(np.int64), mask=~cold_w[rest]), pa.array(nw[rest].astype(np.int32)), none(len(rest)), pa.array(n[owner[rest]], pa.int64())] if others else []
            k = two(*(np.rint(np.log(x[rest]) * STEPS) for x in prior))
            yield pa.record_batch([doc.take(pa.array(owner[rest])), signed(np_, rest), pa.array(pair[rest].view(np.int64)), pa.array(k), none(len(rest)), none(len(rest), real), none(len(rest), real), *cold], names=names)
            if len(at_v):
                m = len(at_v)
                yield pa.record_batch([doc.take(pa.array(owner[at_v])), signed(nv, at_v), none(m), none(m), none(m), none(m, real), none(m, real), none(m), none(m, pa.int32()), pa.array(before[at_v].view(np.int64)), none(m)], names=names)

    schema = ROWS + COLD * others
    names = [c.split()[0] for c in schema.split(", ")]
    rows = flagged.withColumn("text_hash", F.hash("text")).mapInArrow(measure, schema)
    is_base, is_pair, signed_n = F.col("lt").isNotNull(), F.col("p").isNotNull(), halves("tn")[1]
    n = F.abs(signed_n)
    own = {"t": F.when(signed_n < 0, n).otherwise(0), "b": n}  # of the text's own pair or context in either model
    prior = {m: F.exp(x / STEPS) for m, x in zip("tb", halves("k"))}
    context = {m: F.lit(0.0) for m in "tb"}
    spread = F.xxhash64("doc_id", "tn")  # rows without a key for a join are dealt by their text
    if others:
        for c, kept, here in (("cold_w", ("t", "b"), is_pair), ("cold_v", ("ct", "cb"), ~is_pair)):
            side = often.select(F.col("key").alias(f"{c}_key"), *(F.col(k).alias(f"{c}_{m}") for k, m in zip(kept, "tb")))
            rows = rows.join(side, F.when(here, F.col(c)).isNotNull() & (F.coalesce(F.when(here, F.col(c)), spread) == F.col(f"{c}_key")), "left")
        own_w = {"t": F.when(signed_n < 0, F.col("nw")).otherwise(0), "b": F.col("nw")}
        for m, all_ in zip("tb", tokens):
            scale = PULL / (all_ - (F.when(signed_n < 0, F.col("of")).otherwise(0) if m == "t" else F.col("of")) + size)
            prior[m] = F.when(F.col("cold_w").isNotNull(), scale * (F.coalesce(F.col(f"cold_w_{m}") - own_w[m], F.lit(0)) + 1)).otherwise(prior[m])
        context = {m: F.when(~is_pair & F.col("cold_v").isNotNull(), n * F.log(F.coalesce(F.col(f"cold_v_{m}") - own[m], F.lit(0)) + PULL)).otherwise(0.0) for m in "tb"}
    joined = rows.join(pairs.hint("shuffle_hash"), is_pair & (F.coalesce("p", spread) == F.col("key")), "left")
    loss = {}
    for m in "tb":
        c = F.coalesce(F.col(m) - own[m], F.lit(0))
        loss[m] = F.when(is_base, F.col(f"l{m}")).when(is_pair, -n * F.log(c + prior[m])).otherwise(context[m])
    sums = joined.groupBy("doc_id", halves("tn")[0].alias("text_hash")).agg(F.sum(F.when(is_base, F.col("size"))).alias("tokens"), F.count(F.when(is_base, 1)).alias("copies"), F.sum(loss["t"]).alias("lt"), F.sum(loss["b"]).alias("lb"))
    each = sums.select("doc_id", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), *(F.when(F.col("tokens") > 0, F.col(c) / F.col("tokens")).alias(a) for c, a in (("lt", "target_loss"), ("lb", "background_loss"))), "copies")
    return each.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return score(table(spark, sf_dir, "documents"), good)
