"""Exact-substring removal by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or same document and earlier start), that is, where the
longest previous factor (LPF) is at least ``LENGTH``. A suffix array of the whole
corpus in one place is neither possible nor needed:

1. Anchors. Of the k-grams inside a window of LENGTH bytes the one with the least
   hash is its anchor. Equal windows have equal anchors at equal places, so a
   window's earlier copy is always found among the windows of the same anchor.
   The stretch of consecutive windows with one anchor is a region. One row per
   region goes out: anchor hash, hash of the region's bytes, place (about one row per 35 bytes).
2. Sifting. Rows are dealt and sorted by anchor hash, then region hash. Anchors that occur once
   drop out. Equal regions of one anchor (64-bit hashes compared within the anchor's own rows) are pre-aggregated: every LPF in all but the first is over LENGTH,
   so these go whole; a chunk of text settles its own, so a hot anchor sends one row per chunk and
   region. An anchor with regions that differ (edges of copies, edits) passes one
   representative of each on.
3. Suffix order. The representatives' bytes are dealt by anchor; blocks of them
   get a suffix array (prefix doubling, cut at LENGTH bytes), the previous and next smaller positions in it, and from
   these the LPF array: the longer of the common prefixes with the two. A group longer than a
   block carries the hashes of its windows to the next block.
4. Hot anchors, of more than ``HOT`` representatives (a passage in a third of all documents has an edge in each), don't
   go to one task: their gram is made longer. A window holds either the half of the missing bytes before the gram or the half
   behind it, so a region falls into two at most, each keyed by its longer gram. Equal ones are
   pre-aggregated again (all but the first go whole), what stands alone drops out, a key of up to ``HOT`` goes to step 3, and one above is parted
   again: at most seven times, until the gram is the window. So a task's memory is bounded by BLOCK and HOT, and a region is at most two rows a round, however large its group is.
5. Spans are gathered by document; documents are joined and rewritten.

Defined cases: null and empty texts have no byte; texts under LENGTH bytes lose nothing; rows that repeat whole
are one document (each row comes back); several texts of one doc_id are documents of their own, in order of a hash of their text; rows without a
doc_id come back unchanged; a very long text is cut into no pieces (a task holds about 60 times its size); of copies that tie in all but doc_id the smallest id keeps its
bytes; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveloom.llm.common import U, chunks, keyed_documents, prefix_sums, slice_hash, stored, table

LENGTH, GRAM = 100, 32
CHUNK = 2 << 20
BLOCK = 2 << 20  # bytes of regions in one suffix array
HOT = 1_000  # representatives of an anchor above which its windows are compared by an exchange
BROADCAST_ROWS = 2_000_000  # hot anchors, their repeated parts and texts that share an id are sent whole up to here, joined by shuffle above
REGIONS = "h long, r long, doc_id long, v int, start long, n int, again boolean"
SIFTED = "h long, doc_id long, v int, start long, n int, whole boolean"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks of that width."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    rows = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def regions(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each region: text number, first window's start in the chunk, number of windows, anchor hash, region hash."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(raw)
    lo = np.arange(n - gram + 1)
    h = slice_hash(sums, lo, lo + gram)
    least = sliding_least((h & U(0xFFFFFFFF00000000)) | lo.astype(np.uint64), length - gram + 1)
    inside = np.zeros(len(least) + 1, np.int64)
    starts, ends = at[:-1], at[1:] - length + 1
    long_enough = ends > starts
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough], -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = (least[window] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    head = np.flatnonzero(new)
    start, count = window[head], np.diff(np.append(head, len(window)))
    return np.searchsorted(at, start, side="right") - 1, start, count, h[anchor[head]], slice_hash(sums, start, start + count - 1 + length)


def anchor_rows(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches, CHUNK):
            text, start, n, h, r = regions(raw, at)
            ids, variants = (batch.column(k).to_numpy() for k in (0, 2))
            doc, v, start, h, r = ids[text], variants[text], start - at[text], h.view(np.int64), r.view(np.int64)
            order = np.lexsort((start, v, doc, r, h))
            h, r, doc, v, start, n = (x[order] for x in (h, r, doc, v, start, n))
            again, same = np.zeros(len(h), bool), np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
            same[1:] = again[1:] & (doc[1:] == doc[:-1]) & (v[1:] == v[:-1]) & (start[1:] == start[:-1])
            columns = (pa.array(x[~same], t) for x, t in zip((h, r, doc, v, start, n, again), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())))
            yield pa.record_batch(list(columns), names=["h", "r", "doc_id", "v", "start", "n", "again"])

    return docs.mapInArrow(make, REGIONS)


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, r, doc_id, v, start -> repeats of a region (whole) and representatives of anchors with several regions."""
    names = ["h", "doc_id", "v", "start", "n", "whole"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    held, mixed = None, False  # the first row of the run that may go on, and whether its anchor had another region before
    last = None

    def rows(columns, whole):
        return pa.record_batch([pa.array(x, t) for x, t in zip((*columns, np.full(len(columns[0]), whole)), kinds)], names=names)

    for batch in batches:
        again = batch.column(6).to_numpy(zero_copy_only=False)
        h, r, *place = (batch.column(i).to_numpy() for i in range(6))  # place: doc_id, v, start, n
        if again.any():
            yield rows([x[again] for x in (h, *place)], True)
            h, r, *place = (x[~again] for x in (h, r, *place))
        if not len(h):
            continue
        before = lambda x, i: np.concatenate([[last[i] if last else ~x[0]], x[:-1]])  # noqa: B023, E731
        same_h = h == before(h, 0)
        same_run = same_h & (r == before(r, 1))
        same_row = same_run & (place[0] == before(place[0], 2)) & (place[1] == before(place[1], 3)) & (place[2] == before(place[2], 4))
        again = np.flatnonzero(same_run & ~same_row)
        if len(again):
            yield rows([x[again] for x in (h, *place)], True)
        first = np.flatnonzero(~same_run)
        if len(first):
            if held is not None and (mixed or same_h[first[0]]):
                yield rows([np.array([x]) for x in held], False)
            part = same_h[first]
            part[:-1] |= same_h[first[1:]]
            give = first[:-1][part[:-1]]
            if len(give):
                yield rows([x[give] for x in (h, *place)], False)
            i = first[-1]
            held, mixed = (h[i], *(x[i] for x in place)), bool(same_h[i])
        last = (h[-1], r[-1], *(x[-1] for x in place[:3]))
    if held is not None and mixed:
        yield rows([np.array([x]) for x in held], False)


def nearest_smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in an array of distinct numbers the nearest place before it, and after it, with a smaller number; -1 and n for none.
    Pointer jumping: what lies between a place and its pointer is larger, so a pointer to a larger number moves on to that one's."""

    def before(x: np.ndarray) -> np.ndarray:
        at = np.arange(len(x)) - 1
        open_ = np.arange(len(x))
        while len(open_):
            open_ = open_[at[open_] >= 0]
            open_ = open_[x[at[open_]] > x[open_]]
            at[open_] = at[at[open_]]
        return at

    return before(order), len(order) - 1 - before(order[::-1])[::-1]


def longest_previous(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The LPF array of the suffixes at the given starts (in text order), cut at ``length`` bytes."""
    size, ranks = 1, [(1, data.astype(np.uint32))]
    while size < length:
        step = min(size, length - size)
        rank = ranks[-1][1]
        nxt = np.zeros_like(rank)
        nxt[: len(rank) - step] = rank[step:]
        rank = np.unique((rank.astype(np.uint64) << U(32)) | nxt, return_inverse=True)[1].astype(np.uint32)
        size += step
        ranks.append((size, rank))
    order = np.argsort(ranks[-1][1][starts], kind="stable")  # the suffix array; suffixes equal as far as they are looked at stand in text order
    out = np.zeros(len(starts), np.int64)
    for near in nearest_smaller(order):
        has = (near >= 0) & (near < len(order))
        a, b = starts[order[has]], starts[order[near[has]]]
        common = np.zeros(len(a), np.int64)
        for size, rank in reversed(ranks):
            same = (common + size <= length) & (rank[np.minimum(a + common, len(data) - 1)] == rank[np.minimum(b + common, len(data) - 1)])
            common[same] += size
        out[order[has]] = np.maximum(out[order[has]], common)
    return out


def earlier_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions (h, doc_id, v, start, region) sorted by h, doc_id, v, start -> spans (doc_id, v, lo, hi) of windows with an earlier copy."""
    seen_h, seen = None, np.zeros(0, np.uint64)
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(4).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(4).offset: batch.column(4).offset + batch.num_rows + 1])
        row = 0
        while row < batch.num_rows:
            upto = max(row + 1, row + int(np.searchsorted(np.cumsum(sizes[row:]), BLOCK, side="right")))
            part = batch.slice(row, upto - row)
            h, doc, v, start = (part.column(i).to_numpy() for i in range(4))
            size = sizes[row:upto]
            data = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)
            edge = np.concatenate([[0], np.cumsum(size)])
            n = size - LENGTH + 1
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = edge[owner] + place
            found = longest_previous(data, at) >= LENGTH
            codes = slice_hash(prefix_sums(data), at, at + LENGTH)
            if h[0] == seen_h:
                found |= (h[owner] == seen_h) & np.isin(codes, seen)
            fresh = np.unique(codes[h[owner] == h[-1]])
            seen = np.union1d(seen, fresh) if h[-1] == seen_h else fresh
            seen_h = h[-1]
            hit = np.flatnonzero(found)
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
                a = hit[new]
                b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                yield pa.record_batch([pa.array(doc[owner[a]]), pa.array(v[owner[a]]), pa.array(start[owner[a]] + place[a]), pa.array(start[owner[b]] + place[b] + LENGTH)], names=["doc_id", "v", "lo", "hi"])
            row = upto


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions (h, doc_id, v, start, region, at, gram: place and length of what all their windows hold; at -1: the anchor, not found yet) -> the parts
    whose windows hold the half of the missing bytes before it, or else one byte over the half behind, with a key and a hash of the part (h, r, doc_id, v, start, region, at, gram)."""
    for batch in batches:
        for row in range(0, batch.num_rows, 5000):
            part = batch.slice(row, 5000)
            h, doc, v, start, at, gram = (part.column(i).to_numpy() for i in (0, 1, 2, 3, 5, 6))
            parts = part.column(4).to_pylist()
            size = np.array([len(x) for x in parts])
            edge = np.concatenate([[0], np.cumsum(size)])
            raw = np.frombuffer(b"".join(parts), np.uint8)
            sums = prefix_sums(raw)
            if (at < 0).any():  # the anchor is the first of its kind in the region
                n = np.where(at < 0, size - GRAM + 1, 0)
                owner = np.repeat(np.arange(len(n)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lo = edge[owner] + place
                same = np.flatnonzero(slice_hash(sums, lo, lo + GRAM).view(np.int64) == h[owner])
                first = same[np.append(True, owner[same[1:]] != owner[same[:-1]])] if len(same) else same
                at = at.copy()
                at[owner[first]] = place[first]
            windows, missing = size - LENGTH + 1, LENGTH - gram
            before = -(-missing // 2)
            behind = missing // 2 + 1
            upto = np.clip(at - before + 1, 0, windows)  # windows from here on hold fewer bytes before the gram
            for lo, hi, g0, g1, side in ((0 * upto, upto, at - before, at + gram, 0), (upto, windows, at, at + gram + behind, 1)):
                k = np.flatnonzero(hi > lo)
                if len(k):
                    a, b, x, y = (edge[k] + z[k] for z in (lo, hi + LENGTH - 1, g0, g1))
                    key = slice_hash(sums, x, y) * U(2) + U(side)
                    key = (key ^ (h[k].view(U) >> U(7))) * U(0x9E3779B97F4A7C15)
                    cut = [p[i:j] for p, i, j in zip((parts[i] for i in k), lo[k].tolist(), (hi + LENGTH - 1)[k].tolist())]
                    columns = (key.view(np.int64), slice_hash(sums, a, b).view(np.int64), doc[k], v[k], start[k] + lo[k])
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.record_batch([*map(pa.array, columns, kinds), pa.array(cut, pa.binary()), pa.array((g0 - lo)[k], pa.int32()), pa.array((g1 - g0)[k], pa.int32())], names=["h", "r", "doc_id", "v", "start", "region", "at", "gram"])


def cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, wanted(start, n, h), v -> the bytes of each wanted region."""
    for batch, raw, at in chunks(batches, CHUNK):
        wanted = batch.column(2)
        edge = wanted.offsets.to_numpy()
        flat = wanted.flatten()
        start, n, h = (flat.field(i).to_numpy() for i in range(3))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(edge))
        lo = at[owner] + start
        size = np.minimum(n.astype(np.int64) + LENGTH - 1, at[owner + 1] - lo)
        ok = size >= LENGTH
        lo, size, owner, start, h = lo[ok], size[ok], owner[ok], start[ok], h[ok]
        index = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data = raw[index]
        region = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
        yield pa.record_batch([pa.array(h), *(batch.column(k).take(pa.array(owner)) for k in (0, 3)), pa.array(start), region], names=["h", "doc_id", "v", "start", "region"])


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans(lo, hi) or null -> the result row."""
    for batch, raw, at in chunks(batches, CHUNK):
        out = []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            own = raw[at[i]: at[i + 1]]
            if not spans:
                out.append((len(own), 0, 0, hashlib.sha256(own).hexdigest()))
                continue
            edge = np.zeros(len(own) + 1, np.int64)
            lo, hi = (np.minimum(np.array([s[k] for s in spans]), len(own)) for k in ("lo", "hi"))
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            gone = np.cumsum(edge[:-1]) > 0
            heads = gone.copy()
            heads[1:] &= ~gone[:-1]
            out.append((len(own), int(gone.sum()), int(heads.sum()), hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        columns = list(zip(*out))
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(docs: DataFrame) -> DataFrame:
    """Adds v, 0 but for the second and further texts of one doc_id."""
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    several = hashed.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low <> high").select("doc_id")
    texts = hashed.join(several, "doc_id", "left_semi").select("doc_id", "text_hash").distinct()
    order = Window.partitionBy("doc_id").orderBy("text_hash")  # the texts of one id
    variants = stored(texts.select("doc_id", "text_hash", (F.row_number().over(order) - 1).alias("v")), "variants")
    if variants.isEmpty():
        return docs.withColumn("v", F.lit(0))
    return hashed.join(small(variants), ["doc_id", "text_hash"], "left").select("doc_id", "text", F.coalesce("v", F.lit(0)).alias("v"))


def hot_spans(regions: DataFrame, parts: int) -> DataFrame:
    """Spans (doc_id, v, lo, hi) of the windows of hot anchors' regions (h, doc_id, v, start, region) that have an earlier copy."""
    place = ["doc_id", "v", "start"]
    left, found = regions.select("h", *place, "region", F.lit(-1).alias("at"), F.lit(GRAM).alias("gram")), None
    while True:  # the gram grows each time, to a whole window at last, of which there is one a key
        made = stored(left.mapInArrow(parted, "h long, r long, doc_id long, v int, start long, region binary, at int, gram int"), "parts")
        first = F.min(F.struct(*place, "region", "at", "gram")).alias("first")
        firsts = stored(made.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), first), "firsts")
        twice = firsts.filter("n > 1").select("h", "r", F.struct(*(F.col(f"first.{c}").alias(c) for c in place)).alias("first"))
        whole = made.join(small(twice), ["h", "r"]).filter(F.struct(*place) != F.col("first")).select("doc_id", "v", F.col("start").alias("lo"), (F.col("start") + F.length("region")).alias("hi"))
        sizes = stored(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        several = firsts.select("h", "first.*").join(small(sizes), "h")
        cold = several.filter(F.col("size") <= HOT).select("h", *place, "region").repartition(parts, "h").sortWithinPartitions("h", *place)
        here = whole.union(cold.mapInArrow(earlier_windows, "doc_id long, v int, lo long, hi long"))
        found = here if found is None else found.union(here)
        if sizes.filter(F.col("size") > HOT).isEmpty():
            return found
        left = several.filter(F.col("size") > HOT).select("h", *place, "region", "at", "gram")


def remove_repeats(docs: DataFrame) -> DataFrame:
    docs = keyed_documents(docs)
    known = numbered(docs.filter(F.col("doc_id").isNotNull()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "v"]
    deal = F.when(F.col("again"), F.xxhash64("doc_id", "start")).otherwise(F.col("h"))  # what its own chunk has settled goes anywhere
    sifted = stored(anchor_rows(known).repartition(parts, deal).sortWithinPartitions("h", "r", *key, "start").mapInArrow(sift, SIFTED), "regions")
    some = sifted.filter("NOT whole")
    hot = stored(some.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > HOT).select("h"), "hot")
    any_hot = not hot.isEmpty()
    wanted = some.groupBy(*key).agg(F.collect_list(F.struct("start", "n", "h")).alias("wanted"))
    bytes_ = known.join(wanted, key).select("doc_id", "text", "wanted", "v").mapInArrow(cut_regions, "h long, doc_id long, v int, start long, region binary")
    if any_hot:
        bytes_ = stored(bytes_, "region-bytes")
    cold = bytes_.join(small(hot), "h", "left_anti") if any_hot else bytes_
    spans = cold.repartition(parts, "h").sortWithinPartitions("h", *key, "start").mapInArrow(earlier_windows, "doc_id long, v int, lo long, hi long")
    if any_hot:
        spans = spans.union(hot_spans(bytes_.join(small(hot), "h", "left_semi"), parts))
    whole = sifted.filter("whole").select(*key, F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("hi"))
    spans = spans.union(whole).groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kept = known.join(spans, key, "left").select("doc_id", "text", "spans")
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"))
    return kept.union(nameless).mapInArrow(rewrite, SCHEMA)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
