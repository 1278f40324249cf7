"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

1. One pass over the text: the set of 5-word shingles (64-bit hashes), its size
   and digest, and a sketch of ``BINS`` coordinates. Rounds of hashed bin
   placement fill the sketch: in round i < t an element goes to a hashed bin,
   in round t + j to bin j, and it stops after the round that leaves no bin
   empty, so every coordinate is filled and values compare across sets.
2. Equal sets are one node (a 64-bit digest of the set); only the text of its smallest document goes on.
3. Bands of ``ROWS`` coordinates are bucket keys. A bucket proposes only pairs
   with a centre, not all pairs: one of those members that meet most others over all their buckets, since a text with few edits
   is near to far more of its group than one with many; another one each round. Pairs are verified on full sets: 100 * common >= 75 * union.
4. Components are spread over verified links. Buckets that still hold two
   components get another centre, up to ``STAR_ROUNDS`` rounds; in the last one the documents left in
   such buckets are joined by prefix filter, which proposes every pair across components that can be similar
   enough, so no link inside a bucket is lost to the choice of centres. At
   similarity 0.75 a pair meets in no bucket with probability 2e-6.

Bucket tables are joined to their centres by broadcast up to ``BROADCAST_KEYS`` keys, so the members of a
bucket that many texts share stay where they are; beyond, by shuffle, where Spark splits skewed keys.

Nothing of document size passes the driver; classes, labels and sets are
written to the shared folder.

Defined cases: null text and text without words have an empty set, no link and
themselves as component; fewer than five words are one shingle; repeated rows share
class and component; several texts of one doc_id are classed each; a row without a doc_id links with nothing, has no
component_id and is kept; a very long text is one set in one task (about 40 times its size); documents that tie on a similarity are all linked; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import LOWER, U, chunks, keyed_documents, lists, mix, prefix_sums, slice_hash, stored, table, words
from waveloom.llm.graph import components

WINDOW = 5
PERCENT = 75
BINS, ROWS = 72, 3
STAR_ROUNDS = 3
BROADCAST_KEYS = 2_000_000  # bucket keys sent whole up to here, joined by shuffle above
HELPFUL = 0.05  # links found per open document below which another centre is not tried
_rng = np.random.Generator(np.random.PCG64(8))
_PLACE = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) * U(2) + U(1)
_ROUND = _rng.integers(1, 2**63, 2 * BINS, dtype=np.uint64)
_BAND = _rng.integers(1, 2**63, (BINS // ROWS, ROWS), dtype=np.uint64) * U(2) + U(1)
_SCRAMBLE = [int(x) for x in _rng.integers(1, 2**62, 64)]


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and their offsets."""
    raw = LOWER[raw]
    lo, hi, edges = words(raw, at)
    w = slice_hash(prefix_sums(raw), lo, hi) if len(lo) else np.zeros(0, np.uint64)
    full = np.zeros(max(0, len(w) - WINDOW + 1), np.uint64)
    for k in range(WINDOW):
        full += w[k: len(w) - WINDOW + 1 + k] * _PLACE[k]
    full = mix(full)
    parts, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b - a >= WINDOW:
            own = np.unique(full[a: b - WINDOW + 1])
        elif b > a:
            own = mix(np.array([(w[a:b] * _PLACE[: b - a]).sum() + U(b - a)], np.uint64))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketch(values: np.ndarray, at: np.ndarray, bins: int = BINS) -> np.ndarray:
    """texts x bins. The high byte and a bit hold the round, the rest the hash, so a lower round wins."""
    n = len(at) - 1
    out = np.full((n, bins), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    flat = out.reshape(-1)
    for i in range(2 * bins):
        if not len(values):
            break
        h = mix(values ^ _ROUND[i])
        place = (h % U(bins)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        np.minimum.at(flat, owner * bins + place, (h >> U(9)) | U(i << 55))
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_[owner].all():
            left = open_[owner]
            values, owner = values[left], owner[left]
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """texts x bands of bucket keys."""
    n, bins = sketches.shape
    parts = sketches.reshape(n, bins // ROWS, ROWS)
    return mix((parts * _BAND[: bins // ROWS]).sum(axis=2, dtype=np.uint64))


def node_of(n: np.ndarray, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One number for each set: equal sets, equal numbers."""
    out = n.astype(np.uint64)
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ salt), out=sums[1:])
        out = mix(out + (sums[edges[1:]] - sums[edges[:-1]]))
    return out.view(np.int64)


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, node of the set, keys. docs: doc_id, text, text_hash."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            values, edges = shingles(raw, at)
            keys = bands(sketch(values, edges))
            n = np.diff(edges)
            flat = keys[n > 0].reshape(-1).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node_of(n, values, edges)), lists(flat, offsets, pa.int64())], names=["doc_id", "text_hash", "n", "node", "keys"])

    return docs.mapInArrow(make, "doc_id long, text_hash long, n long, node long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, n, s: the set itself."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in chunks(batches):
            values, edges = shingles(raw, at)
            n = np.diff(edges)
            yield pa.record_batch([pa.array(node_of(n, values, edges)), pa.array(n, pa.int64()), lists(values.view(np.int64), edges, pa.int64())], names=["node", "n", "s"])

    return docs.mapInArrow(make, "node long, n long, s array<long>")


def small(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder, to be broadcast if it has at most BROADCAST_KEYS rows."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def centred(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's members with its centre, the first under the turn's scrambling of those in the highest class of popularity."""
    rank = F.struct(F.col("popular"), F.col("node").bitwiseXOR(F.lit(_SCRAMBLE[turn])).alias("scrambled"))
    centres = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(rank).alias("top")).filter("size > 1").select("key", F.col("top.scrambled").bitwiseXOR(F.lit(_SCRAMBLE[turn])).alias("centre"))
    pairs = buckets.join(small(centres, "centres"), "key").filter("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def with_popularity(buckets: DataFrame) -> DataFrame:
    """buckets (node, key, size) with popular: the class (powers of the square root of 2) of how many others a node meets, over all its buckets."""
    met = buckets.groupBy("node").agg(F.floor(2 * F.log2(F.sum(F.col("size") - 1).cast("double"))).alias("popular"))
    return buckets.join(small(met, "popularity"), "node").select("node", "key", "popular")


def by_prefix(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) across components that can reach the similarity. With the shingles of every set in one order,
    the rarest first, two sets that similar share one among their first n - ceil(percent n / 100) + 1, and from their first
    common one on both have enough shingles left. placed: node, component."""
    held = sets.join(placed, "node").select("node", "component", "n", F.explode("s").alias("x"))
    rare = held.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ordered = held.join(rare, "x").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("s"))
    length = (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).cast("int")
    prefix = stored(ordered.select("node", "component", "n", F.posexplode(F.slice("s", F.lit(1), length)).alias("i", "z")).filter("z.df > 1").select("node", "component", "n", "i", "z.x"), "prefixes")
    other = prefix.select("x", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    least = percent * (F.col("n") + F.col("nb"))  # common shingles that the pair needs, times 100 + percent
    enough = ((100 + percent) * (F.col("n") - F.col("i")) >= least) & ((100 + percent) * (F.col("nb") - F.col("ib")) >= least)
    near = (F.col("a") < F.col("b")) & (F.col("component") != F.col("cb")) & enough
    return prefix.withColumnRenamed("node", "a").join(other, "x").filter(near).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", "na", "nb", common.alias("common")).filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def classified(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: one row a row."""
    docs = keyed_documents(docs).withColumn("text_hash", F.xxhash64("text"))
    all_ = stored(summaries(docs), "summaries")
    first = stored(all_.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first")), "classes")
    texts = all_.join(first, (all_["node"] == first["node"]) & (all_["doc_id"] == first["first"]), "left_semi").dropDuplicates(["node"])
    members = texts.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(with_popularity(stored(members.join(small(shared, "keys"), "key"), "members")), "buckets")
    wanted = texts.join(buckets.select("node").distinct(), "node", "left_semi").select("doc_id", "text_hash")
    sets = stored(shingle_sets(docs.join(wanted, ["doc_id", "text_hash"], "left_semi")).dropDuplicates(["node"]), "sets")
    tested = stored(centred(buckets, 0), "pairs")
    links = stored(verified(tested, sets, percent), "links")
    label, found = components(links), None
    for turn in range(1, STAR_ROUNDS + 1):
        placed = buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high AND size > 2").select("key")
        open_ = stored(placed.join(small(mixed, "mixed"), "key"), "open")
        left = open_.agg(F.count_distinct("node").alias("n")).first()["n"]
        if not left:
            break
        last = turn == STAR_ROUNDS or (found is not None and found < HELPFUL * left)
        fresh = by_prefix(open_.select("node", "component").distinct(), sets, percent) if last else centred(open_.select("node", "key", "popular"), turn)
        fresh = stored(fresh.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = stored(verified(fresh, sets, percent), "links")
        if found := more.count():
            links = links.union(more)
            label = components(links)
        if last:
            break
        tested = tested.union(fresh)
    placed = first.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("class_id"))
    final = placed.join(lowest, "component").select("node", "class_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("class_id")), F.col("doc_id")))
    return (
        all_.select("doc_id", "text_hash", "n", "node").join(final, "node", "left")
        .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return classified(docs, percent).drop("text_hash")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each class; of rows that repeat whole one stays, and so do rows without a doc_id."""
    judged = stored(classified(docs, percent).filter("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("times")).filter("NOT kept OR times > 1"), "judged")
    judged = F.broadcast(judged) if judged.count() <= BROADCAST_KEYS else judged
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"))
    marked = rows.join(judged, ["doc_id", "text_hash"], "left").filter("kept IS NULL OR kept")
    once = marked.filter("times > 1").dropDuplicates(["doc_id", "text_hash"])
    return marked.filter("times IS NULL OR times = 1").select("row.*").union(once.select("row.*"))


#: The same rows by comparing all documents that share a shingle.
SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = id"""


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
