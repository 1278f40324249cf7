"""Exact duplicates, the prefix trie and centroid clustering against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from waveloom.llm import hot, op11_exact_dedup as q11, op12_prefix_trie as q12, op13_centroid_clustering as q13  # noqa: E402

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ 11

def rows_11():
    rng = random.Random(5)
    same_head = "x" * 64
    rows = [(i, t, g) for i, t, g in edge.ROWS]
    rows += [(100, same_head + "a", "en"), (101, same_head + "b", "en"), (102, same_head + "A", "en"), (103, "É" + same_head, "fr"), (104, "é" + same_head, "fr"), (105, "ẞTRASSE İI", "de"), (106, "ẞtrasse İi", "de")]
    rows += [(200 + i, f"hot Text {'abc' * 50}", "en") for i in range(300)] + [(600 + i, edge.prose(rng.randrange(4), 5), "en") for i in range(40)]
    rows += [(None, "no id", "en"), (None, "NO ID", "en"), (700, "No Id", "en"), (None, "alone without id", "en"), (None, "Twice without id", "en"), (None, "twice without id", "en")]
    rows += [(800, "y" * 2_000_000, "en"), (801, "Y" * 2_000_000, "en"), (802, "y" * 1_999_999 + "z", "en")]
    return rows


@pytest.mark.parametrize("prefix", [64, 1])
def test_exact_groups_match_brute_force(spark, prefix):
    rows = rows_11()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = q11.exact_groups(edge.documents(spark, rows), prefix=prefix, digest_all=True).collect()
    assert len(got) == len(rows)
    by_digest = defaultdict(list)
    for r in got:
        by_digest[r["digest"]].append(r)
    for text, ids in groups.items():
        found = by_digest.pop(sha(text))
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted((r["doc_id"] for r in found), key=repr) == sorted(ids, key=repr)
        assert {(r["keep_id"], r["group_size"], r["n_bytes"]) for r in found} == {(keep, len(ids), len(text.encode()))}
        assert [r["doc_id"] for r in found if r["kept"]] == [keep]
    assert not by_digest


def test_exact_groups_read_whole_texts_of_survivors_alone(spark):
    got = {r["doc_id"]: r["digest"] for r in q11.exact_groups(edge.documents(spark, [(1, "one", None), (2, "four", None), (3, "FOUR", None), (4, "five5", None), (5, "5evif", None)])).collect()}
    assert got == {1: None, 2: sha("four"), 3: sha("four"), 4: None, 5: None}
    assert q11.exact_groups(edge.documents(spark, [])).count() == 0


def test_filter_has_no_false_no(spark):
    keys = spark.range(0, 5000).select((F.col("id") * 7 - 9000).alias("x"))
    known = hot.bitmaps(keys, F.col("x"))
    got = hot.perhaps(spark.range(-9000, 26000).select(F.col("id").alias("x")), F.col("x"), known, "hit")
    assert got.columns == ["x", "hit"] and got.join(keys, "x").filter("NOT hit").count() == 0 and got.filter("hit").count() < 5100


def test_lookup_splits_common_keys(spark, monkeypatch):
    monkeypatch.setattr(hot, "MOST_HOT", 4)
    rows = spark.createDataFrame([(1, i) for i in range(90)] + [(k, k) for k in range(2, 12)], "k long, v long")
    known = rows.groupBy("k").count().withColumn("name", F.concat(F.lit("n"), "k")).filter("k <> 5")
    got = hot.looked_up(rows, known, ["k"], "count", 100).collect()
    assert len(got) == 100 and all(r["name"] == (f"n{r['k']}" if r["k"] != 5 else None) for r in got)


# ------------------------------------------------------------------ 12

def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        turns.sort()
        h = zlib.crc32(str(c).encode()) % 4
        base = sorted(own.get(c - c % 20, []))
        paths[c] = tuple(x[2:] for x in base[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = {}
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        saved = sum((len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n in below)
        leaves = sum(1 for n in below if not any(len(x) == len(n) + 1 and x[: len(n)] == n for x in below))
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out[min(cs), len(node)] = (min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, sha(ends))
    return out


def check_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "words": F.lit(1), "depth": F.lit(2)})
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in q12.prefix_trie(df.repartition(5)).collect()}
    want = trie(rows)
    assert got == want


def test_trie_matches_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for c in range(0, 130):
        if c in (20, 41, 60):
            continue  # absent bases and a gap
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\tc", "", None, "long " * 50])))
    rows += [(7, None, "system", "first"), (None, 1, "user", "no conversation"), (40, 0, "user", "a b"), (40, 0, "user", "a b")]
    check_trie(spark, rows)


def test_trie_of_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(q12, "ENDS", 7)
    rows = [(1000, t, "user", f"turn {t % 5}") for t in range(600)] + [(c, 0, "user", "same") for c in range(2000, 2150)] + [(c, t, "user", f"turn {t % 5}") for c in (1001, 1002) for t in range(300)]
    check_trie(spark, rows)


def test_trie_edges(spark):
    check_trie(spark, [])
    check_trie(spark, [(5, 0, None, None)])
    check_trie(spark, [(c, 0, "user", "x") for c in range(1, 9)])


# ------------------------------------------------------------------ 13

def kmeans(rows, k=40, rounds=5):
    x = [(i, [max(-2**27, min(2**27, math.floor(256 * float(np.float32(v))))) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    c = [q for _, q in sorted(((sha(f"2:{i}"), q) for i, q in x if i is not None))[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        to = [near(q)[1] for _, q in x]
        for j in range(len(c)):
            own = [q for (_, q), t in zip(x, to) if t == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *near(q)[::-1]) for i, q in x]
    per = defaultdict(int)
    for _, j, d in found:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), sha(",".join(map(str, c[j])))) for i, j, d in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit(1), "q": F.lit("x"), "label": F.lit(None).cast("int")})


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(rng.integers(3), 0.3 + 0.1 * (np.arange(64) % 7))]) for i in range(150)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [float("nan")]), (504, [1.0] * 63 + [float("inf")]), (505, [1.0] * 63 + [None])]
    rows += [(600 + i, rows[5][1]) for i in range(60)] + [(700, [3e38] * 64), (701, [-3e38] + [0.0] * 63)]
    got = sorted(map(tuple, q13.clustered(vectors(spark, rows).repartition(4)).drop("centroid").collect()), key=repr)
    assert got == kmeans(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [i / 10] * 64) for i in range(5)]
    assert sorted(map(tuple, q13.clustered(vectors(spark, rows)).drop("centroid").collect()), key=repr) == kmeans(rows)
    none = q13.clustered(vectors(spark, []))
    assert none.count() == 0 and none.columns[:2] == ["vec_id", "cluster"]
    assert [r["cluster"] for r in q13.clustered(vectors(spark, [(None, [0.0] * 64)])).collect()] == [None]


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(8)
    x, c = rng.integers(-5, 6, (700, 64)), rng.integers(-5, 6, (40, 64))
    c[7] = c[3]
    whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for step in (1, 16, 64):
        to, d = q13.nearest(x, c, rng.permutation(64), step)
        assert (to == whole.argmin(axis=1)).all() and (d == whole.min(axis=1)).all()
