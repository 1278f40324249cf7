"""What the findings of round 4 named."""

from __future__ import annotations

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from waveloom.library import Library
from waveloom.llm import op4_pii_surrogates as q4
from waveloom.operators import landmarks as L
from waveloom.operators import refine as R


def session(master: str, app: str, key: str | None = None):
    """What ``key_of`` asks of a session."""
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: key or other), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_a_cluster_without_a_key_draws_one_of_its_own():
    one, again, other = (q4.key_of(session("spark://driver:7077", app)) for app in ("app-1", "app-1", "app-2"))
    assert one == again != other and q4.STAND_IN not in (one, other) and min(len(one), len(other)) == 64
    assert q4.key_of(session("spark://driver:7077", "app-1", "given")) == "given" and q4.key_of(session("local[4]", "app-3")) == q4.STAND_IN


def test_entities_without_room_get_longer_surrogates(spark, monkeypatch):
    monkeypatch.setattr(q4, "ROOM", 1)
    full = [f"{a:x}::{b:x}" for a in range(16) for b in range(16) if any(c.isdigit() for c in f"{a:x}{b:x}")]  # 220 of 256 values of that form
    values = [*full, "token=......", "token=------", "secret: ______"]
    rows = q4.surrogates(spark.createDataFrame([(x,) for x in values], "value string"), "k").collect()
    made = {r["value"]: r["surrogate"] for r in rows}
    assert len(made) == len(set(made.values())) == len(values) and not set(made.values()) & set(values)
    assert all(re.fullmatch(r"[0-9a-f]{1,4}::[0-9a-f]{1,4}", made[v]) for v in full) and all(made[v].startswith(v) for v in values[220:223])


def test_a_host_of_very_many_labels(spark):
    text = "write to a.b@" + "bc." * 60_000 + "com today"
    out = q4.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").collect()
    assert out[0]["n_entities"] == 1 and "a.b@" not in out[0]["text"] and out[0]["text"].endswith(" today")


def test_refinement_makes_the_frames_of_its_windows_alone(spark):
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 12)))
    held = {k: unit(n) for k, n in ((0, 300), (1, 900), (2, 900), (3, 900), (4, 900))}
    for k, at in ((1, 3), (2, 500), (3, 838)):
        held[k][at: at + 60] = held[0][100:160]
    frames = spark.createDataFrame([(k, t, x.tolist()) for k, v in held.items() for t, x in enumerate(v)], "id long, t long, v array<double>")
    estimates = spark.createDataFrame([(1, 5, 65, True), (2, 498, 560, True), (3, 840, 900, True), (4, 70, 130, False)], "id long, at long, until long, present boolean")
    rule, made = R.Rule(search=12, pad=20, threshold=0.7, least_run=10), []

    def near(windows):
        made.append(frames.join(windows, "id").filter("t >= lo AND t < hi").select("id", "t", "v"))
        return made[-1]

    lengths = frames.groupBy(F.col("id").alias("doc_id")).count().withColumnRenamed("count", "n")
    whole, cut = Library(None, lengths, frames), Library(None, lengths, near=near)
    want, got = (sorted(map(tuple, x.refine(0, estimates, 100, 160, rule).collect()), key=repr) for x in (whole, cut))
    assert want == got and sum(r[1] for r in got) == 4
    assert [sorted((r["id"], r["count"]) for r in x.groupBy("id").count().collect()) for x in made] == [[(0, 100)], [(1, 60 + 20 + 12 + 5), (2, 60 + 40 + 24), (3, 20 + 12 + 60)]]


def test_rows_are_ordered_by_all_keys_in_one_number():
    rng = np.random.default_rng(4)
    for keys in ([rng.integers(0, 9, 500), rng.integers(-5, 5, 500), rng.integers(0, 3, 500)], [rng.integers(-(1 << 40), 1 << 40, 500) // (1 << 36), rng.integers(0, 1 << 45, 500), rng.integers(0, 7, 500)],
                 [rng.integers(0, 4, 500), rng.integers(-(1 << 62), 1 << 62, 500), rng.integers(0, 2, 500), rng.integers(-(1 << 62), 1 << 62, 500)], [np.zeros(0, np.int64)] * 2):
        got, want = L.order_of(*keys), np.lexsort(keys[::-1])
        assert sorted(got) == list(range(len(keys[0]))) and all((x[got] == x[want]).all() for x in keys)


def test_votes_against_owners_match_brute_force():
    rng = np.random.default_rng(6)
    ids, sizes = rng.permutation(1000)[:30], rng.integers(300, 310, 30)
    at = rng.permutation(30 * 300)[:4000]
    doc, place, x = at // 300, at % 300, rng.integers(0, 300, 4000).astype(np.uint64)
    order = np.lexsort((place, doc, x))
    doc, place, x = doc[order], 4 * place[order] + (x[order] % np.uint64(4)).astype(np.int64), x[order]
    want = set()
    for h in range(300):
        held = [(int(d), int(p)) for y, d, p in zip(x, doc, place) if y == h]
        owner = min({d for d, _ in held}, key=lambda d: (-sizes[d], ids[d]))
        mine = [p for d, p in held if d == owner]
        for d in {d for d, _ in held} - {owner}:
            bins: dict[int, int] = {}
            for q in (q for e, q in held if e == d):
                for p in mine:
                    bins[p // 4 - q // 4] = min(p // 4, bins.get(p // 4 - q // 4, p // 4))
            want |= {(ids[d], ids[owner], delta, ta, mine[0] - 4 * ta) for delta, ta in bins.items()}
    cast = L.cast(x, ids, sizes, doc, place)
    rows = list(zip(*(y.tolist() for y in cast)))
    assert len(rows) == len(want) > 2000 and set(rows) == want
    for bins in (False, True):
        assert sorted(zip(*(y.tolist() for y in L.unpacked_votes(L.packed_votes(cast[0] % 3, *cast, bins=bins))))) == sorted(rows)


def test_tokens_are_hashed_where_they_stand(monkeypatch):
    texts = ["", " ", "a", " a  b ", "żółw i 王 and\nmore\ttext", "x" * 300, "one two " * 40, "", "end"]
    for k, block in enumerate((L.BLOCK, 7, 64)):
        monkeypatch.setattr(L, "BLOCK", block)
        for part in (texts, texts[3:], texts[:1], []):
            for kind in (pa.string(), pa.large_string()):
                held = pa.array(["before it", *part, "after"], kind).slice(1, len(part))
                h, size = L.tokens_of(held)
                words = [w for x in part for w in x.split(" ")]
                assert size.tolist() == [len(x.split(" ")) for x in part] and (h == (L.token_hashes(pa.array(words, pa.string())) if words else h)).all() and len(h) == len(words), (k, part)
