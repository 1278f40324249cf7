"""Spectral operators, blocked filters, greedy union, stores and timed ingestion against brute force and known answers."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import filters as L
from waveloom.operators import intervals as I
from waveloom.operators import refine as R
from waveloom.operators import spectral as P
from waveloom.sources import store as S


# ---------------------------------------------------------------- spectra

def spectrum(spark, mags: dict[str, np.ndarray]):
    rows = [(key, f, k, float(v)) for key, m in mags.items() for f, row in enumerate(m) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "id string, f long, k int, mag double")


def brute_peaks(m: np.ndarray, size: int, most: int, silence: float) -> list[list[int]]:
    twice = np.full(m.shape[1], 2.0)
    twice[[0, -1]] = 1
    quiet = 20 * np.log10(np.sqrt((twice * m * m).sum(axis=1)) / size + 1e-12) < silence
    out = []
    for f, row in enumerate(m):
        beside = [m[g] for g in (f - 1, f + 1) if 0 <= g < len(m) and not quiet[g]]
        found = [] if quiet[f] else [k for k in range(1, len(row) - 1) if row[k] > row[k - 1] and row[k] >= row[k + 1] and all(row[k] >= b[k] for b in beside)]
        out.append(sorted(found, key=lambda k: (-row[k], k))[:most])
    return out


@pytest.mark.parametrize("block", [5, 1024])
def test_constellation_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "FRAMES", block)
    rng, size, silence = np.random.default_rng(3), 16, -10.0
    mags = {"a": np.round(rng.integers(0, 30, (40, 9)) / 3, 6), "b": np.round(rng.integers(0, 6, (21, 9)) / 2, 6), "c": np.ones((3, 9))}
    mags["a"][[7, 8, 20]] *= 0.01
    spec = spectrum(spark, mags)
    tops = spec.groupBy("id").agg(F.max("f").alias("top"))
    want = set()
    for key, m in mags.items():
        peaks, places = brute_peaks(m, size, 3, silence), defaultdict(list)
        for t in range(len(m) - 6):
            ahead = sorted((-m[t + d, peaks[t + d][0]], d, peaks[t + d][0]) for d in range(1, 7) if peaks[t + d])[:4]
            for a in sorted(peaks[t]):
                for _, d, b in sorted(ahead, key=lambda x: x[1]):
                    places[(int(a / 2 + 0.5) * 1024 + int(b / 2 + 0.5)) * 64 + d].append(t)
        want |= {(h, key, t, r) for h, ts in places.items() for r, t in enumerate(ts[:3])}
    got = P.constellation(P.local_peaks(spec, "id", size, 3, silence), tops, "id", 6, 4, 2, 3).collect()
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def brute_prominences(curve: list[int]) -> list[tuple[int, int, int]]:
    out, n = [], len(curve)
    for p in range(1, n - 1):
        if not (curve[p] > curve[p - 1] and curve[p] >= curve[p + 1]):
            continue
        a, b = p - 1, p + 1
        while a > 0 and curve[a] > curve[a - 1]:
            a -= 1
        while b < n - 1 and curve[b] > curve[b + 1]:
            b += 1
        left, right = curve[p] - curve[a], curve[p] - curve[b]
        out.append((p, min(left, right), p - a if left < right else b - p))
    return out


def test_prominences_walk_to_the_valleys(spark):
    rng = random.Random(6)
    given = [[0, 3, 3, 1], [0, 5, 5, 5, 0], [1, 1, 1], [3, 2, 1], [0, 2, 1, 2, 0], [5, 6, 7, 6, 5, 5, 9], [0, 1]]
    curves = given + [[rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(60)]
    df = spark.createDataFrame([(i, k, v) for i, c in enumerate(curves) for k, v in enumerate(c)], "id long, k int, n long")
    got = defaultdict(list)
    for r in P.prominences(df, ["id"], "k", "n").collect():
        got[r["id"]].append((r["k"], r["drop"], r["width"]))
    for i, c in enumerate(curves):
        assert sorted(got[i]) == brute_prominences(c), c


def test_activation_sums_the_steepest(spark):
    curve = [0, 4, 0, 0, 6, 3, 3, 8, 0, 1, 0]
    df = spark.createDataFrame([("a", 0, k, v) for k, v in enumerate(curve)] + [("a", 1, k, 2) for k in range(4)], "id string, block long, k int, n long")
    got = {r["block"]: r["value"] for r in P.activation(df, "id", 10, 2).collect()}
    best = sorted((d / w / 10 for _, d, w in brute_prominences(curve)), reverse=True)[:2]
    assert got[0] == pytest.approx(sum(best)) and got[1] == 0


def test_periodicity_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.sin(np.arange(60) * 2 * np.pi / 7), np.zeros(30), rng.normal(size=37)])
    starts = list(range(0, 127, 5))
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "id string, t long, x double")
    frames = spark.createDataFrame([("a", i, s) for i, s in enumerate(starts)], "id string, frame long, start long")
    got = {r["frame"]: r["value"] for r in P.periodicity(df, "id", frames, 20, range(3, 12)).collect()}
    for i, s in enumerate(starts):
        w = x[s: s + 20] - x[s: s + 20].mean() if s + 20 <= len(x) else np.zeros(20)
        r0 = (w * w).sum()
        assert got[i] == pytest.approx(max(0.0, max((w[:-g] * w[g:]).sum() / r0 for g in range(3, 12))) if r0 > 1e-12 else 0.0, abs=1e-9)
    assert got[0] > 0.6 and got[13] == 0


def test_chroma_folds_bins_to_classes(spark):
    rng, size, rate = np.random.default_rng(1), 64, 2000.0
    m = rng.random((30, size // 2 + 1))
    m[11] *= 1e-4
    weights = P.class_weights(size, rate)
    raw = np.zeros((30, 12))
    for k, c, w in weights:
        raw[:, c] += w * m[:, k]
    e = raw.sum(axis=1)
    moved = raw - raw.mean(axis=0)
    want = np.where((e < 0.02 * np.sort(e)[15])[:, None], 0, moved / np.linalg.norm(moved, axis=1, keepdims=True))
    got = P.chroma(spectrum(spark, {"a": m}), "id", weights).orderBy("t").collect()
    assert np.allclose([r["c"] for r in got], want) and not any(got[11]["c"])
    assert {k for k, *_ in weights} == {k for k in range(33) if 55 <= k * rate / size <= 4000}


def test_aac_configuration_bytes(spark):
    from waveloom.plans.media import aac_configs

    rows = spark.createDataFrame([(48000, 2), (44100, 2), (44100, 1), (8000, 1), (12345, 2)], "rate int, channels int")
    assert [tuple(r) for r in aac_configs(rows).collect()] == [(48000, 2, "1190", 2), (44100, 2, "1210", 2), (44100, 1, "1208", 2), (8000, 1, "1588", 2), (12345, 2, None, None)]


def test_intervals_of_fractions_meet_in_every_bucket(spark):
    a = spark.createDataFrame([("k", 59.5, 60.5), ("k", 10.0, 64.0)], "id string, s double, e double")
    b = spark.createDataFrame([("k", 60.2, 60.4), ("k", 64.0, 65.0)], "id string, s double, e double")
    assert I.overlap_pairs(a, b, "id", 60).count() == 2 and I.overlapping(a, b, "id", 60, keep=False).count() == 0


def test_passages_are_found_whatever_documents_hold_them(spark):
    """Passages in one in a hundred documents each: at least nine in ten are found in every document that holds them."""
    from waveloom.operators import consensus as C

    rng = random.Random(21)
    words = [a + b for a in "bdfgklmnprstvz" for b in ("a", "en", "ir", "o", "um", "ys")]
    prose = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    docs = {i: prose(150) for i in range(600)}
    planted = []
    for p in range(40):
        passage, members = prose(60), rng.sample(sorted(docs), 6)
        for m in members:
            at = rng.randrange(len(docs[m]))
            docs[m][at:at] = passage
        planted.append(members)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    marks = C.landmarks(df).cache()
    held = C.recurring(marks).cache()
    found = C.peaks(C.offset_votes(C.owner_votes(held)), others=True).select("a", "b").distinct().collect()
    linked = defaultdict(set)
    for r in found:
        linked[r["a"]].add(r["b"])
    hit = sum(len(set(members) & (linked[a] | {a})) for members in planted for a in [max(members, key=lambda m: len(set(members) & (linked[m] | {m})))])
    assert hit >= 0.9 * sum(map(len, planted))
    true = {(a, b) for members in planted for a in members for b in members}
    assert all((r["a"], r["b"]) in true for r in found)


# ---------------------------------------------------------------- filters

def test_blocked_filters_are_the_recursion(spark):
    rng = np.random.default_rng(7)
    banks = [[L.bandpass(100, 4.5, 1.2)], L.butterworth(100, 20), [L.lowpass(100, 0.2, 5.0)]]
    series = {"long": rng.normal(size=3001), "short": rng.normal(size=3), "block": rng.normal(size=16)}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)], "id string, t long, x double").repartition(5)
    got = defaultdict(dict)
    for r in L.filter_bank(df, "id", banks, block=8, fan=4).collect():  # five levels of runs for the longest
        got[r["id"], r["band"]][r["t"]] = r["y"]
    for key, x in series.items():
        for band, sections in enumerate(banks):
            y = x
            for section in sections:
                y = L.filter_block(y, section, np.zeros(4))
            assert np.allclose([got[key, band][t] for t in range(len(x))], y, atol=1e-9)


# ---------------------------------------------------------------- intervals

def brute_greedy(rows: list[tuple], kept: list[tuple] = ()) -> list[tuple]:
    out = []
    for s, e in sorted(rows):
        if e > s and all(e <= a or s >= b for a, b in [*kept, *out]):
            out.append((s, e))
    return out


def test_greedy_union_drops_overlaps_within_a_group(spark):
    rng = random.Random(11)
    spans = lambda n, most: list({(s, s + rng.randrange(1, most)) for s in (rng.randrange(400) for _ in range(n))})
    keys = {k: [spans(*z) for z in ((6, 30), (60, 40), (80, 9))] for k in "abc"}
    keys["chain"] = [[], [(2 * i, 2 * i + 3) for i in range(300)] + [(7, 7)], [(i, i + 1) for i in range(0, 700)]]
    df = lambda g: spark.createDataFrame([(k, s, e) for k, groups in keys.items() for s, e in groups[g]], "id string, s long, e long")
    one = defaultdict(list)
    for r in I.accepted(df(1), "id").collect():
        one[r["id"]].append((r["s"], r["e"]))
    assert all(sorted(one[k]) == brute_greedy(g[1]) for k, g in keys.items())
    both = defaultdict(list)
    for r in I.union_without_overlap([df(0), df(1), df(2)], "id", 16).collect():
        both[r["id"]].append((r["s"], r["e"]))
    for k, groups in keys.items():
        kept = list(groups[0])
        for g in groups[1:]:
            kept += brute_greedy(g, kept)
        assert sorted(both[k]) == sorted(kept), k


# ---------------------------------------------------------------- refinement

def test_boundary_rules_on_a_known_passage(spark):
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 12)))
    theme, ref = unit(60), unit(300)
    ref[100:160] = theme
    rows, estimates = [("r", t, v.tolist()) for t, v in enumerate(ref)], []
    for i in range(4):
        x = unit(260)
        x[50 + 7 * i: 110 + 7 * i] = theme
        rows += [(f"m{i}", t, v.tolist()) for t, v in enumerate(x)]
        estimates.append((f"m{i}", 52 + 7 * i, 108 + 7 * i, True))
    frames = spark.createDataFrame(rows, "id string, t long, v array<double>").cache()
    est = spark.createDataFrame(estimates, "id string, at long, until long, present boolean")
    for rule, slack in ((R.Rule(search=12, pad=20, threshold=0.7, least_run=10), 4), (R.Rule(search=12, pad=20, least_run=10, boundary="gradient", extent="member"), 3)):
        got = {r["id"]: r for r in R.refined(frames.filter("id = 'r'"), frames.filter("id <> 'r'"), est, 102, 158, 300, rule=rule).collect()}
        for i in range(4):
            r = got[f"m{i}"]
            assert r["refined"] and r["d"] == -50 + 7 * i and abs(r["start"] - (50 + 7 * i)) <= slack and abs(r["stop"] - (110 + 7 * i)) <= slack, (rule.boundary, r)
        assert got[None]["is_reference"]


# ---------------------------------------------------------------- stores

def tree(at) -> set[str]:
    return {os.path.relpath(os.path.join(d, f), at) for d, _, names in os.walk(at) for f in names if not f.startswith(".")}


def test_series_are_read_by_zones(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    df = spark.range(1000).select((F.col("id") % 10).alias("key"), F.floor(F.col("id") / 10).alias("t"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("x"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"))
    S.write_series(df, at, "key", "t", rows=50)
    whole = S.read_series(spark, at)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr) and whole.rdd.getNumPartitions() >= 20
    some = whole.filter("key = 3 AND t >= 20 AND t < 40")
    assert some.count() == 20 and some.rdd.getNumPartitions() <= 2
    assert whole.filter("key IN (2, 9) AND name = 'n1'").count() == df.filter("key IN (2, 9) AND name = 'n1'").count()
    assert whole.filter("key > 99").count() == 0 and whole.filter("x IS NULL").count() == df.filter("x IS NULL").count()
    S.write_series(df.filter("key = 0"), at, "key", "t")
    assert S.read_series(spark, at).count() == 1100
    S.write_series(df.filter("key = 1"), at, "key", "t", overwrite=True)
    assert S.read_series(spark, at).count() == 100 and len([f for f in tree(tmp_path / "s") if f.endswith(".parquet")]) >= 1
    with pytest.raises(Exception, match="another schema"):
        S.write_series(df.select("key"), at, "key")
    assert S.read_series(spark, at).count() == 100


def failing(spark, n: int = 20):
    return spark.range(n).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.expr("IF(id = 13, raise_error('lost'), CAST(id AS STRING))").alias("content"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/w"
    for write in (lambda: S.write_files(failing(spark), at), lambda: S.write_series(failing(spark), at)):
        with pytest.raises(Exception, match="lost"):
            write()
        assert not tree(tmp_path / "w")
    with pytest.raises(Exception, match="no committed series"):
        S.read_series(spark, at)


def test_files_refuse_to_overwrite(spark, tmp_path):
    at = f"file://{tmp_path}/f"
    rows = lambda *names: spark.createDataFrame([(n, n.encode() * 3) for n in names], "name string, content binary").repartition(3)
    S.write_files(rows("a.wav", "b.wav"), at)
    assert (tmp_path / "f" / "a.wav").read_bytes() == b"a.wav" * 3
    for bad, why in ((rows("c.wav", "b.wav"), "b.wav"), (rows("d.wav", "d.wav"), "d.wav"), (rows("e.wav", "../x"), "not a file name")):
        with pytest.raises(Exception, match=why):
            S.write_files(bad, at)
        assert tree(tmp_path / "f") == {"a.wav", "b.wav", "_committed.json"}
    S.write_files(spark.createDataFrame([("b.wav", "new"), ("c.tsv", "1\t2\n")], "name string, content string"), at, overwrite=True)
    assert (tmp_path / "f" / "b.wav").read_text() == "new" and tree(tmp_path / "f") == {"a.wav", "b.wav", "c.tsv", "_committed.json"}


def test_zones_keep_what_may_match():
    zone = {"t": [5, 9], "n": ["b", "d"], "gone": [None, None]}
    yes = [("t", "=", 5), ("t", ">", 8), ("t", "<=", 5), ("n", "in", ["a", "c"]), ("other", "=", 1)]
    no = [("t", "=", 4), ("t", ">", 9), ("t", "<", 5), ("t", ">=", 10), ("n", "in", ["a", "e"]), ("gone", ">", 0)]
    assert all(S.may_match(zone, [f]) for f in yes) and S.may_match(zone, yes) and not any(S.may_match(zone, [f]) for f in no)


# ---------------------------------------------------------------- timed ingestion

def streamed(spark, at, batches: list[list[tuple]], **options):
    from waveloom.streaming import episodes

    schema = "episode_id string, seq long, sample_rate double, x array<double>, at timestamp"
    episodes.with_state_store(spark)
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(e, s, r, x, sec) for e, s, r, x, sec in rows], "episode_id string, seq long, sample_rate double, x array<double>, sec long").withColumn("at", F.timestamp_seconds("sec")).drop("sec")
        made.coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        out = episodes.ingested(stream, lowpass=False, **options)
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    got = defaultdict(list)
    for r in spark.read.schema(episodes.OUTPUT).parquet(f"{at}/out").collect():
        got[r["episode_id"]].append((r["seq"], r["error"], r["y"]))
    return got


def test_episodes_close_by_mark_or_by_time(spark, tmp_path):
    x = [float(v) for v in range(40)]
    part = lambda k: x[10 * k: 10 * k + 10]
    got = streamed(spark, f"file://{tmp_path}/e", [
        [("whole", 1, 8000.0, part(1), 100), ("gap", 2, 8000.0, part(2), 100), ("gap", 0, 8000.0, part(0), 100), ("open", 0, 8000.0, part(0), 100)],
        [("whole", 0, 8000.0, part(0), 101), ("whole", 2, None, None, 101), ("gap", 2, 8000.0, part(2), 101), ("far", 0, 8000.0, part(0), 10_000)],
        [("far", 1, 8000.0, part(1), 10_001), ("gap", 3, 8000.0, part(3), 20_000), ("far", 2, None, None, 20_000)],
    ], patience_ms=1000, keep_ms=10**9)
    joined = lambda key: sum((y for _, e, y in sorted(got[key], key=lambda r: (r[0], r[1] or "")) if y), [])
    assert joined("whole") == x[:20] and all(e is None for _, e, _ in got["whole"])
    assert joined("gap") == part(0) + part(2)
    assert sorted(e for _, e, _ in got["gap"] if e) == ["after the end", "chunks missing at the end: 1 to 1", "twice"]
    assert joined("open") == part(0) and joined("far") == x[:20]


def test_waiting_chunks_are_bounded(spark, tmp_path):
    got = streamed(spark, f"file://{tmp_path}/b", [[("e", k, 8000.0, [float(k)], 5) for k in (9, 7, 5, 3)], [("e", 0, 8000.0, [0.0], 6), ("e", 10, None, None, 6)]], most_early=2, patience_ms=10**9)
    assert sorted(e for _, e, _ in got["e"] if e) == ["chunks given up: 0 to 2", "chunks given up: 4 to 4", "late or twice"]
