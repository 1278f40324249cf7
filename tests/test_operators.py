"""Operators on small fixtures with known answers, and properties."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waveloom.functions import dsp, synth
from waveloom.operators import consensus as C
from waveloom.operators import filters as L
from waveloom.operators import intervals as I
from waveloom.operators import orders as O
from waveloom.operators import segments as S
from waveloom.operators import windows as W
from waveloom.plans import signals
from waveloom.sources import containers as M
from waveloom.streaming.ingest import Resampler


def spans(spark, rows):
    return spark.createDataFrame([("a", s, e) for s, e in rows], "k string, s long, e long")


def pairs(df):
    return sorted((r["s"], r["e"]) for r in df.collect())


def test_ranges_merge_and_touch(spark):
    assert pairs(I.coalesce(spans(spark, [(10, 20), (5, 8), (18, 25)]), "k")) == [(5, 8), (10, 25)]
    assert pairs(I.coalesce(spans(spark, [(5, 5), (7, 3), (1, 2)]), "k")) == [(1, 2)]
    assert pairs(I.coalesce(spans(spark, [(1, 2), (2, 3)]), "k")) == [(1, 3)]


def test_complement(spark):
    whole = spark.createDataFrame([("a", 0, 30), ("b", 0, 5)], "k string, lo long, hi long")
    left = I.complement(spans(spark, [(0, 4), (10, 20), (28, 40)]), whole, "k")
    assert sorted(map(tuple, left.collect())) == [("a", 4, 10), ("a", 20, 28), ("b", 0, 5)]


def test_overlap_is_strict(spark):
    a, b = spans(spark, [(0, 10), (20, 30)]), spans(spark, [(10, 20), (29, 31)])
    assert pairs(I.overlapping(a, b, "k", 7)) == [(20, 30)]
    assert pairs(I.overlapping(a, b, "k", 7, keep=False)) == [(0, 10)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), max_size=12), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), max_size=12))
def test_overlap_pairs_match_brute_force(spark, a, b):
    a, b = sorted({(s, s + n) for s, n in a if n}), sorted({(s, s + n) for s, n in b if n})
    got = I.overlap_pairs(spans(spark, a), spans(spark, b), "k", 13).select("s", "e", "o_s", "o_e").collect()
    assert sorted(map(tuple, got)) == sorted((s, e, u, v) for s, e in a for u, v in b if s < v and u < e)


def test_edges_are_repeated(spark):
    df = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate([9, 1, 1, 1, 5])], "k string, t long, x double")
    assert [r["m"] for r in W.edge_mean(df, "k", "x", 1).orderBy("t").collect()] == pytest.approx([19 / 3, 11 / 3, 1, 7 / 3, 11 / 3])
    assert [r["m"] for r in W.edge_median(df, "k", "x", 1).orderBy("t").collect()] == [9, 1, 1, 1, 5]


def test_robust_span_ignores_a_stray(spark):
    df = spark.createDataFrame([("a", t) for t in [0, 100, 101, 102, 103, 104, 105, 106]], "k string, t long")
    row = C.robust_span(df, ["k"], "t").first()
    assert (row["start"], row["end"], row["n"]) == (100, 105, 8)


def test_ranks_match_sorting(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.integers(0, 50, 500)] + [("b", 1.0)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r["k"]: (r["lo"], r["mid"]) for r in O.ranks(df, "k", "x", {"lo": lambda n: n * 0, "mid": lambda n: F.floor(n / 2)}).collect()}
    a = sorted(x for k, x in data if k == "a")
    assert got == {"a": (a[0], a[250]), "b": (1.0, 1.0)}


def test_step_series_gives_its_two_segments(spark):
    n, fps = int(60 * S.FPS), S.FPS
    score = np.full(n, 0.1)
    score[int(10 * fps): int(20 * fps)] = score[int(40 * fps): int(50 * fps)] = 0.9
    df = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(score)], "id string, t long, score double")
    found = S.segments(df, 0.5, 0.0, spark.createDataFrame([("a", 60.0)], "id string, duration double")).orderBy("s").collect()
    assert [(round(r["s"]), round(r["e"])) for r in found] == [(10, 20), (40, 50)]


def test_long_segment_is_dropped(spark):
    score = np.where((np.arange(6000) >= 600) & (np.arange(6000) < 3800), 1.0, -1.0)
    df = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(score)], "id string, t long, score double")
    assert S.segments(df, 0.0, 0.0, spark.createDataFrame([("a", 6000 / S.FPS)], "id string, duration double")).count() == 0


def theme_at(e: int) -> float:
    return 18.0 + 5.5 * (e * 3 % 5)


def test_planted_theme_lines_up(spark):
    """Every episode against the four references."""
    rows = signals.theme_peaks(spark).collect()
    assert len(rows) == 4 * 5
    for r in rows:
        assert abs(r["delta"] / S.FPS - (theme_at(r["a"]) - theme_at(r["b"]))) < 0.1
        assert abs(r["a_from"] / S.FPS - theme_at(r["a"])) < 3 and abs(r["b_from"] / S.FPS - theme_at(r["b"])) < 3


def test_music_is_found_at_the_theme(spark):
    found = {r["id"]: r for r in signals.music_segments(spark).collect()}
    for e in range(6):
        r = found[f"e{e}"]
        assert abs(r["s"] - theme_at(e)) < 1.5 and abs(r["e"] - theme_at(e) - 12) < 1.5


def test_spectra_match_direct_transform():
    x = synth.tune(0.2)
    mag = dsp.spectra(x, 256, 128)
    k, n = np.arange(129)[:, None], np.arange(256)
    direct = np.abs((np.exp(-2j * np.pi * k * n / 256) * (x[:256] * dsp.hann(256))).sum(axis=1))
    assert np.allclose(mag[0], direct, atol=1e-6)


def test_silence_has_no_landmarks_and_no_activation():
    assert len(dsp.landmarks(np.zeros(80_000))[0]) == 0
    assert np.allclose(dsp.activation(np.zeros(80_000))[1], 0)


def test_chroma_is_unit_or_zero():
    length = np.linalg.norm(dsp.chroma(synth.tune(5)), axis=1)
    assert np.all((np.abs(length - 1) < 1e-9) | (length == 0))


def test_chunked_resampling_equals_whole():
    x = np.sin(2 * np.pi * 1000 * np.arange(48_000) / 48_000)
    whole = Resampler(48_000).process(x)
    parts = Resampler(48_000)
    chunked = np.concatenate([parts.process(x[a: a + 4096]) for a in range(0, len(x), 4096)])
    assert len(whole) == len(chunked) and np.allclose(whole, chunked, atol=1e-9)
    assert abs(np.count_nonzero(np.diff(np.sign(whole))) / 2 - 1000) < 60


def test_filter_matches_the_series_operator(spark):
    rng = np.random.default_rng(1)
    x, section = rng.standard_normal(200), L.bandpass(100, 4.5, 1.2)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "k string, t long, x double")
    got = [r["y"] for r in L.filtered(df, "k", [section]).orderBy("t").collect()]
    assert np.allclose(got, L.filter_block(x, section, np.zeros(4)))


def test_cut_is_lossless(spark):
    x = np.linspace(-0.9, 0.9, 8000)
    files = spark.createDataFrame([("a.wav", M.wav_bytes(x, 8000))], "path string, content binary")
    head = M.pcm(files)
    cut = M.cut_pcm(head, spark.createDataFrame([("a.wav", 0.25, 0.5), ("a.wav", 0.4, 0.75)], "path string, s double, e double")).first()
    data = M.wav_bytes(x, 8000)[44:]
    assert bytes(cut["content"])[44:] == data[:4000] + data[12000:]
    assert (cut["removed_s"], cut["output_s"], cut["extension"]) == (0.5, 0.5, "wav")


def test_decoding_gives_the_samples(spark):
    x = np.linspace(-0.5, 0.5, 1000)
    files = spark.createDataFrame([("a.wav", M.wav_bytes(x, 8000))], "path string, content binary")
    got = np.concatenate([r["x"] for r in M.decoded(M.pcm(files), block=300).orderBy("seq").collect()])
    assert np.allclose(got, x, atol=1e-4)


def test_decoding_of_other_samples_and_refusals(spark):
    import struct

    def wav(tag, bits, data):
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, tag, 1, 8000, 8000 * bits // 8, bits // 8, bits, b"data", len(data))
        return head + data

    values = [0.0, 0.5, -0.5, -1.0]
    files = {
        "a8": wav(1, 8, bytes(int(v * 128) + 128 for v in values)), "b24": wav(1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in values)),
        "c32": wav(1, 32, struct.pack("<4i", *(int(v * 2**31) for v in values))), "df": wav(3, 32, struct.pack("<4f", *values)), "e64": wav(3, 64, struct.pack("<4d", *values))}
    head = M.pcm(spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content binary"))
    got = {r["path"]: r for r in M.decoded(head).collect()}
    assert all(got[k]["x"] == values and got[k]["error"] is None for k in ("a8", "b24", "c32", "df"))
    assert got["e64"]["x"] is None and got["e64"]["error"] == "64-bit float samples are not decoded"
    cut = M.cut_pcm(head, spark.createDataFrame([("a8", 0.0, 9.0)], "path string, s double, e double")).collect()
    refused = {r["path"]: (r["content"] is None, r["refusal"]) for r in cut}
    assert refused.pop("a8") == (True, "every sample would be removed") and set(refused.values()) == {(False, None)}


def test_ingestion_goes_on_after_errors_and_ends():
    import pandas as pd

    from waveloom.streaming import ingest

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

    state, x = State(), np.linspace(0, 1, 12_001)
    rows = lambda *chunks: iter([pd.DataFrame([("e", k, float(r), v) for k, r, v in chunks], columns=["episode_id", "seq", "sample_rate", "x"])])
    first = next(ingest.resample_chunks(("e",), rows((1, 12000, x[5000:9000]), (0, 12000, x[:5000]), (2, 44100, x[:10])), state, False))
    assert first["error"].tolist()[:2] == [None, None] and first["error"][2] == "rate 44100 instead of 12000"
    last = next(ingest.resample_chunks(("e",), rows((4, 12000, x[9000:]), (5, 12000, None)), state, False))
    assert last["error"].tolist()[-1] == "chunks missing: [3]" and not state.exists
    y = np.concatenate([v for v in [*first["y"], *last["y"]] if v is not None])
    assert np.allclose(y, np.interp(np.arange(8001) * 1.5, np.arange(12001), x)) and len(y) == 8001


def test_aiff_header(spark):
    import struct

    comm = struct.pack(">4sIhIh", b"COMM", 18, 1, 4, 16) + bytes.fromhex("400EAC44000000000000")
    ssnd = struct.pack(">4sIII", b"SSND", 16, 0, 0) + struct.pack(">4h", 1, -1, 2, -2)
    body = b"AIFF" + comm + ssnd
    files = spark.createDataFrame([("a.aiff", b"FORM" + struct.pack(">I", len(body)) + body)], "path string, content binary")
    row = M.pcm(files).first()
    assert (row["container"], row["rate"], row["channels"], row["bits"], row["frames"]) == ("aiff", 44100, 1, 16, 4)
    assert [round(v * 32768) for v in M.decoded(M.pcm(files)).first()["x"]] == [1, -1, 2, -2]


def test_mp3_frames_and_mp4_boxes(spark):
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(413)
    files = spark.createDataFrame([("a.mp3", b"ID3" + bytes([4, 0, 0, 0, 0, 0, 5]) + bytes(5) + frame * 3 + b"TAG" + bytes(125))], "path string, content binary")
    rows = M.mp3_frames(files).orderBy("idx").collect()
    assert [(r["offset"], r["size"]) for r in rows] == [(15, 417), (432, 417), (849, 417)]
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    mp4 = spark.createDataFrame([("a.m4a", box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", bytes(8)) + box(b"trak", b"")))], "path string, content binary")
    assert [r["path"] for r in M.mp4_boxes(mp4).orderBy("offset").collect()] == ["ftyp", "moov", "moov/mvhd", "moov/trak"]


def test_episode_ids(spark):
    rows = spark.createDataFrame([("/x/Show.s01e02.title.mkv",), ("/x/other.m4a",)], "p string").select(M.episode_id(F.col("p")).alias("i")).collect()
    assert [r["i"] for r in rows] == ["S01E02", "other"]


def flac_frame(number: int, payload: bytes) -> bytes:
    head = bytes([0xFF, 0xF8, 0xC9, 0x08, number])  # 4096 samples, 44.1 kHz, mono, 16 bits
    crc = 0
    for b in head:
        crc ^= b
        for _ in range(8):
            crc = ((crc << 1) ^ 7 if crc & 128 else crc << 1) & 255
    return head + bytes([crc]) + payload


def test_flac_frames_and_cut(spark):
    info = bytes([16, 0, 16, 0, 0, 0, 0, 0, 0, 0]) + (44100 << 12 | 0 << 9 | 15 << 4).to_bytes(4, "big") + (4 * 4096).to_bytes(4, "big") + b"m" * 16
    head = b"fLaC" + bytes([128]) + len(info).to_bytes(3, "big") + info
    frames = [flac_frame(k, bytes([k + 1]) * 50) for k in range(4)]
    files = spark.createDataFrame([("a.flac", head + b"".join(frames))], "path string, content binary")
    rows = M.flac_frames(files)
    assert [(r["offset"], r["size"], r["samples"], r["rate"]) for r in rows.orderBy("idx").collect()] == [(42 + 56 * k, 56, 4096, 44100) for k in range(4)]
    cut = M.cut_frames(files, rows, spark.createDataFrame([("a.flac", 0.1, 0.15)], "path string, s double, e double")).first()
    content = bytes(cut["content"])
    assert content[42:] == frames[0] + frames[2] + frames[3] and cut["total"] == 3 * 4096
    assert int.from_bytes(content[21:26], "big") & (2**36 - 1) == 3 * 4096 and content[26:42] == bytes(16) and content[:21] == head[:21]


def test_mp3_cut_keeps_tags(spark):
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(413)
    files = spark.createDataFrame([("a.mp3", b"ID3" + bytes([4, 0, 0, 0, 0, 0, 5]) + b"hello" + frame * 100)], "path string, content binary")
    cut = M.cut_frames(files, M.mp3_frames(files), spark.createDataFrame([("a.mp3", 1.0, 2.0)], "path string, s double, e double")).first()
    assert bytes(cut["content"])[:15] == b"ID3" + bytes([4, 0, 0, 0, 0, 0, 5]) + b"hello"
    assert cut["kept_frames"] == 100 - 39  # frames of 26.1 ms that touch one second


def test_mp4_sample_table(spark):
    box = lambda kind, *parts: (8 + sum(map(len, parts))).to_bytes(4, "big") + kind + b"".join(parts)
    u = lambda *xs: b"".join(x.to_bytes(4, "big") for x in xs)
    table = box(b"stbl", box(b"stsd", u(0, 1, 16), b"mp4a", bytes(4)), box(b"stts", u(0, 2, 2, 1024, 1, 512)), box(b"stsc", u(0, 1, 1, 2, 1)), box(b"stsz", u(0, 0, 3, 10, 20, 30)), box(b"stco", u(0, 2, 1000, 2000)))
    trak = box(b"trak", box(b"mdia", box(b"mdhd", u(0, 0, 0, 44100, 2560)), box(b"hdlr", u(0, 0), b"soun", bytes(12)), box(b"minf", table)))
    files = spark.createDataFrame([("a.m4a", box(b"ftyp", b"M4A ") + box(b"moov", trak))], "path string, content binary")
    rows = [(r["offset"], r["size"], r["ts"], r["duration"], r["timescale"], r["codec"]) for r in M.mp4_samples(files).orderBy("idx").collect()]
    assert rows == [(1000, 10, 0, 1024, 44100, "mp4a"), (1010, 20, 1024, 1024, 44100, "mp4a"), (2000, 30, 2048, 512, 44100, "mp4a")]


def test_passages_in_half_of_all_documents_are_found(spark):
    import random

    rng = random.Random(5)
    rare = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    word = lambda: rng.choice("of the and to in is it".split()) if rng.random() < 0.5 else rare()
    passage = [rare() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(130 + i)] + (passage if i % 2 else []) + [word() for _ in range(160 - i % 20)])) for i in range(60)]
    held = C.recurring(C.landmarks(spark.createDataFrame(rows, "doc_id long, text string"))).cache()
    assert held.agg(F.max("df")).first()[0] >= 30
    refs = C.references(held)
    assert 1 <= len(refs) <= C.TRIALS and refs[0] % 2 == 1
    bins = C.votes_of(held, refs).cache()
    found = C.merged(bins, C.suppressed(C.top_peaks(C.peaks(C.offset_votes(bins)))))
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    planted = {(a, b) for a in refs if a % 2 for b in range(1, 60, 2) if b != a}
    assert planted <= pairs and len(pairs - planted) < 10  # common words line up by chance now and then
    lengths = spark.createDataFrame([(i, len(t.split(" "))) for i, t in rows], "doc_id long, n int")
    best = C.ranked_assets(C.best_reference(C.assets(C.members(found), lengths, 60), refs)).collect()
    assert best[0]["support"] == 30 and 30 <= best[0]["span"] <= 42 and best[0]["ref_from"] >= 130 + best[0]["a"] - 2


def test_two_exemplars_keep_one_row_a_frame(spark):
    from waveloom.operators import segments as S

    frames = spark.createDataFrame([("x", t, float(t % 5)) for t in range(40)], "id string, t long, level double")
    held = S.marked(frames, spark.createDataFrame([("x", 0.0, 1.0), ("x", 2.0, 2.5), ("x", 0.5, 1.0)], "id string, s double, e double"), 10.0)
    assert held.count() == 40 and held.filter("positive").count() == 15


def test_library_of_documents(spark):
    from waveloom.library import Library

    words = [f"w{k}" for k in range(400)]
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(i, " ".join(words[i * 7 % 50: i * 7 % 50 + 120]) + " " + passage + " " + " ".join(words[100 + i: 220])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lengths = spark.createDataFrame([(i, len(t.split(" "))) for i, t in rows], "doc_id long, n int")
    half = lambda keep: Library(C.landmarks(docs.filter(keep)), lengths.filter(keep))
    whole = half("doc_id < 6").add(half("doc_id >= 6"))
    found = whole.discover(most=2, hint=[4]).collect()
    assert found and found[0]["rank"] == 1 and found[0]["support"] >= 3 and found[0]["a"] in {i for i, _ in rows}
