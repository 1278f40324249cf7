"""What the findings of round three showed: small tables on which the queries differed from their SQL or grew too fast."""

from __future__ import annotations

import duckdb
import pytest
from compare import compare, sf

import __spark_entry__ as entry


def events(at, select: str) -> str:
    duckdb.connect().execute(f"COPY ({select}) TO '{at}/events.parquet' (FORMAT PARQUET)")
    return str(at)


def held(spark, name: str, at: str) -> None:
    rows, differences = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], at)
    assert rows and not differences, differences


def test_nearest_of_tied_times_has_the_largest_value(spark, tmp_path):  # F18
    source = f"{sf('sf0.001')}/events.parquet"
    held(spark, "asof_nearest", events(tmp_path, f"SELECT * REPLACE (date_trunc('hour', ts) AS ts, user_id % 3 AS user_id) FROM '{source}'"))


@pytest.mark.parametrize("name", ["clip_export", "decode_range"])  # F19, F20
def test_samples_over_full_scale_are_kept(spark, tmp_path, name):
    source = f"{sf('sf0.001')}/events.parquet"
    held(spark, name, events(tmp_path, f"SELECT * REPLACE (user_id % 3 AS user_id, value * 3 AS value) FROM '{source}'"))


def test_runs_of_just_the_ceiling(spark, tmp_path):  # F22
    source = f"{sf('sf0.1')}/events.parquet"
    held(spark, "music_ranges_full", events(tmp_path, f"SELECT * REPLACE (event_id + k * 100000 AS event_id, user_id + k * 1500 AS user_id) FROM '{source}' JOIN (VALUES (1073, 4), (840, 5)) x(u, k) ON u = user_id"))


def test_landmarks_are_summed_up_not_kept(spark):  # F2 to F5, F7, F9 to F17
    """What is written on the way to the sums of the landmarks is smaller than the texts, though a text has four landmarks a token."""
    from pathlib import Path

    from waveloom.plans.shared import folder

    at, held_ = sf("sf0.01"), Path(folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in held_.rglob("*.parquet"))
    before = size()
    assert entry.queries()["landmark_index"](spark, at).count()
    texts = spark.read.parquet(f"{at}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first()["n"]
    assert size() - before < texts


def test_places_of_tied_hashes_keep_their_order():
    import numpy as np

    from waveloom.operators import landmarks as L

    x = np.array([5, 1, 5, 5, 1, 9], np.uint64)
    got = L.sorted_pairs(x, np.array([0, 0, 0, 1, 1, 1]), np.arange(6))
    assert [g.astype(int).tolist() for g in got] == [[1, 1, 5, 5, 5, 9], [0, 1, 0, 0, 1, 1], [1, 4, 0, 2, 3, 5], [1, 0, 1, 0, 0, 1], [1, 1, 1, 0, 1, 1], [0, 0, 0, 1, 0, 0]]
    many = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (L.unpacked(L.packed(many)) == many).all() and (L.unpacked(L.packed(many[:1])) == many[:1]).all()
    assert (L.long_(*L.short(np.array([0, 254, 255, 70000]))) == [0, 254, 255, 70000]).all()


def texts(at, count: int) -> str:
    """Passages that some documents share, in ends of their own; some of them twice in a text, and texts of one length."""
    duckdb.connect().execute(f"""COPY (SELECT i AS doc_id, array_to_string(list_transform(range(0, 50 + i % 3), lambda j: 'w' || CAST(hash(i * 1000 + j) % 900 AS VARCHAR)), ' ') || ' '
    || array_to_string(list_transform(range(0, 60), lambda j: 'p' || CAST(hash(i % 5 * 100 + j) % 400 AS VARCHAR)), ' ') || CASE WHEN i % 4 = 0 THEN ' ' || array_to_string(list_transform(range(0, 90), lambda j: 'q' || (j % 45)), ' ') ELSE '' END AS text
    FROM range({count}) x(i)) TO '{at}/documents.parquet' (FORMAT PARQUET)""")
    return str(at)


@pytest.mark.parametrize("name", ["ablated_passages", "example_regions", "passages_everywhere"])  # F1, F6, F8
def test_owners_over_many_slices_and_buckets(spark, tmp_path, monkeypatch, name):
    from waveloom.operators import landmarks as L

    for limit, size in {"CHUNK": 3000, "OWNER_BUCKET": 5000, "OWNER_GROUP": 4000}.items():
        monkeypatch.setattr(L, limit, size)
    held(spark, name, texts(tmp_path, 60))


def test_votes_against_owners_write_no_table_of_landmarks(spark, tmp_path, monkeypatch):  # F1, F6, F8
    from waveloom.operators import landmarks as L
    from waveloom.plans import recurring

    rows = []

    def seen(df, name, *more, real=L.stored):
        out = real(df, name, *more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(L, "stored", seen)
    monkeypatch.setattr(recurring, "stored", seen)
    recurring.passages(spark, texts(tmp_path, 60)).collect()
    assert len(rows) > L.OWNER_PASSES and max(rows) < 1000 < 60 * 110 * 4  # landmarks of the texts


def test_small_chunks_are_read_together(spark, tmp_path):  # F24
    from waveloom.sources import store as S

    at = str(tmp_path / "series")
    S.write_series(spark.range(3000).selectExpr("id AS t", "id * 0.5 AS value").repartition(2), at, "t", "t", rows=10)
    reader = S.SeriesReader(at)
    parts = reader.partitions()
    assert len(parts) <= 160 < 300 <= sum(len(p.files) for p in parts)
    assert sorted(t for p in parts for b in reader.read(p) for t in b.column("t").to_pylist()) == list(range(3000))


class Held:
    """State of one key in memory, which counts how often it is asked or told."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def told(self, out=None):
        self.calls += 1
        return out

    get = lambda self: self.told(self.value)
    exists = lambda self: self.told(self.value is not None)
    update = lambda self, x: self.told(setattr(self, "value", x))
    containsKey = lambda self, k: self.told(k in self.map)
    getValue = lambda self, k: self.told(self.map[k])
    updateValue = lambda self, k, x: self.told(self.map.__setitem__(k, x))
    removeKey = lambda self, k: self.told(self.map.pop(k))
    keys = lambda self: self.told(list(self.map))
    clear = lambda self: self.told(self.map.clear())
    listTimers = lambda self: self.told(list(self.timers))
    deleteTimer = lambda self, t: self.told(self.timers.discard(t))
    registerTimer = lambda self, t: self.told(self.timers.add(t))


def test_chunks_due_within_a_batch_never_enter_the_state():  # F23
    import pandas as pd

    from waveloom.streaming.episodes import Episodes

    rows = [(k, 8000.0, [float(k)], 1000 + k) for k in range(49, -1, -1)] + [(50, None, None, 1050)]
    batch = lambda x: iter([pd.DataFrame(x, columns=["seq", "sample_rate", "x", "at_ms"])])
    held, made = Held(), Episodes(lowpass=False)
    made.init(held)
    out = pd.concat(list(made.handleInputRows(("e",), batch(rows), None)))
    assert held.calls <= 5 and held.timers == {1050 + made.patience + made.keep}
    assert [y[0] for y in out["y"] if len(y)] == [float(k) for k in range(50)]
    # over several batches what comes early waits in the state, and goes from there
    held = Held()
    made.init(held)
    out = [x for part in (rows[:20], rows[20:45], rows[45:]) for x in made.handleInputRows(("e",), batch(part), None)]
    assert [y[0] for x in out for y in x["y"] if len(y)] == [float(k) for k in range(50)] and not held.map and len(held.timers) == 1


def long_series(at) -> str:
    """Few users with many events, some without a value, one with too few for a frame, some events of nobody."""
    source = f"{sf('sf0.01')}/events.parquet"
    return events(at, f"""SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id < 12 THEN 99 ELSE user_id % 4 END AS user_id,
    CASE WHEN event_id % 31 = 0 OR event_id < 12 OR user_id % 4 = 3 AND event_id BETWEEN 3000 AND 6000 THEN NULL ELSE value END AS value) FROM '{source}'""")


@pytest.mark.parametrize("size", [8, 1024])  # F25
def test_constellations_of_long_series_in_many_blocks(spark, tmp_path, monkeypatch, size):
    from waveloom.operators import spectral as P

    monkeypatch.setattr(P, "FRAMES", size)
    held(spark, "constellation_landmarks", long_series(tmp_path))


@pytest.mark.parametrize("name", ["frame_levels", "spectral_flux", "chroma_fold"])  # the step they share
def test_spectra_of_missing_values(spark, tmp_path, name):
    source = f"{sf('sf0.001')}/events.parquet"
    held(spark, name, events(tmp_path, f"SELECT * REPLACE (user_id % 5 AS user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM '{source}'"))


def test_spectra_are_made_without_a_row_for_each_value_and_bin(spark):  # F25
    """No node of the plan puts out more rows than the events have bins and halo; a join with the table of the transform would make 36 an event."""
    at = sf("sf0.01")
    df = entry.queries()["constellation_landmarks"](spark, at)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    rows, open_ = [], [plan]
    while open_:
        node = open_.pop()
        children = [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        made = node.metrics().get("numOutputRows")
        rows += [made.get().value()] if made.isDefined() else []
        open_ += children
    assert len(rows) > 3 and max(rows) < 2 * spark.read.parquet(f"{at}/events.parquet").count(), rows


def test_states_of_many_series_are_carried_side_by_side(spark):  # F26
    """Runs of blocks of many series of unlike length go through the carry in batches; a pandas group for each series took most of the time."""
    import numpy as np

    from waveloom.operators import filters as L

    section = L.lowpass(1.0, 0.2, 0.7)
    df = spark.range(400).selectExpr("id AS k", "explode(sequence(0L, pmod(xxhash64(id), 90))) AS t").selectExpr("k", "t", "pmod(xxhash64(k, t), 1000) / 100 AS x")
    df = df.unionByName(spark.range(5000).selectExpr("1000L AS k", "id AS t", "pmod(xxhash64(id), 1000) / 100 AS x"))  # one of five levels of runs beside them
    got = L.filtered(df, "k", [section], block=8, fan=4)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    series, out = {}, {}
    for r in df.orderBy("k", "t").collect():
        series.setdefault(r["k"], []).append(r["x"])
    for r in got.orderBy("k", "t").collect():
        out.setdefault(r["k"], []).append(r["y"])
    assert out.keys() == series.keys()
    for k, x in series.items():
        assert np.allclose(out[k], L.filter_block(np.array(x), section, np.zeros(4)), atol=1e-9)
