"""Anchors of very many different regions: op3 parts them by longer grams instead of sending every window."""

from __future__ import annotations

import random

import edge
import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import plain_removal, q3


def texts(seed: int, docs: int) -> list[tuple]:
    """A passage in all documents, between ends that some of them share in part; and a periodic one."""
    rng = random.Random(seed)
    some = lambda n, kinds="abcdefgh ": "".join(rng.choice(kinds) for _ in range(n))
    passage, before, behind = some(150), some(80), some(80)
    rows = []
    for i in range(docs):
        b, e = rng.randrange(0, 80), rng.randrange(0, 80)
        rows.append((i, some(40) + before[80 - b:] + passage + behind[:e] + some(40) + ("ab" * rng.randrange(0, 90) if i % 5 == 0 else ""), "en"))
    return rows


@pytest.mark.parametrize("hot", [3, 40])
def test_parts_of_hot_anchors_find_what_all_windows_find(spark, monkeypatch, hot):
    monkeypatch.setattr(q3, "HOT", hot)
    rows = texts(hot, 120)
    got = q3.remove_repeats(edge.documents(spark, rows)).collect()
    want = plain_removal([(i, t) for i, t, _ in rows])
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_a_hot_region_is_two_rows_however_many_windows_it_has():
    raw = np.frombuffer(texts(1, 1)[0][1].encode(), np.uint8)
    text, start, n, h, r = q3.regions(raw, np.array([0, len(raw)]))
    cut = [raw[s: s + k + q3.LENGTH - 1].tobytes() for s, k in zip(start, n)]
    size = len(cut)
    batch = pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.zeros(size, np.int64)), pa.array(np.zeros(size, np.int32)), pa.array(start), pa.array(cut, pa.binary()), pa.array([-1] * size, pa.int32()), pa.array([q3.GRAM] * size, pa.int32())], names=["h", "doc_id", "v", "start", "region", "at", "gram"])
    made = pa.Table.from_batches(list(q3.parted(iter([batch]))))
    assert size <= made.num_rows <= 2 * size < n.sum()
    assert sum(len(x.as_py()) - q3.LENGTH + 1 for x in made["region"]) == n.sum()  # each window is in one part
    for x in made.to_pylist():
        assert 0 <= x["at"] <= q3.LENGTH - x["gram"] and len(x["region"]) - q3.LENGTH <= x["at"]  # and holds the gram
