"""The pipeline's stages on a small corpus: what each must drop, keep and rewrite."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, tmp_path):
    item = edge.prose(77, 40)
    rows = [(i, edge.prose(1000 + i, 80), "en") for i in range(30)]
    rows += [(100, edge.prose(1003, 80) + " tail", "en"), (101, edge.prose(55, 30) + " " + item, "en"), (102, edge.prose(56, 30) + " a.b@mail.org", "en"), (103, "123 456", "en"), (104, None, None)]
    edge.documents(spark, rows).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    whole = {i for i, _, _ in rows}
    assert kept[0] == whole - {103, 104} and kept[1] == kept[0] - {100} and kept[2] == kept[1] - {101} and kept[3] == kept[4] == kept[2]
    text = spark.read.parquet(str(tmp_path / "surrogate_pii")).filter("doc_id = 102").first()["text"]
    assert "a.b@mail.org" not in text and text.startswith(edge.prose(56, 30))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


WIDE = "kept boolean, __id long, score double, component_id long, row string, times long"


def edge_rows():
    prose = edge.prose
    rows = [(i, prose(1000 + i, 60), "en") for i in range(12)]
    rows += [(3, prose(1003, 60), "en"), (50, None, None), (51, "", "en"), (None, prose(2000, 60), "en"), (None, prose(2000, 60), "en"), (60, prose(2100, 60), "en"), (60, prose(2200, 60), "en"), (70, prose(2300, 80_000), "en")]
    return [(i, t, g, "s", len(t or ""), True, i, 0.5, 7, "r", 2) for i, t, g in rows]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(edge_rows(), f"doc_id long, text string, lang string, source string, n_chars long, {WIDE}")


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bench")
    spark.createDataFrame([(1, edge.prose(2200, 60)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_empty_table(spark, wide, bench_dir, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, wide.filter("false"), bench_dir)
    assert out.count() == 0 and (name == "packing" or out.columns == wide.columns)


def test_language_stage_edges(spark, wide, bench_dir):
    out = corpus_pipeline.language_id(spark, wide, bench_dir)
    assert out.columns == wide.columns and ids(out) == sorted((r[0] for r in edge_rows() if r[1]), key=repr)


def test_near_duplicates_stage_edges(spark, wide, bench_dir):
    out = corpus_pipeline.near_duplicates(spark, wide, bench_dir)
    assert out.columns == wide.columns and ids(out) == sorted([*range(12), 50, 51, None, None, 60, 60, 70], key=repr)


def test_decontamination_stage_edges(spark, wide, bench_dir, tmp_path):
    out = corpus_pipeline.decontamination(spark, wide, bench_dir)
    assert out.columns == wide.columns and ids(out) == sorted((r[0] for r in edge_rows() if r[0] != 60), key=repr)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.decontamination(spark, wide, str(tmp_path)).count() == len(edge_rows())


def test_surrogate_stage_edges(spark, wide, bench_dir):
    out = corpus_pipeline.surrogate_pii(spark, wide, bench_dir)
    assert out.columns == wide.columns and sorted(map(repr, ((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()))) == sorted(repr((r[0], r[1], r[4])) for r in edge_rows())


def test_packing_stage_edges(spark, wide, bench_dir):
    out = corpus_pipeline.packing(spark, wide, bench_dir).collect()
    assert sorted((r["doc_id"] for r in out if r["piece"] == 0), key=repr) == sorted((r[0] for r in edge_rows()), key=repr)
    assert {r["length"] for r in out if r["doc_id"] in (50, 51)} == {1} and sum(r["doc_id"] == 70 for r in out) > 50


def test_given_entity_count_comes_back(spark):
    docs = edge.documents(spark, [(1, "Mail anna.b@mail.com", "en"), (2, None, None)]).withColumn("n_entities", F.lit(77))
    got = corpus_pipeline.surrogate_pii(spark, docs, "").collect()
    assert [r["n_entities"] for r in got] == [77, 77] and "anna.b" not in str(got) and got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
