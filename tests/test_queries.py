"""Every query with SQL against DuckDB, and the shape of the rest, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, sf

from waveloom.plans import catalogue

SMALL = sf("sf0.001")
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not SMALL, reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    n, different = compare(spark, name, QUERIES[name], ORACLES[name], SMALL)
    assert not different
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() > 0


def test_short_benchmark_texts_are_found(spark, tmp_path):
    texts = ["What is 17 times 24 plus 9?", "one two three", "two words", "word", "a b c d e f g h", "", None]
    docs = ["so:What is 17 times 24 plus 9?Yes", "xone two threey", "two wordsword", "za b c d e f g hi", "one two", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["benchmark_occurrences"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted((i, k) for i, d in enumerate(docs) for k, t in enumerate(texts) if d is not None and t is not None and t in d)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "delta", "votes", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
