"""Operators that SQL can express, against DuckDB on the small tables."""

from __future__ import annotations

import pytest
from compare import compare, sf

pytest.importorskip("public_tokenizers")
from waveloom.llm import registry  # noqa: E402

SMALL = sf("sf0.001")
ROWS = {"op12_prefix_trie": 59, "op13_centroid_clustering": 500}  # nodes and vectors; the others give a row a document


@pytest.mark.skipif(not SMALL, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    n, different = compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], SMALL)
    assert not different and n == ROWS.get(name, 200)
