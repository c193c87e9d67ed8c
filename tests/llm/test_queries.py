"""The registered corpus queries: against their SQL, on empty tables, and on awkward rows."""

import pytest

import __spark_entry__ as contract
from crawlframe.llm import catalog
from tests.compare import connect, differences
from tests.llm.conftest import TEXTS


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert catalog.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"op2_html_extract", "op4_mixing", "op11_whitening", "op12_spelling"}))
def test_every_row_has_a_result(spark, odd_dir, name):
    rows = catalog.QUERIES[name](spark, odd_dir).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((i for i, _ in TEXTS), key=key)


def test_all_are_registered():
    assert set(catalog.QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_awkward_vectors(spark, odd_dir):
    rows = catalog.QUERIES["op11_whitening"](spark, odd_dir).collect()
    assert sorted({(r["vec_id"] or 0, r["component"]) for r in rows}) == sorted((i, c) for i in (-7, 0, 1) for c in (1, 2, 3))
    assert len(rows) == 12 and {r["n"] for r in rows} == {4}
