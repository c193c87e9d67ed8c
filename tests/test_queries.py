"""Every registered query against its SQL, and independence from how the work is split."""

import pytest

import __spark_entry__ as contract
from crawlframe.plans import catalog, oracle
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = contract.queries()[name](spark, sf_dir)
    assert differences(df, con, contract.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("partitions,adaptive", [("1", "true"), ("37", "false")])
@pytest.mark.parametrize("name", ["domain_stats", "email_index", "new_urls", "classify_links",
                                  "frontier_batch_large", "rate_between_snapshots", "db_view_stats"])
def test_answers_do_not_depend_on_partitions(spark, sf_dir, con, name, partitions, adaptive):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = contract.queries()[name](spark, sf_dir)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        assert differences(df, con, contract.oracle_sql()[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_entry(spark):
    assert contract.entry(spark).count() > 0
