"""Taking URLs from the stored frontier: none lost, none doubled, whatever fails."""

import datetime

import pytest

from crawlframe.schemas import FRONTIER
from crawlframe.sources.waiting import WaitingUrls

AT = datetime.datetime(2024, 1, 1)


def rows(spark, *urls, depth=1):
    return spark.createDataFrame([(u, depth, AT, 0) for u in urls], "url string, depth int, timestamp timestamp, retries int").select(*FRONTIER.names)


def urls(df):
    return sorted(r["url"] for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return WaitingUrls(spark, str(tmp_path / "waiting"))


def test_rows_come_out_once_in_key_order(spark, table):
    assert urls(table.waiting()) == [] and urls(table.refill(3)) == []
    table.spill(rows(spark, *"gdbeacf"))
    assert urls(table.refill(0)) == [] and urls(table.refill(3)) == ["a", "b", "c"]
    assert urls(table.waiting()) == ["d", "e", "f", "g"]
    assert urls(table.refill(99)) == ["d", "e", "f", "g"] and urls(table.refill(1)) == []


def test_a_later_spill_replaces_and_brings_back(spark, table):
    table.spill(rows(spark, "a", "b", "c"))
    table.spill(rows(spark, "b", depth=7))
    assert {r["url"]: r["depth"] for r in table.waiting().collect()} == {"a": 1, "b": 7, "c": 1}
    table.refill(2)
    table.spill(rows(spark, "a", depth=3))
    assert {r["url"]: r["depth"] for r in table.waiting().collect()} == {"a": 3, "c": 1}


def test_a_failure_between_the_two_writes_loses_and_doubles_nothing(spark, table, monkeypatch):
    table.spill(rows(spark, *"abcdef"))
    with monkeypatch.context() as patch:
        patch.setattr(WaitingUrls, "_commit", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.refill(2)
        with pytest.raises(OSError):
            table.spill(rows(spark, "z"))
        with pytest.raises(OSError):
            table.compact()
    again = WaitingUrls(spark, table.path)
    assert urls(again.waiting()) == list("abcdef") and urls(again.batches()) == []
    assert urls(again.refill(2)) == ["a", "b"] and urls(again.waiting()) == list("cdef")


def test_a_failure_after_the_second_write_leaves_the_batch_to_read(spark, table):
    table.spill(rows(spark, *"abc"))
    table.refill(2)
    table.refill(1)
    assert sorted((r["url"], r["batch"]) for r in WaitingUrls(spark, table.path).batches().collect()) == [("a", 2), ("b", 2), ("c", 3)]


def test_of_two_writers_one_fails_and_changes_nothing(spark, table):
    table.spill(rows(spark, *"abcd"))
    stale = table.version()
    table.refill(1)
    other = WaitingUrls(spark, table.path)
    other.version = lambda: stale
    with pytest.raises(Exception, match="(?i)exist"):
        other.refill(2)
    assert urls(table.waiting()) == ["b", "c", "d"] and urls(table.batches()) == ["a"]


def test_compact_and_clean_keep_what_waits(spark, table, tmp_path):
    table.spill(rows(spark, *"abcd"))
    table.spill(rows(spark, "e"))
    table.refill(2)
    table.compact()
    table.clean()
    assert urls(table.waiting()) == ["c", "d", "e"] and urls(table.batches()) == []
    assert len([f for f in (tmp_path / "waiting").iterdir() if f.name != "versions"]) == 1
    assert urls(table.refill(1)) == ["c"]
