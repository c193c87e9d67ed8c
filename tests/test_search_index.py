"""Searching stored results through the trigram index: the same rows, from fewer files."""

import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlframe.operators import filters, search_index
from crawlframe.operators.search_index import TrigramIndex
from crawlframe.plans import views
from tests.test_operators import result, results

AT = datetime(2024, 1, 1)


@pytest.fixture
def index(spark, tmp_path):
    rows = [result(f"http://h{i:03}.org/p", title=f"Page {'Zürich' if i == 33 else i}", processed_at=AT, emails=["ab@c.org", "d@e.org"] if i == 70 else [],
                   keywords={"Licence": 2, "other": 1} if i == 5 else {}, dead_links=["http://gone.net/x"] if i == 99 else []) for i in range(100)]
    table = str(tmp_path / "results")
    results(spark, *rows).repartitionByRange(10, "url").write.parquet(table)
    index = TrigramIndex(spark, table, str(tmp_path / "the index"))
    assert len(index.candidates("zürich")) == len(index._files()) == 10  # nothing is known yet
    index.update()
    return index


TERMS = ["ZÜRICH", "licence", "ab@c", "c.org d@e", "gone.net", "h03", "http://h07", "Page", '"title"', "nowhere", "zq", "", "licence other"]


@pytest.mark.parametrize("term", TERMS)
def test_the_same_rows(spark, index, term):
    whole = spark.read.parquet(index.table)
    for search in (filters.search_results, lambda df, t: filters.search_db_view(views.db_view(df), t)):
        want = sorted(r["url"] for r in search(whole, term).collect())
        assert sorted(r["url"] for r in search(index.rows(term), term).collect()) == want


def test_files_without_the_trigrams_are_not_read(spark, index):
    for term, files in (("zürich", 1), ("LICENCE", 1), ("c.org d@e", 1), ("h03", 1), ("nowhere", 0), ("zq", 10), ("page", 10)):
        assert len(index.candidates(term)) == files
        assert len(index.rows(term).inputFiles()) == files


def test_new_files_are_searched_before_and_after_they_are_indexed(spark, index):
    results(spark, result("http://new.org/", title="fresh zürich", processed_at=AT)).coalesce(1).write.mode("append").parquet(index.table)
    again = TrigramIndex(spark, index.table, index.path)
    for _ in range(2):
        assert {r["url"] for r in filters.search_results(again.rows("zürich"), "zürich").collect()} == {"http://h033.org/p", "http://new.org/"}
        assert len(again.candidates("licence")) in (1, 2)
        before = len(again.known())
        again.update()
    assert before == 11 and len(again.candidates("licence")) == 1


def test_a_failure_before_the_names_are_written_changes_no_search(spark, index, monkeypatch):
    results(spark, result("http://new.org/", title="later", processed_at=AT)).coalesce(1).write.mode("append").parquet(index.table)
    with monkeypatch.context() as patch:
        patch.setattr("crawlframe.operators.search_index._place", lambda f: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.update()
    for _ in range(2):
        assert [r["url"] for r in filters.search_results(index.rows("later"), "later").collect()] == ["http://new.org/"]
        index.update()
    assert len(index.candidates("later")) == 1


@pytest.mark.parametrize("stretch", [5, 40, 1 << 22])
def test_trigrams_of_texts(monkeypatch, stretch):
    monkeypatch.setattr(search_index, "STRETCH", stretch)
    pick = random.Random(7)
    for _ in range(200):
        texts = ["".join(pick.choices("abé漢😀\0 ", k=pick.choice([0, 1, 2, 3, 4, 30]))) for _ in range(pick.randrange(8))]
        found = search_index._written_out(search_index.trigrams(pa.array([*texts, None], pa.string())))
        assert sorted(found) == sorted({t[i:i + 3] for t in texts for i in range(len(t) - 2)})


def test_a_task_gives_each_trigram_of_a_file_once():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.list_(pa.string())), pa.array([f for _, f in rows])], ["texts", "file"])

    batches = [batch(*[(["abcd", None, "bc"], "f")] * 500, (None, "f")), batch((["xabc"], "f"), (["abc"], "g"), ([], "h"))]
    found = [(r["file"], r["trigram"]) for b in search_index._file_trigrams(iter(batches)) for r in b.to_pylist()]
    assert sorted(found) == [("f", "abc"), ("f", "bcd"), ("f", "xab"), ("g", "abc")]


def test_index_of_odd_rows(spark, tmp_path):
    odd = [result("http://é.org/İ", title=None, processed_at=AT, emails=None), result("http://x/", title="a😀b", emails=[None, "q@x.org"], processed_at=None)] * 2
    results(spark, *odd).coalesce(1).write.parquet(str(tmp_path / "t"))
    index = TrigramIndex(spark, str(tmp_path / "t"), str(tmp_path / "i"))
    index.update()
    texts = spark.read.parquet(index.table).select(F.explode(F.transform(search_index.result_texts(), F.lower)).alias("t")).dropna().collect()
    found = [r["trigram"] for r in spark.read.parquet(f"{index.path}/trigrams").collect()]
    assert sorted(found) == sorted({r["t"][i:i + 3] for r in texts for i in range(len(r["t"]) - 2)})
