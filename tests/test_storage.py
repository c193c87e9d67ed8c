"""Sources, sinks and streams against files."""

import contextlib
import io
import json
import os
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import text
from crawlframe.operators import filters
from crawlframe.plans import views
from crawlframe.schemas import CRAWL_RESULT, LINK_PROBE, PAGE
from crawlframe.sources import sinks, store, views as derived
from crawlframe.sources.tables import Tables
from crawlframe.streaming import jobs
from tests.test_operators import result, results

T0 = datetime(2024, 1, 1, 10, 0, 0, 123456)


def lines(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name)) as handle:
                out += [json.loads(line) for line in handle]
    return out


def test_jsonl_appends_and_omits_empty(spark, tmp_path):
    path = str(tmp_path / "results")
    df = results(spark, result(emails=["a@b.c"], keywords={"k": 1}, processed_at=T0))
    sinks.append_jsonl(df, path)
    sinks.append_jsonl(results(spark, result("http://e/", error="boom", title="")), path)
    rows = {r["url"]: r for r in lines(path)}
    assert set(rows["http://h.org/"]) == {"url", "status_code", "title", "emails", "keywords", "processed_at", "process_time"}
    assert set(rows["http://e/"]) == {"url", "status_code", "title", "processed_at", "process_time", "error"}
    back = store.read_results(spark, path).filter("url = 'http://h.org/'").first()
    assert back["emails"] == ["a@b.c"] and back["keywords"] == {"k": 1} and back["processed_at"] == T0


def test_strict_and_lenient_reads(spark, tmp_path):
    path = tmp_path / "kv"
    path.mkdir()
    good = '{"url":"http://a/","status_code":200,"keywords":{"k":2}}'
    (path / "a.json").write_text("\n".join([good, '{"url":"http://b/","status', "[1,2]", '"text"', "", "nonsense"]) + "\n")
    rows, rejects = store.read_lenient(spark, str(path))
    assert [r["url"] for r in rows.collect()] == ["http://a/"] and rejects.count() == 4
    with pytest.raises(Exception):
        store.read_results(spark, str(path)).collect()


def test_exports(spark, tmp_path):
    df = results(spark, result(emails=['q"uote,@b.c'], processed_at=T0), result("http://e/", error="bad"))
    sinks.export_findings_csv(views.findings(df), str(tmp_path / "csv"), files=1)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert {(r["type"], r["data"]) for r in back} == {("email", 'q"uote,@b.c'), ("error", "Status: 200, Title: t")}
    assert back[0]["found_at"] is not None
    sinks.export_db_view(views.db_view(df), str(tmp_path / "view"), files=1)
    rows = {r["data_type"]: r for r in lines(tmp_path / "view")}
    assert rows["emails"]["raw_data"] == '["q\\"uote,@b.c"]' and "error_message" not in rows["emails"]
    assert rows["general"]["error_message"] == "bad" and "search_text" not in rows["general"]
    sinks.export_json(store.scan_results(df), str(tmp_path / "all"))
    assert len(lines(tmp_path / "all")) == 2


def test_scan_order(spark):
    df = results(spark, result("http://b/"), result("http://a/b"), result("http://a"))
    assert [r["url"] for r in store.scan_results(df, 2).collect()] == ["http://a/b", "http://a"]


def test_streams_resume_from_their_checkpoint(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = results(spark, result("http://a/", new_urls=["http://x/", "http://y/", "mailto:z"]),
                    result("http://b/", new_urls=["http://x/"]))
    first.write.parquet(source)

    def run(start, name, **kwargs):
        stream = jobs.read_stream(spark, source, CRAWL_RESULT, files_per_batch=1)
        start(stream, f"{out}-{name}", f"{checkpoint}-{name}", **kwargs).awaitTermination()
        return spark.read.parquet(f"{out}-{name}")

    assert sorted(r["url"] for r in run(jobs.start_new_urls, "new").collect()) == ["http://x/", "http://y/"]
    assert jobs.latest(run(jobs.start_counters, "count"), []).first()["urls_processed"] == 2
    assert jobs.latest(run(jobs.start_timeline, "time"), ["window_start"]).first()["pages"] == 2
    results(spark, result("http://c/", new_urls=["http://y/", "http://w/"], error="late")).write.mode("append").parquet(source)
    assert sorted(r["url"] for r in run(jobs.start_new_urls, "new").collect()) == ["http://w/", "http://x/", "http://y/"]
    totals = jobs.latest(run(jobs.start_counters, "count"), []).first()
    assert totals["urls_processed"] == 3 and totals["errors"] == 1
    assert [r["pages"] for r in jobs.latest(run(jobs.start_timeline, "time"), ["window_start"]).collect()] == [3]
    delayed = jobs.read_stream(spark, source, CRAWL_RESULT)
    jobs.start_new_urls(delayed, f"{out}-delay", f"{checkpoint}-delay", delay="1 day").awaitTermination()
    assert spark.read.parquet(f"{out}-delay").count() == 3


def test_extraction_and_dead_link_streams(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://p.org/", "<title>T</title> a@b.org <a href='/x'>")], PAGE)
    pages.write.parquet(str(tmp_path / "pages"))
    jobs.start_extract(jobs.read_stream(spark, str(tmp_path / "pages"), PAGE), str(tmp_path / "jsonl"),
                       str(tmp_path / "c1"), ["b.org"]).awaitTermination()
    row = store.read_results(spark, str(tmp_path / "jsonl")).first()
    assert (row["title"], row["emails"], row["keywords"], row["new_urls"]) == \
        ("T", ["a@b.org"], {"b.org": 1}, ["http://p.org/x"])

    spark.createDataFrame([("http://d.org/1", 404), ("http://d.org/2", 200), ("http://u.org/", None)],
                          LINK_PROBE).write.parquet(str(tmp_path / "probes"))
    links = spark.createDataFrame([(1, "http://p.org/", f"http://{x}") for x in ("d.org/1", "d.org/2", "u.org/", "n.org/")],
                                  "page_id int, source_url string, link_url string")
    hosts = spark.createDataFrame([("d.org", 1), ("u.org", 0)], "host string, reachable int")

    def dead():
        jobs.start_dead_links(jobs.read_stream(spark, str(tmp_path / "probes"), LINK_PROBE), links, hosts,
                              str(tmp_path / "dead"), str(tmp_path / "c2")).awaitTermination()
        rows = jobs.current_dead_links(spark.read.parquet(str(tmp_path / "dead")), F.lit(T0)).collect()
        return {r["dead_links"][0]: r["dead_domains"] for r in rows}

    assert dead() == {"http://d.org/1": [], "http://u.org/": ["u.org"]}
    spark.createDataFrame([("http://d.org/1", 200), ("http://d.org/2", 410)], LINK_PROBE).write.mode("append").parquet(
        str(tmp_path / "probes"))
    assert dead() == {"http://d.org/2": [], "http://u.org/": ["u.org"]}  # one recovered, one died


def test_new_urls_need_no_earlier_output(spark, tmp_path):
    """State knows what was seen: earlier output may be gone, and a batch reads its own rows alone."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    seen: set[str] = set()
    for step in range(4):
        links = [f"http://x{step}/{i}" for i in range(5)] + [f"http://x{s}/0" for s in range(step)] + ["http://hot/"] * 3
        results(spark, *[result(f"http://p{step}-{i}/", new_urls=links) for i in range(6)]).write.mode("append").parquet(source)
        out = str(tmp_path / f"out{step}")  # a new folder each time
        stream = jobs.read_stream(spark, source, CRAWL_RESULT)
        query = jobs.start_new_urls(stream, out, checkpoint)
        query.awaitTermination()
        rows = [r["url"] for r in spark.read.parquet(out).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == set(links) - seen
        assert sum(p["numInputRows"] for p in query.recentProgress) == 6
        seen |= set(links)


def test_lookup_by_key_reaches_the_scan(spark, tmp_path):
    rows = results(spark, *[result(f"http://h{i}.org/a_{i}", processed_at=T0) for i in range(300)],
                   result("http://h.org/x_17_y", processed_at=T0, dead_links=["http://d/_1_2", "http://e/"]))
    sinks.store_by_url(rows, str(tmp_path / "results"))
    stored = spark.read.schema(CRAWL_RESULT).parquet(str(tmp_path / "results"))
    front = stored.select("url", F.lit(1).alias("depth"), F.col("processed_at").alias("timestamp"), F.lit(0).alias("retries"))
    for key in [r["k"] for r in stored.select(text.result_key().alias("k")).collect()][::60] + [
            stored.filter(F.size("dead_links") > 0).select(text.result_key()).first()[0], "url:http://h7.org/a_7"]:
        found = filters.lookup_key(front, stored, key)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(url", plan), plan
        assert [r["key"] for r in found.collect()] == [key]
        assert filters.lookup_keys(front, stored, spark.createDataFrame([(key,)], "key string")).collect()[0]["raw_value"] == found.first()["raw_value"]
    for key in ("result:http://h1.org/a_1", "result:", "result:_5", "url:", "other"):
        assert filters.lookup_key(front, stored, key).collect() == []
        assert filters.lookup_keys(front, stored, spark.createDataFrame([(key,)], "key string")).first()["database"] is None


@contextlib.contextmanager
def shuffled_joins(spark):
    """No broadcasts and a plan that is whole before it runs."""
    now = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffled(df):
    """The columns of each shuffle by a hash in a plan, one that is used again counting once."""
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("formatted")
    return [re.findall(r"(\w+)#", columns) for columns in re.findall(r"(?m)^\(\d+\) Exchange.*\nInput \[\d+\]: \[(.*)\]\nArguments: hashp", said.getvalue())]


def test_lookup_of_many_keys_shuffles_a_value_once(spark):
    rows = results(spark, *[result(f"http://h{i % 7}.org/_{i % 5}_1", processed_at=T0, dead_links=["http://d/_1_2"] * (i % 2)) for i in range(40)],
                   result("http://n.org/", processed_at=None), result(None, processed_at=T0))
    front = rows.select("url", F.lit(1).alias("depth"), F.col("processed_at").alias("timestamp"), F.lit(0).alias("retries")).distinct()
    stored = Counter([("URLs", k, v) for k, v in front.select(text.frontier_key(F.col("url")), filters._json(front)).collect()]
                     + [("Results", k, v) for k, v in rows.select(text.result_key(), filters._json(rows)).collect()])
    known = sorted({k for _, k, _ in stored if k is not None})
    asked = [*known[::2], known[0], "url:none", "other", "result:http://h1.org/_1", None, None]
    keys = spark.createDataFrame([(k,) for k in asked], "key string")
    expected = Counter({x: n for x, n in stored.items() if x[1] in asked and x[1] is not None})
    expected.update((None, k, None) for k in set(asked) - set(known))
    found = filters.lookup_keys(front, rows, keys)
    assert Counter((r["database"], r["key"], r["raw_value"]) for r in found.collect()) == expected
    with shuffled_joins(spark):
        found = filters.lookup_keys(front, rows, keys)
        assert Counter((r["database"], r["key"], r["raw_value"]) for r in found.collect()) == expected
        moved = shuffled(found)
    assert sum("raw_value" in columns for columns in moved) == 1, moved
    assert sum(columns == ["key"] for columns in moved) == 1, moved


def test_visits_are_not_shuffled_with_titles_and_links(spark, tmp_path):
    spark.createDataFrame([(i, T0, "error" if i % 3 == 0 else "view", 1.5) for i in range(12)], "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i, f"http://p{i}.org/", f"<title>T{i}</title><a href='/x{i}'>") for i in range(4)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, f"a{i}@b.org the") for i in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tables = Tables(spark, str(tmp_path))
    with shuffled_joins(spark):
        rows = derived.derive_visit_results(tables)
        got = {r["event_id"]: (r["url"], r["title"], r["emails"], r["keywords"], r["links_checked"]) for r in rows.collect()}
        moved = shuffled(rows)
    assert got == {i: (f"http://p{i % 4}.org/", f"T{i % 4}", [f"a{i % 3}@b.org"] if i % 3 else [], {"the": 1} if i % 3 else {}, 1 if i % 3 else 0) for i in range(12)}
    assert sum("event_id" in columns for columns in moved) == 2
    assert not any("event_id" in columns and {"url", "title", "new_urls"} & set(columns) for columns in moved), moved


def test_possible_urls_of_a_key(spark):
    keys = ["result:http://a/b_1_2_-3_http://d_4", "result:x_1", "result:nothing", "url:http://u_1/", "url:", "result:_7", "z", "result:a_1b_2\n_3"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = df.select("key", filters._possible_urls(F.col("key")).alias("u")).collect()
    assert {r["key"]: r["u"] for r in got} == {k: filters.possible_urls(k) for k in keys}


def test_lenient_reads_split_in_one_pass(spark, tmp_path):
    good = '{"url":"http://a/","status_code":200,"emails":["a@b.org"],"keywords":{"k":2}}'
    texts = [good, good[:-5], "", "  ", "[1]", "null", '{"url": 5', "{}", "text"]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    plain, parts = store.decode_lenient(lines), store.split_lenient(lines, str(tmp_path / "split"))
    for a, b in zip(plain, parts):
        assert a.schema.names == b.schema.names and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert parts[0].count() == 2 and parts[1].count() == 5
    plan = store.mark_lenient(spark.read.parquet(str(tmp_path / "split")).select("value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "PartitionFilters: [isnotnull(rejected" in parts[0]._jdf.queryExecution().executedPlan().toString()
    none, rejects = store.split_lenient(lines.limit(0), str(tmp_path / "empty"))
    assert none.count() == rejects.count() == 0
