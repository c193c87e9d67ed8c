"""Operators on small literals, and skewed data against plain Python."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlframe.operators import dedup, filters, frontier, index, links, probes, robots, skew
from crawlframe.plans import hunt, reports, views
from crawlframe.schemas import CRAWL_RESULT, FRONTIER, RESULT_COLUMNS
from crawlframe.session import RUNTIME_CONF

T0 = datetime(2024, 1, 1)


def result(url="http://h.org/", **fields):
    row = dict(url=url, status_code=200, title="t", emails=[], keywords={}, dead_links=[],
               dead_domains=[], new_urls=[], processed_at=T0, process_time=10, error="")
    row.update(fields)
    return tuple(row[c] for c in RESULT_COLUMNS)


def results(spark, *rows):
    return spark.createDataFrame(list(rows), CRAWL_RESULT)


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(300)}", i) for i in range(n)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_balanced_lookup_equals_a_plain_join(spark, adaptive):
    rows = skewed() + [(None, 3000 + i) for i in range(50)]
    left = spark.createDataFrame(rows, "key string, id int")
    right = {f"k{i}": i for i in range(0, 300, 2)} | {"hot": -1, "unused": -2}
    rdf = spark.createDataFrame(list(right.items()), "key string, v int")

    def run(how):
        df = skew.balanced_lookup(left, rdf, "key", how=how)
        return sorted(tuple(r) for r in df.select("id", *(["v"] if "v" in df.columns else [])).collect())

    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        by_id = sorted((i, right.get(k)) for k, i in rows)
        assert run("left") == by_id
        assert run("inner") == [r for r in by_id if r[1] is not None]
        assert run("left_semi") == [(i,) for i, v in by_id if v is not None]
        assert run("left_anti") == [(i,) for i, v in by_id if v is None]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_planner_splits_a_hot_key(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(60_000).repartition(20).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) AS key", "id", "uuid() AS pad")
        right = spark.range(500).selectExpr("concat('k', id) AS key", "id AS v").union(spark.sql("SELECT 'hot', -1L"))
        df = skew.balanced_lookup(left, right, "key")
        assert df.agg(F.sum("v")).first()[0] is not None
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_indexes_on_skewed_mentions(spark):
    rng = random.Random(2)
    rows, want, totals = [], defaultdict(list), Counter()
    for i in range(1500):
        words = {"the": rng.randrange(1, 9)} | {f"w{rng.randrange(40)}": 1}
        rows.append(result(url=f"http://h{rng.randrange(200)}.org/", keywords=words,
                           processed_at=datetime.fromtimestamp(1_700_000_000 + i * 7)))
        for w, n in words.items():
            totals[w] += n
            second = int(rows[-1][8].timestamp())
            want[w].append((f"result:{rows[-1][0]}_{second}", rows[-1][0]))
    df = results(spark, *rows).repartition(7).cache()
    got = {r["keyword"]: r for r in reports.keyword_index(df).collect()}
    assert set(got) == set(want)
    for word, sources in want.items():
        assert got[word]["first_urls"] == [u for _, u in sorted(sources)[:2]]
        assert (got[word]["pages"], got[word]["frequency"], got[word]["more"]) == \
            (len(sources), totals[word], max(len(sources) - 2, 0))
    top = reports.keyword_index(df, limit=3).collect()
    assert {r["keyword"] for r in top} == {w for w, _ in sorted(totals.items(), key=lambda e: (-e[1], e[0]))[:3]}
    assert all(r["first_urls"] == got[r["keyword"]]["first_urls"] for r in top)

    listed = defaultdict(list)
    for r in reports.export_keywords(df).collect():
        assert r["frequency"] == totals[r["keyword"]]
        listed[r["keyword"]].append((r["store_key"], r["url"]))
    assert {w: sorted(rows) for w, rows in listed.items()} == {w: sorted(rows) for w, rows in want.items()}


def test_a_key_with_very_many_sources_is_listed_whole(spark):
    df = spark.range(120_000).selectExpr(
        "concat('http://h/', id) AS url", "map('the', 2) AS keywords", "timestamp_seconds(id) AS processed_at")
    rows = reports.export_keywords(df)
    assert rows.count() == 120_000
    assert rows.agg(F.min("frequency"), F.max("frequency"), F.count_distinct("url")).first() == (240_000, 240_000, 120_000)


def test_crawl_depths(spark):
    rng = random.Random(3)
    edges = [(0 if rng.random() < 0.3 else rng.randrange(400), rng.randrange(400)) for _ in range(900)]
    depth, level = {0: 0}, {0}
    for d in range(1, 4):
        level = {b for a, b in edges if a in level} - set(depth)
        depth |= {x: d for x in level}
    got = frontier.crawl_depths(spark.createDataFrame([(0,)], "url int"),
                                spark.createDataFrame(edges, "src int, dst int"), 3)
    assert {r["url"]: r["depth"] for r in got.collect()} == depth


def tasks(spark, n=4000, seed=4):
    rng = random.Random(seed)
    rows = [(f"http://u{i}.org/", rng.randrange(6), datetime.fromtimestamp(1_700_000_000 + rng.choice(
        [5, rng.randrange(3_000_000)])), 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, FRONTIER)


@pytest.mark.parametrize("k", [10, 1500, 2400, 5000])
def test_frontier_batch_and_spill(spark, k):
    rows, df = tasks(spark)
    want = sorted(rows, key=lambda r: (r[1] * 1000 + int(r[2].timestamp()), r[0]))
    batch = [r["url"] for r in frontier.frontier_batch(df, k).collect()]
    assert batch == [r[0] for r in want[:k]]
    assert {r["url"] for r in frontier.frontier_spill(df, k).collect()} == {r[0] for r in want[k:]}


def test_batch_of_one_second(spark):
    rows = [(f"http://u{i}.org/", 1, datetime.fromtimestamp(1_700_000_000), 0) for i in range(2500)]
    batch = frontier.frontier_batch(spark.createDataFrame(rows, FRONTIER), 1100)
    assert [r["url"] for r in batch.collect()] == sorted(r[0] for r in rows)[:1100]


def test_depth_outweighs_a_thousand_seconds(spark):
    rows = [("deep-but-old", 1, datetime.fromtimestamp(1_700_000_000), 0),
            ("shallow-but-new", 0, datetime.fromtimestamp(1_700_001_001), 0)]
    first = frontier.frontier_batch(spark.createDataFrame(rows, FRONTIER), 1).first()
    assert first["url"] == "deep-but-old"


def test_submit(spark):
    df = spark.createDataFrame([("  http://a.org ",), ("",), (" ",), ("ftp://x",), ("a.org",), ("/p",)], "url string")
    labelled = frontier.submit_urls(df)
    assert {(r["url"], r["valid"], r["depth"]) for r in labelled.collect()} == {
        ("http://a.org", True, 0), ("ftp://x", True, 0), ("a.org", False, None), ("/p", False, None)}
    assert tuple(frontier.submit_summary(labelled).first()) == (2, 2, 2)


def test_sample_sizes(spark):
    rows = [(i, f"s{i}", [f"l{j}" for j in range(n)]) for i, n in enumerate([0, 1, 4, 5, 12, 100])]
    df = spark.createDataFrame(rows, "page_id int, source_url string, links array<string>")
    picked = links.sample_links(df).collect()
    assert Counter(r["page_id"] for r in picked) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 20}
    assert all(r["link_url"] in rows[r["page_id"]][2] for r in picked)
    assert len({(r["page_id"], r["link_url"]) for r in picked}) == len(picked)
    assert links.sample_links(df, seed="x").subtract(links.sample_links(df)).count() > 0
    assert links.sample_links(df, fraction=1.0).count() == 122


def test_dead_link_fixture(spark):
    """Twelve links: two unreachable hosts, three dead statuses, one timeout, six alive."""
    outcomes = {
        "https://no-such-host.test": None, "https://status.test/404": 404,
        "https://status.test/410": 410, "https://status.test/500": 500,
        "https://gone-domain.test/nonexistent": None, "https://status.test/200": 200,
        "https://example.org": 200, "https://bin.test/get": 200,
        "https://status.test/200?sleep=3000": None, "https://status.test/200?sleep=1000": 200,
        "https://status.test/301": 301, "https://status.test/302": 302,
    }
    page = spark.createDataFrame([(1, "http://src.org/", list(outcomes))],
                                 "page_id int, source_url string, links array<string>")
    hosts = spark.createDataFrame([("status.test", 1), ("example.org", 1), ("bin.test", 1),
                                   ("gone-domain.test", 0)], "host string, reachable int")
    probed = spark.createDataFrame(list(outcomes.items()), "link_url string, http_status int")
    again = probed.unionByName(probed), hosts.unionByName(hosts)  # repeated probes multiply nothing
    for judged in (probes.classify_links(links.link_edges(page), hosts, probed),
                   probes.classify_links(links.link_edges(page), again[1], again[0])):
        verdicts = [r["verdict"] for r in judged.collect()]
        assert Counter(verdicts) == {"dead_domain": 2, "dead_link": 4, "alive": 6}
    rows = probes.dead_link_rows(judged, F.lit(T0))
    assert rows.columns == RESULT_COLUMNS
    got = {r["dead_links"][0]: r for r in rows.collect()}
    assert len(got) == 6 and all(r["status_code"] == 0 and r["url"] == "http://src.org/" for r in got.values())
    assert got["https://gone-domain.test/nonexistent"]["dead_domains"] == ["gone-domain.test"]
    assert got["https://status.test/404"]["dead_domains"] == []
    # Two dead links of one page in one second share a key: the later one stays.
    stored = rows.withColumn("seq", F.monotonically_increasing_id())
    assert dedup.upsert_results(stored, "seq").count() == 1


def test_upsert_keeps_the_last_and_is_idempotent(spark):
    rows = [("a", T0, 1, "old"), ("a", T0.replace(microsecond=9), 2, "new"), ("a", T0.replace(second=1), 3, "x"),
            ("b", T0, 4, "y")]
    df = spark.createDataFrame(rows, "url string, processed_at timestamp, seq int, title string")
    once = dedup.upsert_results(df, "seq")
    assert {r["title"] for r in once.collect()} == {"new", "x", "y"}
    assert {r["title"] for r in dedup.upsert_results(once, "seq").collect()} == {"new", "x", "y"}
    assert {r["title"] for r in dedup.upsert_frontier(df, "seq").collect()} == {"x", "y"}


def test_new_urls(spark):
    rows = [(1, "s1", 0, "http://a/", 4), (2, "s2", 0, "http://a/", 1), (3, "s3", 0, "http://b/", 5),
            (4, "s4", 0, "ftp://c/", 0), (5, "s5", 0, "http://seen/", 0), (6, "s6", 0, "http://b/", 4)]
    df = spark.createDataFrame(rows, "page_id int, source_url string, pos int, link_url string, depth int")
    seen = spark.createDataFrame([("http://seen/",), ("http://seen/",)], "url string")
    got = links.new_urls(df, seen, ["depth", "page_id", "pos"], max_depth=5).collect()
    assert {(r["url"], r["depth"], r["source_url"]) for r in got} == {("http://a/", 2, "s2"), ("http://b/", 5, "s6")}


ROBOTS = """# comment
Disallow: /before-any-agent
User-agent: alpha
User-Agent: Beta # two agents share a group
Disallow: /private/   # trailing comment
Allow: /private/open
Crawl-delay: 2.5
Sitemap: http://h.org/one.xml
Disallow:

User-agent: *
Disallow: /*.pdf$
Disallow: /tmp*/x
Crawl-delay: nonsense
user-agent: beta
Disallow: /extra
sitemap: http://h.org/two.xml
"""


def test_robots(spark):
    df = spark.createDataFrame([("h.org", 200, ROBOTS), ("gone.org", 404, "User-agent: *\nDisallow: /"),
                                ("all.org", 200, "User-agent: *\r\nDisallow: /\r\n"), ("empty.org", 200, "")],
                               "host string, status int, body string")
    rules = {(r["host"], r["agent"], r["rule"], r["pattern"]) for r in robots.robots_rules(df).collect()}
    assert ("h.org", "alpha", "disallow", "/private/") in rules and ("h.org", "beta", "allow", "/private/open") in rules
    assert ("h.org", "beta", "disallow", "/extra") in rules and ("h.org", "alpha", "disallow", "/extra") not in rules
    assert not any("/before" in r[3] or r[3] == "" for r in rules)

    def allowed(agent, urls):
        udf = spark.createDataFrame([(u,) for u in urls], "url string")
        got = {r["url"]: r["allowed"] for r in robots.robots_allowed(udf, df, agent).collect()}
        return [got[u] for u in urls]

    assert allowed("Alpha/1.0", ["http://h.org/private/x", "http://h.org/private/open/x", "http://h.org/a.pdf",
                                 "http://h.org/extra", "http://h.org/private%2Fx"]) == [False, True, True, True, False]
    assert allowed("beta", ["http://h.org/extra/1", "http://h.org/tmp/x"]) == [False, True]
    assert allowed("other", ["http://h.org/d/a.pdf", "http://h.org/a.pdf?q", "http://h.org/a.pdfx", "http://h.org/tmp9/xy",
                             "http://h.org/private/x", "http://all.org", "http://gone.org/x", "http://unknown.org/x",
                             "http://empty.org/x", "http://bad host/"]) == \
        [False, False, True, False, True, False, True, True, True, False]
    delays = {r["host"]: r["crawl_delay"] for r in robots.robots_crawl_delay(df, "alpha").collect()}
    assert delays == {"h.org": 2.5, "gone.org": 0.0, "all.org": 0.0, "empty.org": 0.0}
    assert [r["sitemap"] for r in robots.robots_sitemaps(df).orderBy("pos").collect()] == \
        ["http://h.org/one.xml", "http://h.org/two.xml"]


def test_long_robots_body(spark):
    body = "".join(f"User-agent: a{i}\nDisallow: /{i}\n" for i in range(20_000))
    df = spark.createDataFrame([("h.org", 200, body)], "host string, status int, body string")
    assert robots.robots_rules(df).count() == 20_000


def test_content_filter(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "text/html; charset=x", "x"), (4, "APPLICATION/XHTML+XML", "x"),
            (5, "image/png", "x"), (6, "text/html", "é" * 1_500_000)]
    got = {r["id"]: r for r in filters.html_content_filter(
        spark.createDataFrame(rows, "id int, content_type string, body string")).select(
        "id", "error", F.octet_length("body").alias("n")).collect()}
    assert [got[i]["error"] for i in range(1, 7)] == ["", "", "", "", "skipped non-HTML content: image/png", ""]
    assert [got[i]["n"] for i in (1, 5, 6)] == [1, 0, 3_000_000]


def test_search_and_lookup(spark):
    df = results(spark, result("http://A.org/x", emails=["q@a.org", "w@b.org"], keywords={"Rust": 2, "go": 1}),
                 result("http://b.org/", title="Rusty"), result("http://c.org/", emails=["rust@z.io"]), result("http://d.org/"))
    got = {r["url"]: r for r in filters.search_results(df, "RUST").collect()}
    assert set(got) == {"http://A.org/x", "http://b.org/", "http://c.org/"}
    assert got["http://A.org/x"]["matching_keywords"] == {"Rust": 2} and got["http://c.org/"]["matching_emails"] == ["rust@z.io"]
    front = spark.createDataFrame([("http://b.org/", 1, T0, 0)], FRONTIER)
    assert filters.lookup_key(front, df, "url:http://b.org/").first()["database"] == "URLs"
    key = f"result:http://b.org/_{int((T0 - datetime(1970, 1, 1)).total_seconds())}"
    with_utc = filters.lookup_key(front, df.withColumn("processed_at", F.lit("2024-01-01").cast("timestamp")), key)
    assert with_utc.first()["database"] == "Results"
    assert filters.lookup_key(front, df, "url:nope").count() == 0


def test_reports_on_nothing(spark):
    df, front = results(spark), spark.createDataFrame([], FRONTIER)
    stats = reports.db_stats(front, df).first()
    assert stats["results"] == 0 and stats["success_rate"] is None
    assert reports.metrics_summary(df).first()["success_rate"] == 100.0
    assert reports.processing_time_stats(df).count() == 0 and reports.timeline_span(df).count() == 0
    assert reports.processing_rate(df).first()["per_second"] == 0.0
    assert views.db_view_stats(df).first()["total_records"] == 0


def test_blocked_rows_are_not_live_errors(spark):
    df = results(spark, result(error="blocked by robots.txt"), result("http://x/", error="HTTP 404"),
                 result("http://y/", keywords={"a": 3, "b": 4}), result("http://y/", dead_links=["http://z/"]))
    m = reports.metrics_summary(df).first()
    assert (m["urls_processed"], m["errors"], m["keywords_found"], m["dead_links_found"]) == (3, 1, 7, 1)
    c = reports.mode_counters(df).first()
    assert (c["urls_processed"], c["errors"], c["keywords_found"]) == (4, 2, 2)


def test_findings_rows(spark):
    df = results(spark, result(emails=["a@b.c", "d@e.f"], keywords={"k": 2}, dead_links=["l"], dead_domains=["d"]),
                 result("http://e/", error="x", status_code=0), result("http://s/"))
    got = Counter(r["type"] for r in views.findings(df).collect())
    assert got == {"email": 2, "keyword": 1, "dead_link": 1, "dead_domain": 1, "error": 1, "success": 1}
    entries = views.db_view(df, limit=2).collect()
    assert {r["id"] for r in entries} == {"result_1", "result_2"}
    with pytest.raises(ValueError):
        views.db_view(df, limit=0)
    assert views.db_view_stats(df).first()["unique_dead_links"] == 2


def test_rate_spans_days(spark):
    times = ["2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:02:30", "2024-01-04 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("processed_at"))
    got = reports.rate_between_snapshots(df, 60).orderBy("snapshot_at").collect()
    assert [(r["processed"], r["elapsed_seconds"]) for r in got] == [(2, None), (1, 120), (1, 3 * 86400 - 120)]
    with pytest.raises(ValueError):
        reports.rate_between_snapshots(df, 0)


def test_hunt_modes():
    assert hunt.Hunt(emails=True).mode == "email"
    assert hunt.Hunt(keywords=["x"]).mode == "keywords"
    assert hunt.Hunt(domains=True).mode == "domains"
    assert hunt.Hunt(emails=True, domains=True).mode == "all"
    assert not hunt.Hunt(emails=True, keywords=["x"]).checks_dead_links
    with pytest.raises(ValueError):
        hunt.Hunt().mode


def test_runtime_settings_can_be_applied_to_any_session(spark):
    assert all(spark.conf.isModifiable(key) for key in RUNTIME_CONF)


def test_page_bodies_stay_out_of_the_shuffle(spark):
    fetched = spark.createDataFrame(
        [("http://a.org/x", 0, 200, "text/html", "<title>t</title>", "", datetime(2024, 1, 1), 0)],
        "url string, depth int, status_code int, content_type string, body string, fetch_error string, processed_at timestamp, process_time bigint")
    robots_table = spark.createDataFrame([("a.org", 200, "User-agent: *\nDisallow: /x")], "host string, status int, body string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = hunt.crawl_step(fetched, robots_table, "bot/1.0", hunt.Hunt(emails=True))
        fetched_body = next(a for a in fetched._jdf.queryExecution().analyzed().output().mkString(",").split(",") if a.startswith("body"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert [(r["title"], r["error"], r["status_code"]) for r in out.collect()] == [("", "blocked by robots.txt", 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [plan.split("Exchange")[i + 1].split("\n")[1] for i in range(plan.count("Exchange"))]
    assert below and not any(fetched_body in line for line in below)


def test_last_probe_and_last_robots_answer_count(spark):
    hosts = spark.createDataFrame([("h", 0, 1), ("h", 1, 2)], "host string, reachable int, probed_at int")
    assert [tuple(r) for r in probes.last_outcome(hosts, "host", "reachable").collect()] == [("h", 1)]
    answers = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /", 1), ("h", 404, "", 2)],
                                    "host string, status int, body string, fetched_at int")
    urls = spark.createDataFrame([("http://h/a",)], "url string")
    assert [r["allowed"] for r in robots.robots_allowed(urls, answers, "bot").collect()] == [True]


def test_rounds_of_depths_do_not_shuffle_the_edges(spark, monkeypatch):
    monkeypatch.setattr(frontier.StoredEdges, "LEAST_HOT", 200)
    rng = random.Random(5)
    pairs = {(0 if rng.random() < 0.4 else rng.randrange(3000), rng.randrange(3000)) for _ in range(6000)}
    links = spark.createDataFrame(sorted(pairs), "src int, dst int")
    edges = frontier.StoredEdges(links)
    try:
        assert [r["src"] for r in edges.hot.collect()] == [0]
        stored = spark.table(edges.name)
        assert stored.filter("src = 0").select("salt").distinct().count() == edges.SALTS
        found = edges.targets(spark.createDataFrame([(0,), (7,), (2999,)], "url int"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        scan = [line for line in plan.splitlines() if "FileScan parquet" in line and edges.name in line]
        assert len(scan) == 1 and f"SelectedBucketsCount: {edges.buckets} out of {edges.buckets}" in scan[0]
        above = plan[plan.index("SortMergeJoin"):plan.index(scan[0])].split("Exchange")
        assert len(above) == 1  # none between the join and the scan of the edges
        assert {r["url"] for r in found.collect()} == {b for a, b in pairs if a in (0, 7, 2999)}
    finally:
        edges.drop()
    assert not spark.catalog.tableExists(edges.name)
