"""Crawl tables derived from raw pages, documents and events.

The rules are those of ``FIXTURES.md``: an event is one visit of a page, the
documents supply the text that was found there, and probe outcomes and robots
bodies follow from a hash of the URL or host. All of it is plain DataFrame
work, so that every report grows with the tables it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html, text, urls
from ..operators.dedup import first_per_key
from ..operators.links import link_edges, sample_links
from ..operators.probes import classify_links, dead_link_rows
from ..schemas import CRAWL_RESULT
from .tables import Tables

KEYWORDS = ("the", "und", "que", "license", "password")
BOT = "crawlframe-bot"
MAX_DEPTH = 5
# Dead links are found by a later pass; the derived rows all carry this time.
DEAD_ROW_TIME = "2024-02-01 00:00:00"

# The error message of an error event, by event_id modulo 8.
ERROR_MESSAGES = (
    "context deadline exceeded (Client.Timeout exceeded while awaiting headers)",
    "dial tcp: connection refused",
    "HTTP 404 not found",
    "403 Forbidden",
    "500 internal server error",
    "dns lookup failed",
    "blocked by robots.txt",
    "skipped non-HTML content: application/pdf",
)


def bucket(value: Column) -> Column:
    """0-255 from the first two hex digits of the MD5 digest."""
    return F.conv(F.substring(F.md5(value), 1, 2), 16, 10).cast("int")


def _numbered(events: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Add ``key`` = event_id modulo the number of rows of ``counted`` (a one-row join)."""
    total = counted.agg(F.count(F.lit(1)).alias("_n"))
    return events.crossJoin(total).withColumn(key, F.col("event_id") % F.col("_n")).drop("_n")


def visits(t: Tables) -> DataFrame:
    """One row per event: when, how long and with what outcome a page was visited."""
    is_error = F.col("event_type") == "error"
    slot = F.col("event_id") % 8
    message = F.element_at(F.array(*[F.lit(m) for m in ERROR_MESSAGES]), (slot + 1).cast("int"))
    status = (F.when(is_error, F.when(slot == 7, 200).otherwise(0))
               .when(F.col("event_id") % 10 < 8, 200)
               .when(F.col("event_id") % 10 == 8, 301).otherwise(404))
    return _numbered(t.events, t.pages, "page_id").select(
        "event_id", "page_id",
        F.col("ts").cast("timestamp").alias("processed_at"),
        (F.round(F.col("value") * 1000).cast("bigint") * 1000).alias("process_time"),
        F.when(is_error, message).otherwise("").alias("error"),
        status.alias("status_code"))


def page_titles(t: Tables) -> DataFrame:
    """page_id, url and title of the pages."""
    return t.pages.select("page_id", "url", html.extract_title(F.col("html")).alias("title"))


def page_visits(t: Tables) -> DataFrame:
    """Visits with the URL and title of their page."""
    return visits(t).join(page_titles(t), "page_id")


def document_findings(t: Tables) -> DataFrame:
    """E-mails and keyword counts per document; the text itself goes no further."""
    return t.documents.select("doc_id", text.extract_emails(F.col("text")).alias("emails"),
                              text.count_keywords(F.col("text"), KEYWORDS).alias("keywords"))


def derive_page_links(t: Tables) -> DataFrame:
    """page_id, source_url and the page's links as one array."""
    return t.pages.select("page_id", F.col("url").alias("source_url"),
                          html.extract_links(F.col("html"), F.col("url")).alias("links"))


def page_links(t: Tables) -> DataFrame:
    return t.stage("page_links", derive_page_links)


def links(t: Tables) -> DataFrame:
    """Edge table page_id, source_url, pos, link_url."""
    return link_edges(page_links(t))


def derive_visit_results(t: Tables) -> DataFrame:
    """Result rows of the visits, with ``event_id`` as write order and the number of links checked.

    Titles, links, e-mails and keywords are worked out once per page and
    document and then joined to the visits; no text is shuffled. What a
    document gives is joined first: titles and links come with the second
    join, after which no visit is shuffled again.
    """
    found = F.col("error") == ""
    types = {f.name: f.dataType for f in CRAWL_RESULT}

    def finding(name: str) -> Column:
        empty = (F.create_map() if name == "keywords" else F.array()).cast(types[name])
        return F.when(found, F.col(name)).otherwise(empty).alias(name)

    # a page at the depth limit passes no links on, but they are checked
    expandable = bucket(F.col("source_url")) % 7 < MAX_DEPTH
    new_urls = page_links(t).select("page_id", F.size("links").cast("bigint").alias("_links"), F.when(
        expandable, F.col("links")).otherwise(F.array().cast("array<string>")).alias("new_urls"))
    rows = _numbered(visits(t), t.documents, "doc_id").join(document_findings(t), "doc_id").drop("doc_id")
    rows = rows.join(page_titles(t), "page_id").join(new_urls, "page_id")
    none = F.array().cast("array<string>")
    return rows.select(
        "event_id", "url", "status_code", "title", finding("emails"), finding("keywords"),
        none.alias("dead_links"), none.alias("dead_domains"), finding("new_urls"),
        "processed_at", "process_time", "error",
        F.when(found, F.col("_links")).otherwise(0).alias("links_checked"))


def visit_results(t: Tables) -> DataFrame:
    return t.stage("visit_results", derive_visit_results)


def host_probes(t: Tables) -> DataFrame:
    """host, reachable: one probe outcome per distinct link host."""
    hosts = links(t).select(urls.url_host(F.col("link_url")).alias("host")).distinct()
    return hosts.select("host", F.when(bucket(F.col("host")) < 26, 0).otherwise(1).alias("reachable"))


def derive_link_probes(t: Tables) -> DataFrame:
    """link_url, http_status: one probe outcome per distinct link, NULL for no response."""
    b = bucket(F.col("link_url"))
    status = (F.when(b < 20, 404).when(b < 26, 410).when(b < 40, 500).when(b < 60, 301)
               .when(b < 70, F.lit(None).cast("int")).otherwise(200))
    return links(t).select("link_url").distinct().select("link_url", status.alias("http_status"))


def link_probes(t: Tables) -> DataFrame:
    return t.stage("link_probes", derive_link_probes)


def sampled_links(t: Tables) -> DataFrame:
    return sample_links(page_links(t))


def judged_links(t: Tables) -> DataFrame:
    """Every link of every page; none is left out of the dead-link check."""
    return links(t).select("page_id", "source_url", "link_url")


def verdicts(t: Tables) -> DataFrame:
    return classify_links(judged_links(t), host_probes(t), link_probes(t))


def derive_dead_rows(t: Tables) -> DataFrame:
    """Result rows of the dead links and domains."""
    return dead_link_rows(verdicts(t), F.lit(DEAD_ROW_TIME).cast("timestamp"))


def dead_rows(t: Tables) -> DataFrame:
    return t.stage("dead_rows", derive_dead_rows)


def crawl_results(t: Tables) -> DataFrame:
    """All result rows: the visits, then the dead-link findings as rows of their own. Both are stored once and read
    together."""
    return visit_results(t).drop("event_id").unionByName(dead_rows(t), allowMissingColumns=True)


def robots(t: Tables) -> DataFrame:
    """host, status, body: one robots.txt answer per page host."""
    host, b = F.col("host"), F.col("b")
    hosts = t.pages.select(urls.url_host(F.col("url")).alias("host")).distinct() \
             .withColumn("b", bucket(host))
    lines = F.array_compact(F.array(
        F.lit("User-agent: *"), F.lit("Disallow: /d"), F.lit("Allow: /de"), F.lit("Disallow: /fr"),
        F.lit("Allow: /fr/8"), F.concat(F.lit("Crawl-delay: "), (b % 5).cast("string")),
        F.when(b % 4 == 1, F.lit(f"User-agent: {BOT}")), F.when(b % 4 == 1, F.lit("Disallow: /en")),
        F.concat(F.lit("Sitemap: https://"), host, F.lit("/sitemap.xml"))))
    return hosts.select("host", F.when(b % 4 == 0, 404).otherwise(200).alias("status"),
                        F.when(b % 4 == 0, "").otherwise(F.array_join(lines, "\n")).alias("body"))


def link_graph(t: Tables) -> DataFrame:
    """src, dst: a page leads to its links, a link to its host, a host to its pages."""
    def hosted(column: str) -> Column:
        return F.concat(F.lit("host:"), urls.url_host(F.col(column)))

    found = links(t)
    to_links = found.select(F.col("source_url").alias("src"), F.col("link_url").alias("dst"))
    to_hosts = found.select(F.col("link_url").alias("src"), hosted("link_url").alias("dst"))
    to_pages = t.pages.select(hosted("url").alias("src"), F.col("url").alias("dst"))
    return to_links.unionByName(to_hosts).unionByName(to_pages).filter("src <> 'host:' AND dst <> 'host:'")


def derive_frontier(t: Tables) -> DataFrame:
    """One row per distinct link: depth from a hash, time of the source page's first visit."""
    first_visit = visits(t).groupBy("page_id").agg(F.min("processed_at").alias("timestamp"))
    known = first_per_key(links(t), ["link_url"], [F.col("page_id"), F.col("pos")])
    return known.join(first_visit, "page_id").select(
        F.col("link_url").alias("url"), (bucket(F.col("link_url")) % 6).alias("depth"),
        "timestamp", F.lit(0).alias("retries"))


def frontier(t: Tables) -> DataFrame:
    return t.stage("frontier", derive_frontier)


def seen_urls(t: Tables) -> DataFrame:
    """URLs known before the crawl: the pages themselves and a quarter of the links, by hash."""
    some = links(t).filter(bucket(F.col("link_url")) % 4 == 0).select(F.col("link_url").alias("url"))
    return t.pages.select("url").unionByName(some).distinct()
