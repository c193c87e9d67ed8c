"""The crawl step as one job: fetched pages in, result rows out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html, text
from ..operators.filters import html_content_filter
from ..operators.links import sample_size
from ..operators.robots import BLOCKED, robots_allowed
from ..schemas import CRAWL_RESULT, RESULT_COLUMNS

EMAIL, KEYWORDS, DOMAINS, ALL = "email", "keywords", "domains", "all"


@dataclass(frozen=True)
class Hunt:
    """What to look for. One goal is its own mode, several make ``all``."""

    emails: bool = False
    keywords: Sequence[str] = field(default_factory=tuple)
    domains: bool = False
    max_depth: int = 5
    check_fraction: float = 1.0

    @property
    def mode(self) -> str:
        modes = [m for m, on in ((EMAIL, self.emails), (KEYWORDS, bool(self.keywords)),
                                 (DOMAINS, self.domains)) if on]
        if not modes:
            raise ValueError("at least one goal is needed: emails, keywords or domains")
        return modes[0] if len(modes) == 1 else ALL

    @property
    def wants_emails(self) -> bool:
        return self.mode in (EMAIL, ALL)

    @property
    def wants_keywords(self) -> bool:
        return self.mode in (KEYWORDS, ALL)

    @property
    def checks_dead_links(self) -> bool:
        """Only on request, also in ``all``."""
        return self.domains


def hunt_pages(pages: DataFrame, hunt: Hunt) -> DataFrame:
    """Findings per page (url, body, depth): only the columns the mode asks for are worked out.

    ``links_checked`` counts the links of pages whose links are checked, and
    ``links_queued`` those to be probed, all unless ``check_fraction`` says
    otherwise. ``new_links`` is empty at the depth limit.
    """
    no_links = F.array().cast("array<string>")
    expandable = F.col("depth") < hunt.max_depth
    links = html.extract_links(F.col("body"), F.col("url"))
    # At the depth limit links are read only if they are to be checked.
    located = pages.withColumn("_links", links if hunt.checks_dead_links
                               else F.when(expandable, links).otherwise(no_links))
    checked = F.size("_links") if hunt.checks_dead_links else F.lit(0)
    queued = sample_size(F.size("_links"), hunt.check_fraction) if hunt.checks_dead_links else F.lit(0)
    emails = text.extract_emails(F.col("body")) if hunt.wants_emails else no_links
    keywords = (text.count_keywords(F.col("body"), hunt.keywords) if hunt.wants_keywords
                else F.create_map().cast("map<string,int>"))
    return located.select(
        *[c for c in pages.columns if c != "body"],
        html.extract_title(F.col("body")).alias("title"),
        emails.alias("emails"), keywords.alias("keywords"),
        F.when(expandable, F.col("_links")).otherwise(no_links).alias("new_links"),
        checked.alias("links_checked"), queued.alias("links_queued"))


def crawl_step(fetched: DataFrame, robots: DataFrame, agent: str, hunt: Hunt) -> DataFrame:
    """Result rows of a batch of fetches.

    ``fetched``: url, depth, status_code, content_type, body, fetch_error,
    processed_at, process_time. Robots come first, then the fetch error, then
    the content type. Bodies are read at the scan and go no further: the robots
    verdict is joined to what was found, and takes it away from blocked pages.
    ``new_urls`` holds the page's valid links; which of them are new to the
    crawl is settled by ``operators.links.new_urls`` over the whole table.
    """
    filtered = html_content_filter(fetched)
    error = F.when(F.col("fetch_error") != "", F.col("fetch_error")).otherwise(F.col("error"))
    settled = filtered.withColumn("error", error).withColumn(
        "body", F.when(F.col("error") == "", F.col("body")).otherwise(""))
    found = robots_allowed(hunt_pages(settled, hunt), robots, agent).withColumn(
        "error", F.when(F.col("allowed"), F.col("error")).otherwise(BLOCKED))
    ok = F.col("error") == ""
    empty = {"title": F.lit(""), "emails": F.array().cast("array<string>"),
             "keywords": F.create_map().cast("map<string,int>"),
             "new_links": F.array().cast("array<string>")}

    def kept(name: str) -> Column:
        return F.when(ok, F.col(name)).otherwise(empty[name])

    columns = {
        "url": F.col("url"),
        "status_code": F.when(F.col("allowed"), F.col("status_code")).otherwise(0).cast("int"),
        "title": kept("title"), "emails": kept("emails"), "keywords": kept("keywords"),
        "dead_links": empty["emails"], "dead_domains": empty["emails"],
        "new_urls": kept("new_links"), "processed_at": F.col("processed_at"),
        "process_time": F.col("process_time"), "error": F.col("error"),
    }
    return found.select(*[columns[c].alias(c) for c in RESULT_COLUMNS])


def extract_results(pages: DataFrame, keywords: Sequence[str], processed_at: Column) -> DataFrame:
    """pages (url, html) -> result rows with everything extracted; also used on streams."""
    body = F.col("html")
    columns = {
        "status_code": F.lit(200), "title": html.extract_title(body),
        "emails": text.extract_emails(body), "keywords": text.count_keywords(body, keywords),
        "dead_links": F.array(), "dead_domains": F.array(),
        "new_urls": html.extract_links(body, F.col("url")), "processed_at": processed_at,
        "process_time": F.lit(0), "error": F.lit(""), "url": F.col("url"),
    }
    return pages.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CRAWL_RESULT])
