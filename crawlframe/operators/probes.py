"""Dead links and dead domains from probe outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import url_host
from ..schemas import RESULT_COLUMNS
from .dedup import first_per_key
from .skew import balanced_lookup


def is_dead_status(status: Column) -> Column:
    """404, 410, any 5xx or above, or no response. Redirects are not followed and count as alive."""
    return status.isNull() | status.isin(404, 410) | (status >= 500)


def last_outcome(probes: DataFrame, key: str, outcome: str) -> DataFrame:
    """``key`` and ``outcome`` of the last probe per key, by ``probed_at`` if there is such a column.

    Of probes with the same time the one with the larger outcome counts; no response is the smallest.
    """
    order = [F.col("probed_at").desc_nulls_last()] if "probed_at" in probes.columns else []
    return first_per_key(probes, [key], [*order, F.col(outcome).desc_nulls_last()]).select(key, outcome)


def domain_status(links: DataFrame, host_probes: DataFrame) -> DataFrame:
    """One verdict per linked host; a host that was never reached is dead."""
    hosts = (links.select(url_host(F.col("link_url")).alias("host"))
                  .filter("host <> ''").distinct())
    probed = hosts.join(last_outcome(host_probes, "host", "reachable"), "host", "left")
    return probed.select("host", (F.coalesce(F.col("reachable"), F.lit(0)) == 0).alias("is_dead"))


def classify_links(links: DataFrame, host_probes: DataFrame, link_probes: DataFrame) -> DataFrame:
    """Verdict per link: the domain decides first, then the URL itself.

    Adds ``host`` and ``verdict`` (dead_domain, dead_link or alive). A link
    whose host cannot be told is dropped. Of several probes of a host or link
    the last counts, so no link is multiplied.
    """
    hosted = links.withColumn("host", url_host(F.col("link_url"))).filter("host <> ''")
    by_host = balanced_lookup(hosted, last_outcome(host_probes, "host", "reachable"), "host")
    probed = balanced_lookup(by_host, last_outcome(link_probes, "link_url", "http_status"), "link_url")
    verdict = (F.when(F.coalesce(F.col("reachable"), F.lit(0)) == 0, "dead_domain")
                .when(is_dead_status(F.col("http_status")), "dead_link").otherwise("alive"))
    return probed.select(*links.columns, "host", verdict.alias("verdict"))


def dead_link_rows(verdicts: DataFrame, found_at: Column) -> DataFrame:
    """One result row per dead link, keyed by the page it was found on.

    Such a row has status 0, no title and no process time; the host is added
    to ``dead_domains`` when the whole domain is dead.
    """
    none = F.array().cast("array<string>")
    return verdicts.filter("verdict <> 'alive'").select(
        F.col("source_url").alias("url"),
        F.lit(0).alias("status_code"),
        F.lit("").alias("title"),
        none.alias("emails"),
        F.create_map().cast("map<string,int>").alias("keywords"),
        F.array("link_url").alias("dead_links"),
        F.when(F.col("verdict") == "dead_domain", F.array("host")).otherwise(none)
         .alias("dead_domains"),
        none.alias("new_urls"),
        found_at.alias("processed_at"),
        F.lit(0).cast("bigint").alias("process_time"),
        F.lit("").alias("error"),
    ).select(*RESULT_COLUMNS)
