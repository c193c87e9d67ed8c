"""Link edges: explode, sample, and find what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import is_valid_url
from .dedup import first_per_key, unseen


def link_edges(page_links: DataFrame) -> DataFrame:
    """page_id, source_url, links[] -> page_id, source_url, pos, link_url.

    The array is distinct already, so ``pos`` is the rank of first appearance.
    """
    return page_links.select("page_id", "source_url", F.posexplode("links").alias("pos", "link_url"))


def sample_size(count: Column, fraction: float) -> Column:
    """floor(fraction * count), but at least one link if there is any."""
    wanted = F.floor(count * F.lit(fraction)).cast("int")
    return F.when(count > 0, F.greatest(wanted, F.lit(1))).otherwise(0)


def sampled(links: Column, fraction: float = 0.2, seed: str = "") -> Column:
    """A reproducible sample of an array of links, ordered by the MD5 of link and seed."""
    if fraction >= 1.0:
        return links
    ranked = F.array_sort(F.transform(links, lambda l: F.struct(
        F.md5(F.concat(l, F.lit(seed))).alias("h"), l.alias("l"))))
    return F.transform(F.slice(ranked, F.lit(1), sample_size(F.size(links), fraction)),
                       lambda s: s["l"])


def sample_links(page_links: DataFrame, fraction: float = 0.2, seed: str = "") -> DataFrame:
    """page_id, source_url, link_url of the sampled links.

    A page's links come from one body of bounded size, so the sample is drawn
    inside the row and needs no shuffle.
    """
    return page_links.select("page_id", "source_url",
                             F.explode(sampled(F.col("links"), fraction, seed)).alias("link_url"))


def new_urls(candidates: DataFrame, seen: DataFrame, discovery_order: Sequence[str],
             max_depth: int) -> DataFrame:
    """Links of expandable pages that nobody saw before, credited to their first discoverer.

    ``candidates`` holds link_url, source_url and the source's ``depth``.
    """
    expandable = candidates.filter((F.col("depth") < max_depth) & is_valid_url(F.col("link_url")))
    first = first_per_key(expandable, ["link_url"], [F.col(c) for c in discovery_order])
    return unseen(first, seen, "link_url").select(
        F.col("link_url").alias("url"), (F.col("depth") + 1).alias("depth"), "source_url")
