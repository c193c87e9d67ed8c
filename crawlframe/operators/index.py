"""Inverted indexes: which results mention an e-mail, a keyword or a dead link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import store_key
from .skew import balanced_lookup


def mentions(results: DataFrame, items: Column) -> DataFrame:
    """One row per (key, result) for an array of keys; ``weight`` is 1."""
    return results.filter(F.size(items) > 0).select(
        F.explode(items).alias("key"), F.lit(1).cast("bigint").alias("weight"),
        store_key(F.col("url"), F.col("processed_at")).alias("store_key"), "url")


def email_mentions(results: DataFrame) -> DataFrame:
    return mentions(results, F.col("emails"))


def dead_mentions(results: DataFrame) -> DataFrame:
    """Dead links and dead domains share one key space."""
    return mentions(results, F.concat("dead_links", "dead_domains"))


def keyword_mentions(results: DataFrame) -> DataFrame:
    """One row per (keyword, result); ``weight`` is the number of occurrences."""
    return results.filter(F.size("keywords") > 0).select(
        F.explode("keywords").alias("key", "n"),
        store_key(F.col("url"), F.col("processed_at")).alias("store_key"), "url",
    ).select("key", F.col("n").cast("bigint").alias("weight"), "store_key", "url")


def first_n_sources(found: DataFrame, n: int) -> DataFrame:
    """key, first_urls: up to ``n`` URLs per key, in store-key order.

    The rank limit is applied per task before the shuffle, so even a keyword
    that every page holds sends n rows per task.
    """
    window = Window.partitionBy("key").orderBy("store_key", "url")
    kept = found.select("key", "store_key", "url").withColumn("rank", F.row_number().over(window)) \
                .filter(F.col("rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "url")))
    return kept.groupBy("key").agg(F.transform(ordered, lambda e: e["url"]).alias("first_urls"))


def index_of(found: DataFrame, sources: int, limit: int | None = None) -> DataFrame:
    """key, pages, total, first_urls, more, most frequent first.

    ``pages`` counts result rows, ``total`` sums the weights and ``more`` is
    the number of rows beyond the URLs shown. With a limit, the keys to report
    are settled before any URL is looked at.
    """
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.sum("weight").alias("total"))
    if limit is not None:
        counts = counts.orderBy(F.col("total").desc(), "key").limit(limit)
        found = balanced_lookup(found, counts.select("key"), "key", "left_semi")
    return counts.join(first_n_sources(found, sources), "key").select(
        "key", "pages", "total", "first_urls",
        F.greatest(F.col("pages") - sources, F.lit(0)).alias("more"))


def source_rows(found: DataFrame) -> DataFrame:
    """key, total, store_key, url: every source of every key, one row each, with the key's summed weight.

    One layout for keys of any size: no row and no task holds a key's whole list.
    """
    totals = found.groupBy("key").agg(F.sum("weight").alias("total"))
    return balanced_lookup(found, totals, "key").select("key", "total", "store_key", "url")
