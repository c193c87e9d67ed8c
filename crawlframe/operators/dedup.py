"""Keep-first, keep-last and distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    ``row_number() = 1`` lets the planner keep one row per key and task before
    the shuffle (a window group limit), so a hot key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def upsert_results(results: DataFrame, write_order: str) -> DataFrame:
    """Keep the last row written per URL and second of ``processed_at``."""
    keyed = results.withColumn("_second", F.unix_seconds("processed_at"))
    return first_per_key(keyed, ["url", "_second"], [F.col(write_order).desc()]).drop("_second")


def upsert_frontier(frontier: DataFrame, write_order: str) -> DataFrame:
    """Keep the last row written per URL."""
    return first_per_key(frontier, ["url"], [F.col(write_order).desc()])


def distinct_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """Exact global de-duplication of URLs."""
    return df.select(F.col(column).alias("url")).distinct()


def unseen(candidates: DataFrame, seen: DataFrame, column: str = "url") -> DataFrame:
    """Candidates (distinct by ``column``) that are not among the seen URLs.

    Both sides are reduced to one row per URL before the anti-join, so no key
    is hot, whatever the number of copies on either side.
    """
    known = seen.select(F.col("url").alias(column)).distinct()
    return candidates.join(known, column, "left_anti")


def union_results(*parts: DataFrame) -> DataFrame:
    """Page rows and finding rows in one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
