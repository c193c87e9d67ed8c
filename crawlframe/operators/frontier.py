"""The URL frontier: priorities, batches, spill, submission and depths."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.urls import is_submittable_url
from .lineage import application_folder, cut

_DAY = 86_400


def priority(depth: Column, timestamp: Column) -> Column:
    """Lower is sooner: one depth level weighs as much as 1,000 seconds."""
    return depth.cast("bigint") * 1000 + F.unix_seconds(timestamp)


def _cumulative_cut(counts: DataFrame, k: int, start: Column) -> DataFrame:
    """First ``slot`` at which the running total, from ``start`` on, reaches ``k``, with the total before it and its own count."""
    running = start + F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return (counts.withColumn("upto", running).filter(F.col("upto") >= k)
                  .agg(F.min_by(F.struct("slot", (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("tied")), "slot")
                        .alias("cut")).select("cut.*"))


def priority_cutoff(frontier: DataFrame, k: int) -> DataFrame:
    """One row: ``cutoff``, the priority of the k-th best row, and how many rows come before it and are tied at it.

    NULLs where there are fewer rows. Found from counts per day and then per second of one day, which are tiny,
    instead of from a sort of the frontier.
    """
    ranked = frontier.select(priority(F.col("depth"), F.col("timestamp")).alias("p"))
    per_day = ranked.groupBy(F.floor(F.col("p") / _DAY).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    day = _cumulative_cut(per_day, k, F.lit(0)).select(F.col("slot").alias("day"), F.col("before").alias("day_before"))
    inside = ranked.join(F.broadcast(day), F.floor(F.col("p") / _DAY) == F.col("day"))
    per_second = inside.groupBy(F.col("p").alias("slot"), "day_before").agg(F.count(F.lit(1)).alias("n"))
    return _cumulative_cut(per_second, k, F.col("day_before")).withColumnRenamed("slot", "cutoff")


def first_by_url(tied: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows by URL: whole ranges of URLs, and of the range where ``k`` falls the rows up to it.

    The ranges are fixed by a checkpoint; one count per range comes to the driver.
    """
    dealt = cut(tied.repartitionByRange(F.col("url")).withColumn("_range", F.spark_partition_id()))
    last, divided, left = -1, -1, k
    for row in dealt.groupBy("_range").count().orderBy("_range").collect():
        if row["count"] > left:
            divided = row["_range"]
            break
        last, left = row["_range"], left - row["count"]
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("url"))
    part = dealt.filter(F.col("_range") == divided).withColumn("_rank", rank).filter(F.col("_rank") <= left).drop("_rank")
    return dealt.filter(F.col("_range") <= last).unionByName(part).drop("_range")


def frontier_batch(frontier: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows by priority, ties by URL.

    A top-k alone would hand k rows of every task to one task. The priority of
    the k-th row is worked out from counts first: rows before it are taken
    whole, and of those tied with it the first by URL. The result is sorted
    over several tasks.
    """
    ranked = frontier.withColumn("priority", priority(F.col("depth"), F.col("timestamp")))
    cutoff, before, tied = priority_cutoff(frontier, k).first()
    if cutoff is None:
        return ranked.orderBy("priority", "url")
    upto = ranked.filter(F.col("priority") <= cutoff)
    if before + tied > k:  # not all of the tied rows belong to the batch
        upto = upto.filter(F.col("priority") < cutoff).unionByName(
            first_by_url(upto.filter(F.col("priority") == cutoff), k - before))
    return upto.orderBy("priority", "url")


def frontier_spill(frontier: DataFrame, capacity: int) -> DataFrame:
    """What does not fit in a queue of that capacity; URLs must be unique (see ``upsert_frontier``)."""
    return frontier.join(frontier_batch(frontier, capacity).select("url"), "url", "left_anti")


def submit_urls(submitted: DataFrame, column: str = "url") -> DataFrame:
    """Trimmed, non-blank URLs labelled valid or invalid; valid ones enter at depth 0."""
    cleaned = (submitted.withColumn(column, F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
                        .filter(F.col(column) != ""))
    valid = is_submittable_url(F.col(column))
    return cleaned.withColumn("valid", valid).withColumn("depth", F.when(F.col("valid"), 0))


def submit_summary(labelled: DataFrame) -> DataFrame:
    """added, total_valid and invalid counts of a submission."""
    valid = F.count_if(F.col("valid"))
    return labelled.agg(valid.alias("added"), valid.alias("total_valid"),
                        F.count_if(~F.col("valid")).alias("invalid"))


class StoredEdges:
    """Distinct edges (src, dst) in buckets by source, so that a join by source reads them without a shuffle.

    A source with more than one in ``HOT_PART`` of all edges is dealt over SALTS buckets by its targets. There are
    fewer than HOT_PART such sources, whatever the graph, so the list of them is broadcast.
    """

    HOT_PART, SALTS, LEAST_HOT = 1_000, 16, 10_000

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        edges = cut(links.select("src", "dst").distinct())
        limit = max(self.LEAST_HOT, edges.count() // self.HOT_PART)
        self.hot = cut(edges.groupBy("src").count().filter(F.col("count") > limit).select("src"))
        self.name = f"edges_{uuid.uuid4().hex}"
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("dst"), F.lit(self.SALTS)).cast("int")).otherwise(0)
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # one writing task per bucket, and so one file each
        dealt = (edges.join(F.broadcast(self.hot.withColumn("_hot", F.lit(True))), "src", "left")
                 .select("src", "dst", salt.alias("salt")).repartition(self.buckets, "src", "salt"))
        (dealt.write.bucketBy(self.buckets, "src", "salt").sortBy("src", "salt")
         .option("path", f"{application_folder(self.spark)}/{self.name}").saveAsTable(self.name))

    def targets(self, sources: DataFrame) -> DataFrame:
        """url: distinct targets of the distinct ``sources`` (url). Only the sources are shuffled."""
        level = (sources.select(F.col("url").alias("src")).join(F.broadcast(self.hot.withColumn("_hot", F.lit(True))), "src", "left")
                 .withColumn("salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(self.SALTS - 1))).otherwise(F.array(F.lit(0)))))
                 .drop("_hot"))
        # merged, since a side that grows with the crawl is not to be broadcast
        edges = self.spark.table(self.name)
        return edges.join(level.hint("merge"), ["src", "salt"], "left_semi").select(F.col("dst").alias("url")).distinct()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def crawl_depths(seeds: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """url, depth: what is reachable from the seeds in at most ``max_depth`` steps, at least depth.

    ``links`` has src and dst, ``seeds`` has url. The distinct edges are written once, in buckets by source; each
    round joins the last level to them without shuffling them, and is checkpointed, so the plan does not grow and a
    lost executor costs one level at most. Targets are made distinct before they are compared with what was visited.
    """
    edges = StoredEdges(links)
    level = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited = level
    try:
        for depth in range(1, max_depth + 1):
            level = cut(edges.targets(level).join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
            if level.isEmpty():
                break
            visited = visited.unionByName(level)
    finally:
        edges.drop()
    return visited
