"""Stored totals per hour, kept current by rewriting only the days that got rows."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.urls import report_domain

#: Binary logarithm of a sketch's registers: a relative standard error of 0.8 %, 12 KB for each hour and measure.
REGISTERS = 14
STANDARD_ERROR = 1.04 / (1 << REGISTERS) ** 0.5
SKETCHES = ("emails", "keywords", "domains")
SCHEMA = ("hour timestamp, pages bigint, errors bigint, process_time bigint, emails binary, keywords binary, domains binary, day date")


def hourly_totals(results: DataFrame) -> DataFrame:
    """hour, pages, errors, process_time (sum) and a mergeable sketch of distinct e-mails, keywords and report domains, with the day.

    One scan: a page and its findings become rows of one kind each, added up and sketched before the shuffle, so that
    an hour costs one row per task, however many pages it has.
    """
    domain = F.nullif(report_domain(F.col("url")), F.lit(""))

    def kind(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    rows = results.select(
        F.date_trunc("hour", "processed_at").alias("hour"), (F.col("error") != "").alias("failed"), "process_time",
        F.explode(F.concat(kind("domains", F.array(domain)), kind("emails", F.col("emails")), kind("keywords", F.map_keys("keywords")))).alias("e"))
    page = F.col("e.kind") == "domains"  # one such row per page
    return rows.groupBy("hour").agg(
        F.count_if(page).alias("pages"), F.count_if(page & F.col("failed")).alias("errors"),
        F.sum(F.when(page, F.col("process_time"))).alias("process_time"),
        *[F.hll_sketch_agg(F.when(F.col("e.kind") == name, F.col("e.value")), F.lit(REGISTERS)).alias(name) for name in SKETCHES],
    ).withColumn("day", F.to_date("hour"))


class HourlyTotals:
    """``hourly_totals`` of a growing table, in one folder per day. Reports read these rows instead of the results."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def update(self, results: DataFrame, days: Iterable[datetime.date]) -> None:
        """Work out ``days``, those that got rows, anew and overwrite their folders; others are neither read nor written.

        The days reach the scan as a range of times, and as partitions where ``results`` are partitioned by ``day``.
        Running it again after a failure gives the same rows.
        """
        wanted = sorted(set(days))
        if not wanted:
            return
        some = results.filter((F.col("processed_at") >= F.lit(wanted[0]).cast("timestamp"))
                              & (F.col("processed_at") < F.lit(wanted[-1] + datetime.timedelta(days=1)).cast("timestamp"))
                              & F.to_date("processed_at").isin(wanted))
        if "day" in results.columns:
            some = some.filter(F.col("day").isin(wanted))
        (hourly_totals(some).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(self.path))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def timeline(self) -> DataFrame:
        """As ``reports.timeline_hourly`` of all results."""
        return self.rows().select(F.col("hour"), F.col("pages"))

    def totals(self) -> DataFrame:
        """One row: pages, errors, average_ns and estimates of distinct e-mails, keywords and domains.

        The relative standard error of an estimate is STANDARD_ERROR, and merging adds none; small counts are exact.
        """
        return self.rows().agg(
            F.sum("pages").alias("pages"), F.sum("errors").alias("errors"), (F.sum("process_time") / F.sum("pages")).alias("average_ns"),
            *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(f"unique_{name}") for name in SKETCHES])
