"""Reports over stored results and the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import error_category
from ..functions.urls import report_domain
from ..operators.index import dead_mentions, email_mentions, index_of, keyword_mentions, source_rows
from ..operators.robots import BLOCKED
from .views import distinct_counts


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def _errors() -> Column:
    return F.count_if(F.col("error") != "")


def _total(size: Column) -> Column:
    return F.coalesce(F.sum(size), F.lit(0))


def db_stats(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Row and finding totals; ``success_rate`` is NULL when there are no results."""
    urls = frontier.agg(F.count(F.lit(1)).alias("urls"))
    totals = results.agg(F.count(F.lit(1)).alias("results"), _total(F.size("emails")).alias("emails"),
                         _total(F.size("keywords")).alias("keywords"),
                         _total(F.size("dead_links")).alias("dead_links"), _errors().alias("errors"))
    return urls.crossJoin(totals).withColumn(
        "success_rate", _percent(F.col("results") - F.col("errors"), F.col("results")))


def email_index(results: DataFrame, limit: int | None = None) -> DataFrame:
    """email, pages, first three source URLs and how many more."""
    return index_of(email_mentions(results), 3, limit).select(
        F.col("key").alias("email"), "pages", "first_urls", "more")


def keyword_index(results: DataFrame, limit: int | None = None) -> DataFrame:
    """keyword, frequency, pages, first two source URLs and how many more."""
    return index_of(keyword_mentions(results), 2, limit).select(
        F.col("key").alias("keyword"), F.col("total").alias("frequency"), "pages", "first_urls", "more")


def deadlink_index(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Dead link or dead domain, pages, first three source URLs and how many more."""
    return index_of(dead_mentions(results), 3, limit).select(
        F.col("key").alias("dead_link"), "pages", "first_urls", "more")


def export_emails(results: DataFrame) -> DataFrame:
    """email, pages, store_key, url: every source of every address, with the number of results that have it."""
    return source_rows(email_mentions(results)).select(
        F.col("key").alias("email"), F.col("total").alias("pages"), "store_key", "url")


def export_keywords(results: DataFrame) -> DataFrame:
    """keyword, frequency, store_key, url: every source of every keyword, with its total frequency."""
    return source_rows(keyword_mentions(results)).select(
        F.col("key").alias("keyword"), F.col("total").alias("frequency"), "store_key", "url")


def analyze_totals(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Totals and exact distinct counts of e-mails, keywords and domains."""
    domain = report_domain(F.col("url"))
    urls = frontier.agg(F.count(F.lit(1)).alias("total_urls"))
    rows = results.agg(F.count(F.lit(1)).alias("total_results"))
    unique = distinct_counts(results, {
        "unique_emails": F.col("emails"), "unique_keywords": F.map_keys("keywords"),
        "unique_domains": F.filter(F.array(domain), lambda d: d != "")})
    return urls.crossJoin(rows).crossJoin(unique)


def analyze_totals_approx(frontier: DataFrame, results: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Like ``analyze_totals`` with sketches: no shuffle of values, a stated relative error."""
    urls = frontier.agg(F.count(F.lit(1)).alias("total_urls"))
    domain = report_domain(F.col("url"))
    rows = results.agg(F.count(F.lit(1)).alias("total_results"),
                       F.approx_count_distinct(F.when(domain != "", domain), rsd).alias("unique_domains"))
    emails = results.select(F.explode("emails").alias("v")).agg(
        F.approx_count_distinct("v", rsd).alias("unique_emails"))
    keywords = results.select(F.explode(F.map_keys("keywords")).alias("v")).agg(
        F.approx_count_distinct("v", rsd).alias("unique_keywords"))
    return urls.crossJoin(rows).crossJoin(emails).crossJoin(keywords)


def status_code_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("status_code").agg(F.count(F.lit(1)).alias("responses"))


def error_histogram(results: DataFrame) -> DataFrame:
    return (results.filter(F.col("error") != "")
                   .groupBy(error_category(F.col("error")).alias("category"))
                   .agg(F.count(F.lit(1)).alias("occurrences")))


def processing_time_stats(results: DataFrame) -> DataFrame:
    """Average (whole nanoseconds), minimum and maximum; no row without results."""
    return results.agg(
        F.expr("sum(process_time) div count(process_time)").alias("avg_ns"),
        F.min("process_time").alias("min_ns"), F.max("process_time").alias("max_ns"),
    ).filter("max_ns IS NOT NULL")


def depth_histogram(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("depth").agg(F.count(F.lit(1)).alias("urls"))


def keyword_totals(results: DataFrame) -> DataFrame:
    return (results.select(F.explode("keywords").alias("keyword", "n"))
                   .groupBy("keyword").agg(F.sum("n").alias("frequency")))


def timeline_hourly(results: DataFrame) -> DataFrame:
    return (results.groupBy(F.date_trunc("hour", "processed_at").alias("hour"))
                   .agg(F.count(F.lit(1)).alias("pages")))


def timeline_span(results: DataFrame) -> DataFrame:
    """first_at, last_at, duration in microseconds, total; no row without results."""
    return (results.agg(F.min("processed_at").alias("first_at"), F.max("processed_at").alias("last_at"),
                        F.count(F.lit(1)).alias("total"))
                   .filter("total > 0")
                   .withColumn("duration_us", F.unix_micros("last_at") - F.unix_micros("first_at")))


def domain_stats(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Per report domain: pages, e-mails, errors, success rate and average time in whole ns."""
    stats = (results.select(report_domain(F.col("url")).alias("domain"), F.size("emails").alias("n_emails"),
                            "error", "process_time")
                    .filter("domain <> ''").groupBy("domain")
                    .agg(F.count(F.lit(1)).alias("pages"), F.sum("n_emails").alias("emails"),
                         _errors().alias("errors"), F.sum("process_time").alias("_time")))
    out = stats.select("domain", "pages", "emails", "errors",
                       _percent(F.col("pages") - F.col("errors"), F.col("pages")).alias("success_rate"),
                       F.expr("_time div pages").alias("avg_time_ns"))
    return out if limit is None else out.orderBy(F.col("pages").desc(), "domain").limit(limit)


def top_domains(results: DataFrame, limit: int = 10) -> DataFrame:
    domain = report_domain(F.col("url"))
    return (results.select(domain.alias("domain")).filter("domain <> ''").groupBy("domain")
                   .agg(F.count(F.lit(1)).alias("pages"))
                   .orderBy(F.col("pages").desc(), "domain").limit(limit))


def metrics_summary(results: DataFrame, links_checked: Column | None = None) -> DataFrame:
    """The live counters, from stored rows.

    Keywords count occurrences. A row blocked by robots counts as processed but
    not as an error. Dead-link rows come from the background check: they add to
    the dead counters but were never processed as pages. Without results the
    success rate is 100.
    """
    occurrences = F.aggregate(F.map_values("keywords"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    is_page = (F.size("dead_links") == 0) & (F.size("dead_domains") == 0)
    if links_checked is None:  # the stored number, where the hunt kept it
        links_checked = F.col("links_checked") if "links_checked" in results.columns else F.size("new_urls")
    rows = results.select(is_page.alias("page"), F.size("emails").alias("e"), occurrences.alias("k"),
                          F.when(is_page, links_checked).otherwise(0).alias("l"),
                          F.size("dead_links").alias("dl"), F.size("dead_domains").alias("dd"), "error")
    totals = rows.agg(
        F.count_if("page").alias("urls_processed"), _total(F.col("e")).alias("emails_found"),
        _total(F.col("k")).alias("keywords_found"), _total(F.col("l")).alias("links_checked"),
        _total(F.col("dl")).alias("dead_links_found"), _total(F.col("dd")).alias("dead_domains_found"),
        F.count_if((F.col("error") != "") & (F.col("error") != BLOCKED)).alias("errors"))
    finds = (F.col("emails_found") + F.col("keywords_found") + F.col("dead_links_found")
             + F.col("dead_domains_found"))
    return totals.withColumn("total_finds", finds).withColumn(
        "success_rate", F.coalesce(_percent(F.col("urls_processed") - F.col("errors"),
                                            F.col("urls_processed")), F.lit(100.0)))


def processing_rate(results: DataFrame) -> DataFrame:
    """Rows per second and per minute between the first and the last result; 0 for no span."""
    span = results.agg(F.count(F.lit(1)).alias("processed"),
                       (F.unix_micros(F.max("processed_at")) - F.unix_micros(F.min("processed_at")))
                       .alias("elapsed_us"))
    per_second = F.coalesce(F.try_divide(F.col("processed") * 1_000_000.0, F.col("elapsed_us")), F.lit(0.0))
    return span.select("processed", F.coalesce("elapsed_us", F.lit(0)).alias("elapsed_us"),
                       per_second.alias("per_second"), (per_second * 60.0).alias("per_minute"))


def mode_counters(results: DataFrame) -> DataFrame:
    """The counters kept with the store: every stored row counts, keywords count once per row."""
    return results.agg(
        F.count(F.lit(1)).alias("urls_processed"), _total(F.size("emails")).alias("emails_found"),
        _total(F.size("keywords")).alias("keywords_found"),
        _total(F.size("dead_links")).alias("dead_links_found"),
        _total(F.size("dead_domains")).alias("dead_domains_found"), _errors().alias("errors"))


def rate_between_snapshots(results: DataFrame, interval_seconds: int = 60) -> DataFrame:
    """snapshot_at, processed, elapsed_seconds, per_second for each interval with results.

    A snapshot is taken at the end of every interval that saw a result, and the
    rate is what came since the previous snapshot. An ordering of all intervals
    would be one task, so the previous snapshot is looked up within a day, and
    across days from the one-row-per-day table.
    """
    if interval_seconds < 1:
        raise ValueError("snapshots less than a second apart keep the previous rate; use at least 1")
    slot = F.floor(F.unix_seconds("processed_at") / F.lit(interval_seconds)).cast("bigint")
    counts = results.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("processed"))
    counts = counts.withColumn("end", (F.col("slot") + 1) * interval_seconds) \
                   .withColumn("day", F.floor(F.col("slot") * interval_seconds / 86_400))
    in_day = Window.partitionBy("day").orderBy("slot")
    local = counts.withColumn("previous", F.lag("end").over(in_day))
    # One row per day: a century has fewer than 40,000.
    days = counts.groupBy("day").agg(F.max("end").alias("last")) \
                 .withColumn("before", F.lag("last").over(Window.orderBy("day"))).select("day", "before")
    elapsed = F.col("end") - F.coalesce("previous", "before")
    return local.join(F.broadcast(days), "day").select(
        F.timestamp_seconds("end").alias("snapshot_at"), "processed",
        elapsed.alias("elapsed_seconds"),
        F.try_divide(F.col("processed").cast("double"), elapsed).alias("per_second"))
