"""Schemas of the crawl tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per stored crawl result. ``process_time`` is in nanoseconds, ``error`` is '' for success.
CRAWL_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("emails", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("dead_links", T.ArrayType(T.StringType())),
    T.StructField("dead_domains", T.ArrayType(T.StringType())),
    T.StructField("new_urls", T.ArrayType(T.StringType())),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("process_time", T.LongType()),
    T.StructField("error", T.StringType()),
])

# One row per URL waiting to be crawled.
FRONTIER = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("retries", T.IntegerType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

LINK_PROBE = T.StructType([
    T.StructField("link_url", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
])

RESULT_COLUMNS = CRAWL_RESULT.fieldNames()
FRONTIER_COLUMNS = FRONTIER.fieldNames()

# Columns a JSON record leaves out when they hold nothing.
OPTIONAL_RESULT_COLUMNS = ("emails", "keywords", "dead_links", "dead_domains", "new_urls", "error")

# JSON and CSV text keeps microseconds; the writers' default would cut them to milliseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
