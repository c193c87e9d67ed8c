"""Row filters, searches and listings over results and frontier."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import error_category, frontier_key, result_key, store_key, truncate_text
from ..functions.urls import is_valid_url, report_domain
from ..schemas import TIMESTAMP_FORMAT

NOT_HTML = "skipped non-HTML content: "


def is_html(content_type: Column) -> Column:
    """True for an absent content type, text/html and application/xhtml in any spelling."""
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    return ((lowered == "") | F.contains(lowered, F.lit("text/html"))
            | F.contains(lowered, F.lit("application/xhtml")))


def html_content_filter(fetched: DataFrame) -> DataFrame:
    """Blank the body of anything but HTML and say so in ``error``; HTML stays whole."""
    html = is_html(F.col("content_type"))
    return (fetched.withColumn("error", F.when(html, "").otherwise(
                        F.concat(F.lit(NOT_HTML), F.col("content_type"))))
                   .withColumn("body", F.when(html, F.col("body")).otherwise("")))


def valid_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.filter(is_valid_url(F.col(column)))


def filter_results(results: DataFrame, status: int | None = None, domain: str | None = None,
                   has_error: bool | None = None, category: str | None = None,
                   content_type: str | None = None) -> DataFrame:
    """Results by status, report domain, error flag, error category or content type."""
    out = results
    if status is not None:
        out = out.filter(F.col("status_code") == status)
    if domain is not None:
        out = out.filter(report_domain(F.col("url")) == domain)
    if has_error is not None:
        out = out.filter((F.col("error") != "") if has_error else (F.col("error") == ""))
    if category is not None:
        out = out.filter((F.col("error") != "") & (error_category(F.col("error")) == category))
    if content_type is not None:
        out = out.filter(F.contains(F.lower("content_type"), F.lit(content_type.lower())))
    return out


def search_results(results: DataFrame, term: str) -> DataFrame:
    """Results with the term in URL, title, an e-mail or a keyword, ignoring case.

    Adds the e-mails and keyword counts that matched.
    """
    needle = F.lit(term.lower())

    def hit(text: Column) -> Column:
        return F.contains(F.lower(text), needle)

    return results.filter(hit(F.col("url")) | hit(F.col("title")) | F.exists("emails", hit)
                          | F.exists(F.map_keys("keywords"), hit)) \
                  .withColumn("matching_emails", F.filter("emails", hit)) \
                  .withColumn("matching_keywords", F.map_filter("keywords", lambda k, _: hit(k)))


def filter_db_view(entries: DataFrame, data_type: str | None = None, term: str = "") -> DataFrame:
    """Database-view entries of one kind and with a term, as the filtered view exports them."""
    kept = entries if data_type is None else entries.filter(F.col("data_type") == data_type)
    return search_db_view(kept, term)


def search_db_view(entries: DataFrame, term: str) -> DataFrame:
    """Database-view entries with the term in the URL or in their flattened data."""
    if not term:
        return entries
    needle = F.lit(term.lower())
    return entries.filter(F.contains(F.lower("url"), needle) | F.contains(F.lower("search_text"), needle))


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"timestampFormat": TIMESTAMP_FORMAT})


_RESULT, _URL = "result:", "url:"
#: Where the second of a result key may stand: digits between underscores or at the end.
_SECOND = r"_-?[0-9]+(?=_|%s)"


def possible_urls(key: str) -> list[str]:
    """URLs a store key can belong to. A URL may itself hold an underscore and digits, so there can be several."""
    if key.startswith(_RESULT):
        return [key[len(_RESULT):m.start()] for m in re.finditer(_SECOND % r"\Z", key) if m.start() >= len(_RESULT)]
    return [key[len(_URL):]] if key.startswith(_URL) else []


def _possible_urls(key: Column) -> Column:
    """``possible_urls`` as an expression: what stands before each place where the second may stand."""
    rest = F.substring(key, len(_RESULT) + 1, 1 << 30)
    # the texts between such places, put together again from the left with the seconds they were cut at
    cuts = F.regexp_extract_all(rest, F.lit("(?s).*?" + _SECOND % r"\z"), F.lit(0))
    fronts = F.transform(cuts, lambda c, i: F.regexp_replace(F.array_join(F.slice(cuts, 1, i + 1), ""), r"_-?[0-9]+\z", ""))
    return F.when(F.startswith(key, F.lit(_RESULT)), fronts).when(
        F.startswith(key, F.lit(_URL)), F.array(F.substring(key, len(_URL) + 1, 1 << 30))).otherwise(F.array().cast("array<string>"))


def lookup_keys(frontier: DataFrame, results: DataFrame, keys: DataFrame) -> DataFrame:
    """key, database, raw_value for every asked ``key``; database and value are NULL if it is unknown.

    Keys are made distinct first. Rows of both tables and asked keys are joined by the key, so that a row's value is
    shuffled once and the unknown keys are found without moving it again; few keys are broadcast, and no row moves.
    What a key says about its URL is checked where they meet. A dead-link row answers to its result key, which holds
    the link. A NULL among the keys is one unknown key; it goes beside the joins, which then share the shuffled keys.
    """
    asked = keys.filter(F.col("key").isNotNull()).select("key").distinct()
    # never NULL, or the planner would parse all keys a second time, to drop such before they are made distinct
    wanted = asked.withColumn("_urls", F.coalesce(_possible_urls(F.col("key")), F.array().cast("array<string>")))

    def stored(df: DataFrame, key: Column, name: str) -> DataFrame:
        return df.select(key.alias("_key"), "url", F.lit(name).alias("database"), _json(df).alias("raw_value"))

    rows = stored(frontier, frontier_key(F.col("url")), "URLs").unionByName(stored(results, result_key(), "Results"))
    found = rows.join(wanted, (rows["_key"] == wanted["key"]) & F.array_contains(wanted["_urls"], rows["url"]))
    answers = asked.join(found.select("key", "database", "raw_value"), "key", "left")
    null = F.lit(None).cast("string")
    return answers.unionByName(keys.filter(F.col("key").isNull()).limit(1).select(
        "key", null.alias("database"), null.alias("raw_value")))


def lookup_key(frontier: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """database, key, raw_value for one store key, no row if it is unknown.

    The key says which URLs it can belong to, and that reaches the scan: with the layout of ``sinks.store_by_url``
    only files, row groups and pages that can hold them are read.
    """
    urls = possible_urls(key)
    database, df, own_key = ("Results", results, result_key()) if key.startswith(_RESULT) else ("URLs", frontier, frontier_key(F.col("url")))
    if not urls:
        return df.limit(0).select(F.lit(database).alias("database"), F.lit(key).alias("key"), _json(df).alias("raw_value"))
    return df.filter(F.col("url").isin(urls) & (own_key == key)).select(
        F.lit(database).alias("database"), F.lit(key).alias("key"), _json(df).alias("raw_value")).limit(1)


def list_urls(frontier: DataFrame, limit: int) -> DataFrame:
    """The first frontier rows in key order."""
    return frontier.select("url", "depth", "retries", "timestamp").orderBy("url").limit(limit)


def list_results(results: DataFrame, limit: int) -> DataFrame:
    """Summary lines of the first results in key order."""
    key = store_key(F.col("url"), F.col("processed_at"))
    first = results.withColumn("store_key", key).orderBy("store_key", F.col("status_code").desc(),
                                                         "dead_links").limit(limit)
    return first.select(
        "store_key", "url", "status_code", truncate_text(F.col("title"), 50).alias("title"),
        "processed_at", "process_time", F.size("emails").alias("emails"),
        F.size("keywords").alias("keywords"), F.size("dead_links").alias("dead_links"),
        truncate_text(F.col("error"), 100).alias("error"))
