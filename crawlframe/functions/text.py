"""Scalar work on page text and on the fields of a crawl result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .binding import let

# The e-mail pattern and the error labels every report uses.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ERROR_CATEGORIES = (
    ("Timeout", ("timeout",)),
    ("Connection Error", ("connection",)),
    ("Not Found (404)", ("404", "not found")),
    ("Forbidden (403)", ("403", "forbidden")),
    ("Server Error (5xx)", ("500", "internal server")),
    ("DNS Error", ("dns",)),
)
OTHER_ERROR = "Other"

# A match can only start where a run of such characters starts, or where the last match ended within one: from any
# later place of a run the same "@" and the same text behind it decide. So each run is looked at once.
_EMAIL_START = r"(?:\G|(?<![a-zA-Z0-9._%+-]))"


def extract_emails(content: Column) -> Column:
    """Distinct lower-cased e-mail addresses of the raw text, in order of first appearance; in time near its length."""
    found = F.regexp_extract_all(content, F.lit(_EMAIL_START + EMAIL_PATTERN), F.lit(0))
    # Most pages hold no address at all: the scan for '@' spares them the regex.
    return F.when(F.contains(content, F.lit("@")),
                  F.array_distinct(F.transform(found, F.lower))) \
            .otherwise(F.array().cast("array<string>"))


def count_keywords(content: Column, keywords: Sequence[str]) -> Column:
    """Map keyword -> number of non-overlapping, case-insensitive occurrences; zeros left out."""
    wanted = list(dict.fromkeys(keywords))
    if any(not k for k in wanted):
        raise ValueError("keywords must not be empty")
    if not wanted:
        return F.create_map().cast("map<string,int>")

    def counts(lowered: Column) -> Column:
        entries = []
        for keyword in wanted:
            needle = keyword.lower()
            # Byte lengths are stored with the string; character lengths would be counted anew.
            rest = F.octet_length(F.replace(lowered, F.lit(needle), F.lit("")))
            removed = F.octet_length(lowered) - rest
            entries += [F.lit(keyword), (removed / F.lit(len(needle.encode()))).cast("int")]
        return F.map_filter(F.create_map(*entries), lambda _, n: n > 0)

    return F.coalesce(let(F.lower(content), counts), F.create_map().cast("map<string,int>"))


def error_category(message: Column) -> Column:
    """Label of an error message; the first category that matches wins."""
    lowered = F.lower(message)
    label = None
    for name, needles in ERROR_CATEGORIES:
        hit = F.contains(lowered, F.lit(needles[0]))
        for needle in needles[1:]:
            hit = hit | F.contains(lowered, F.lit(needle))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(OTHER_ERROR)


def truncate_text(text: Column, max_length: int) -> Column:
    """At most ``max_length`` characters, the last three being dots when something was cut."""
    if max_length < 3:
        raise ValueError("max_length must be at least 3")
    return F.when(F.length(text) <= max_length, text) \
            .otherwise(F.concat(F.substring(text, 1, max_length - 3), F.lit("...")))


def keyword_finding(keyword: Column, count: Column) -> Column:
    """``the (found 3 times)``."""
    return F.format_string("%s (found %d times)", keyword, count)


def keyword_list_display(keywords: Column) -> Column:
    """``que (1), the (3)``, in keyword order."""
    entries = F.array_sort(F.map_entries(keywords))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(" ("), e["value"].cast("string"),
                                                F.lit(")"))), ", ")


def process_time_ms(nanoseconds: Column) -> Column:
    """Nanoseconds to milliseconds as a double."""
    return nanoseconds / F.lit(1_000_000.0)


def store_key(url: Column, processed_at: Column) -> Column:
    """Key of a stored result: one per URL and second; the key order is the scan order."""
    return F.concat(F.lit("result:"), url, F.lit("_"), F.unix_seconds(processed_at).cast("string"))


def result_key() -> Column:
    """Key of one row of the results: the store key, with the link for a dead-link row.

    All dead links of a page carry one time, so the store key alone would be shared.
    """
    key = store_key(F.col("url"), F.col("processed_at"))
    return F.when(F.size("dead_links") > 0, F.concat(key, F.lit("_"), F.array_join("dead_links", " "))).otherwise(key)


def frontier_key(url: Column) -> Column:
    """Key of a stored frontier row."""
    return F.concat(F.lit("url:"), url)
