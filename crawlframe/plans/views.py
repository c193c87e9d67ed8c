"""Unpivoted views of the results: findings and database entries, and what is counted over them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import keyword_finding, process_time_ms, result_key, store_key

def first_results(results: DataFrame, limit: int) -> DataFrame:
    """The first results in store-key order."""
    if limit < 1:
        raise ValueError(f"a limit must be positive, not {limit}; leave it out for all results")
    key = store_key(F.col("url"), F.col("processed_at"))
    return results.withColumn("store_key", key).orderBy("store_key", "dead_links").limit(limit)


def _nothing_found() -> Column:
    return ((F.size("emails") == 0) & (F.size("keywords") == 0)
            & (F.size("dead_links") == 0) & (F.size("dead_domains") == 0))


FINDING_TYPES = ("email", "keyword", "dead_link", "dead_domain", "success", "error")


def findings(results: DataFrame, types: Collection[str] = FINDING_TYPES) -> DataFrame:
    """type, source_url, data, found_at: one row per finding, else one per result.

    All kinds are put in one array and exploded, so the results are read once.
    With fewer ``types`` only the columns of those are read.
    """
    def kind(name: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(name).alias("type"), x.alias("data")))

    keywords = F.transform(F.map_entries("keywords"), lambda e: keyword_finding(e["key"], e["value"]))
    outcome = F.when(F.col("error") == "", "success").otherwise("error")
    page = F.struct(outcome.alias("type"), F.concat(
        F.lit("Status: "), F.col("status_code").cast("string"), F.lit(", Title: "), F.col("title")).alias("data"))
    plain = F.when(_nothing_found() & outcome.isin(*types), F.array(page)).otherwise(F.array())
    arrays = {"email": kind("email", F.col("emails")), "keyword": kind("keyword", keywords),
              "dead_link": kind("dead_link", F.col("dead_links")),
              "dead_domain": kind("dead_domain", F.col("dead_domains"))}
    parts = [array for name, array in arrays.items() if name in types]
    if "success" in types or "error" in types:
        parts.append(plain)
    return results.select(F.col("url").alias("source_url"), F.col("processed_at").alias("found_at"),
                          F.explode(F.concat(*parts)).alias("f")) \
                  .select("f.type", "source_url", "f.data", "found_at")


def findings_by_type(results: DataFrame, finding_type: str) -> DataFrame:
    """Findings of one type."""
    if finding_type not in FINDING_TYPES:
        raise ValueError(f"unknown finding type: {finding_type}")
    return findings(results, [finding_type])


def db_view(results: DataFrame, limit: int | None = None) -> DataFrame:
    """One entry per result and kind of finding, else one ``general`` entry.

    Without a limit the id is the result key, which is unique. With one, the limit applies to
    results before they are unpivoted, and ids count them: ``result_1`` and on.
    ``search_text`` is the flattened data the search looks at.
    """
    if limit is None:
        rows = results.withColumn("id", result_key())
    else:
        # At most ``limit`` rows reach this window.
        order = Window.orderBy("store_key", "dead_links")
        rows = first_results(results, limit).withColumn(
            "id", F.concat(F.lit("result_"), F.row_number().over(order).cast("string")))

    def entry(kind: str, size: Column, raw: Column, text: Column, shown: Column) -> Column:
        return F.when(shown, F.struct(F.lit(kind).alias("data_type"), size.alias("data_count"),
                                      raw.alias("raw_data"), text.alias("search_text")))

    def of_list(kind: str) -> Column:
        return entry(kind, F.size(kind), F.to_json(kind), F.array_join(kind, " "), F.size(kind) > 0)

    sorted_keywords = F.map_from_entries(F.array_sort(F.map_entries("keywords")))
    general = F.to_json(F.struct("title"))
    entries = F.array_compact(F.array(
        of_list("emails"),
        entry("keywords", F.size("keywords"), F.to_json(sorted_keywords),
              F.array_join(F.array_sort(F.map_keys("keywords")), " "), F.size("keywords") > 0),
        of_list("dead_links"), of_list("dead_domains"),
        entry("general", F.lit(0), general, general, _nothing_found())))
    return rows.select(
        "id", "url", "processed_at", "status_code",
        process_time_ms(F.col("process_time")).alias("process_time_ms"),
        (F.col("error") != "").alias("has_error"), F.col("error").alias("error_message"),
        F.explode(entries).alias("e")).select(
        "id", "url", "processed_at", "e.data_type", "e.data_count", "status_code", "process_time_ms",
        "has_error", "error_message", "e.raw_data", "e.search_text")


def _entry_kinds() -> tuple[list[str], Column]:
    """The entry kinds of a result, as the charts group them, without building the entries."""
    dead = (F.size("dead_links") > 0).cast("int") + (F.size("dead_domains") > 0).cast("int")
    emails = (F.size("emails") > 0).cast("int")
    keywords = (F.size("keywords") > 0).cast("int")
    others = _nothing_found().cast("int")
    return ["Emails", "Keywords", "Dead Links", "Others"], F.array(emails, keywords, dead, others)


def db_view_stats(results: DataFrame) -> DataFrame:
    """Record counts, distinct values, mean process time and success rate of the database view.

    A result with several kinds of findings counts once per kind, as in the
    view. Distinct values come from one narrow (kind, value) table that is
    de-duplicated before it is counted.
    """
    _, kinds = _entry_kinds()
    counted = results.select("process_time", "error", kinds.alias("k")).select(
        F.col("k")[0].alias("e"), F.col("k")[1].alias("w"), F.col("k")[2].alias("d"),
        (F.col("k")[0] + F.col("k")[1] + F.col("k")[2] + F.col("k")[3]).alias("n"),
        "process_time", "error")
    totals = counted.agg(
        F.sum("n").alias("total_records"), F.sum("e").alias("email_records"),
        F.sum("w").alias("keyword_records"), F.sum("d").alias("dead_link_records"),
        F.sum(F.col("process_time") * F.col("n")).alias("_time"),
        F.sum(F.when(F.col("error") != "", F.col("n")).otherwise(0)).alias("_errors"))
    unique = distinct_counts(results, {
        "unique_urls": F.array("url"), "unique_emails": F.col("emails"),
        "unique_keywords": F.map_keys("keywords"),
        "unique_dead_links": F.concat("dead_links", "dead_domains")})
    return totals.crossJoin(unique).select(
        F.coalesce("total_records", F.lit(0)).alias("total_records"), "unique_urls",
        F.coalesce("email_records", F.lit(0)).alias("email_records"), "unique_emails",
        F.coalesce("keyword_records", F.lit(0)).alias("keyword_records"), "unique_keywords",
        F.coalesce("dead_link_records", F.lit(0)).alias("dead_link_records"), "unique_dead_links",
        F.try_divide(process_time_ms(F.col("_time")), F.col("total_records")).alias("avg_process_time_ms"),
        F.try_divide((F.col("total_records") - F.col("_errors")) * 100.0, F.col("total_records"))
         .alias("success_rate"))


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row with the number of distinct elements of each array column.

    All arrays are exploded together as (kind, value); duplicates go before
    the shuffle, and every input row is read once. Several COUNT(DISTINCT)
    would multiply the rows instead.
    """
    names = list(values)

    def tag(kind: int, items: Column) -> Column:
        return F.transform(items, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    tagged = F.concat(*[tag(i, values[n]) for i, n in enumerate(names)])
    unique = df.select(F.explode(tagged).alias("t")).select("t.kind", "t.value").distinct()
    return unique.agg(*[F.count_if(F.col("kind") == i).alias(n) for i, n in enumerate(names)])


def data_type_distribution(results: DataFrame) -> DataFrame:
    """label, records: entries of the database view by kind, all four labels always present."""
    names, kinds = _entry_kinds()
    labels = F.array(*[F.lit(n) for n in names])
    totals = results.select(kinds.alias("k")).agg(
        *[F.coalesce(F.sum(F.col("k")[i]), F.lit(0)).alias(f"c{i}") for i in range(4)])
    counts = F.array(*[F.col(f"c{i}") for i in range(4)])
    return totals.select(F.explode(F.arrays_zip(labels.alias("label"), counts.alias("records"))).alias("z")) \
                 .select("z.label", "z.records")


def findings_timeline(results: DataFrame) -> DataFrame:
    """minute, emails, keywords, dead_links: entries of the database view per minute."""
    _, kinds = _entry_kinds()
    return (results.select(F.date_trunc("minute", "processed_at").alias("minute"), kinds.alias("k"))
                   .groupBy("minute").agg(F.sum(F.col("k")[0]).alias("emails"),
                                          F.sum(F.col("k")[1]).alias("keywords"),
                                          F.sum(F.col("k")[2]).alias("dead_links")))
