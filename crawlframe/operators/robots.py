"""robots.txt: rules, verdicts, sitemaps and delays, following the public exclusion standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.urls import url_host, url_path
from ..schemas import RESULT_COLUMNS
from .dedup import first_per_key
from .skew import balanced_lookup

BLOCKED = "blocked by robots.txt"

_SEP = "\u0001"


def _records(body: Column) -> Column:
    """The lines that matter as (kind, value): U agent, A allow, D disallow, C crawl-delay."""
    lines = F.transform(F.split(F.replace(body, F.lit(_SEP), F.lit("")), r"\r\n|\r|\n"),
                        lambda l: F.regexp_replace(l, r"#.*$", ""))
    fields = F.transform(lines, lambda l: F.struct(
        F.lower(F.regexp_extract(l, r"^\s*([A-Za-z-]+)\s*:", 1)).alias("field"),
        F.regexp_extract(l, r"^[^:]*:\s*(.*?)\s*$", 1).alias("value")))
    kinds = F.create_map(*[F.lit(x) for pair in (
        ("user-agent", "U"), ("allow", "A"), ("disallow", "D"), ("crawl-delay", "C")) for x in pair])
    kept = F.filter(fields, lambda f: f["field"].isin("user-agent", "allow", "disallow", "crawl-delay"))
    return F.transform(kept, lambda f: F.concat(kinds[f["field"]], f["value"]))


def _groups(body: Column) -> Column:
    """Array of groups, each an array of records.

    An agent line that follows a rule opens a new group; consecutive agent
    lines share one. Marking those places and splitting there is linear in the
    body and needs neither a window nor a shuffle.
    """
    joined = F.array_join(_records(body), "\n")
    marked = F.regexp_replace(joined, r"(?m)^([^U\n].*)\n(?=U)", f"$1{_SEP}")
    return F.transform(F.split(marked, _SEP), lambda g: F.split(g, "\n"))


def _values(records: Column, kind: str) -> Column:
    return F.transform(F.filter(records, lambda r: F.startswith(r, F.lit(kind))),
                       lambda r: F.substring(r, 2, 1 << 30))


def _usable(robots: DataFrame) -> DataFrame:
    """Only a 200 answer has rules; any other answer allows everything. Of several answers of a host the last counts, by
    ``fetched_at`` if there is such a column."""
    order = [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in robots.columns else []
    last = first_per_key(robots, ["host"], [*order, F.col("status"), F.col("body").desc_nulls_last()])
    return last.filter(F.col("status") == 200)


def robots_rules(robots: DataFrame) -> DataFrame:
    """host, agent, rule, pattern, pattern_len: one row per agent and line.

    ``rule`` is allow, disallow or crawl-delay. An empty allow or disallow
    matches nothing and is left out.
    """
    groups = _usable(robots).select("host", F.explode(_groups(F.col("body"))).alias("records"))
    agents = groups.select("host", "records", F.explode(_values(F.col("records"), "U")).alias("agent"))
    lines = agents.select("host", F.lower("agent").alias("agent"), F.explode("records").alias("record"))
    kind = F.substring("record", 1, 1)
    rule = (F.when(kind == "A", "allow").when(kind == "D", "disallow")
             .when(kind == "C", "crawl-delay"))
    return (lines.select("host", "agent", rule.alias("rule"),
                         F.substring("record", 2, 1 << 30).alias("pattern"))
                 .filter("rule IS NOT NULL AND pattern <> ''")
                 .withColumn("pattern_len", F.length("pattern")))


def robots_policy(robots: DataFrame, agent: str) -> DataFrame:
    """host, rules, crawl_delay: what applies to one agent, one row per host.

    The longest agent name that starts the given one wins, then ``*``. Groups
    naming the same agent are merged.
    """
    me = F.lit(agent.lower())

    def names(group: Column) -> Column:
        return F.transform(_values(group, "U"), F.lower)

    def choose(groups: Column) -> Column:
        named = F.filter(F.flatten(F.transform(groups, names)),
                         lambda a: (a != "") & (a != "*") & F.startswith(me, a))
        best = F.array_max(F.transform(named, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]
        return let(F.coalesce(best, F.lit("*")),
                   lambda a: F.flatten(F.filter(groups, lambda g: F.array_contains(names(g), a))))

    def rule(kind: str, allow: bool):
        return lambda records: F.transform(
            F.filter(_values(records, kind), lambda p: p != ""),
            lambda p: F.struct(F.length(p).alias("pattern_len"), F.lit(allow).alias("allow"),
                               p.alias("pattern")))

    chosen = _usable(robots).select("host", let(_groups(F.col("body")), choose).alias("records"))
    records = F.col("records")
    delay = F.try_element_at(_values(records, "C"), F.lit(-1)).try_cast("double")
    return chosen.select("host", F.concat(rule("A", True)(records), rule("D", False)(records)).alias("rules"),
                         F.coalesce(delay, F.lit(0.0)).alias("crawl_delay"))


def _matches(path: Column, pattern: Column) -> Column:
    """Prefix match; ``*`` stands for any run of characters, a final ``$`` for the end."""
    anchored = F.endswith(pattern, F.lit("$"))
    glob = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\%_])", r"\\$1")
    glob = F.concat(F.replace(glob, F.lit("*"), F.lit("%")), F.when(anchored, "").otherwise("%"))
    plain = ~anchored & ~F.contains(pattern, F.lit("*"))
    return F.when(plain, F.startswith(path, pattern)).otherwise(F.like(path, glob))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Add ``host`` and ``allowed``; the longest matching pattern wins, allow wins a tie.

    Only the path is tested. The rules of a host travel as one array, so a URL
    meets them in one row instead of being multiplied by them. All columns of
    ``urls`` go through the join: hand over narrow rows, never page bodies.
    """
    hosted = (urls.withColumn("host", url_host(F.col("url")))
                  .withColumn("_path", url_path(F.col("url"))))
    policy = robots_policy(robots, agent).select("host", "rules")
    joined = balanced_lookup(hosted, policy, "host")
    path = F.when(F.col("_path") == "", "/").otherwise(F.col("_path"))
    winner = F.array_max(F.transform(F.filter("rules", lambda r: _matches(path, r["pattern"])),
                                     lambda r: F.struct(r["pattern_len"], r["allow"].alias("allow"))))
    allowed = F.when(F.col("_path").isNull(), False).otherwise(F.coalesce(winner["allow"], F.lit(True)))
    return joined.select(*urls.columns, "host", allowed.alias("allowed"))


def robots_blocked_rows(verdicts: DataFrame) -> DataFrame:
    """Error rows for blocked URLs; needs url, processed_at and allowed."""
    none = F.array().cast("array<string>")
    return verdicts.filter(~F.col("allowed")).select(
        "url", F.lit(0).alias("status_code"), F.lit("").alias("title"), none.alias("emails"),
        F.create_map().cast("map<string,int>").alias("keywords"), none.alias("dead_links"),
        none.alias("dead_domains"), none.alias("new_urls"), "processed_at",
        F.lit(0).cast("bigint").alias("process_time"), F.lit(BLOCKED).alias("error"),
    ).select(*RESULT_COLUMNS)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """host, pos, sitemap: the sitemap lines of every usable body, in order."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*([^\s#]+)"), F.lit(1))
    return _usable(robots).select("host", F.posexplode(found).alias("pos", "sitemap"))


def robots_crawl_delay(robots: DataFrame, agent: str) -> DataFrame:
    """host, crawl_delay in seconds: that of the agent's own group, else of ``*``, else 0."""
    policy = robots_policy(robots, agent).select("host", "crawl_delay")
    return robots.select("host").distinct().join(policy, "host", "left") \
                 .select("host", F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"))
