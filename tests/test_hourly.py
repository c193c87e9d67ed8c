"""Stored totals per hour: two steps equal one, and only days that got rows are rewritten."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from crawlframe.plans import reports
from crawlframe.sources.hourly import STANDARD_ERROR, HourlyTotals
from tests.test_operators import result, results

START = datetime(2024, 1, 1)


def rows_of(kept):
    return {r["hour"]: (r["pages"], r["errors"], r["process_time"], r["day"]) for r in kept.rows().collect()}


def test_two_steps_equal_one_and_leave_other_days_alone(spark, tmp_path):
    rng = random.Random(1)
    rows = [result(f"http://h{rng.randrange(30)}.org/{i}", processed_at=START + timedelta(minutes=rng.randrange(5 * 1440)), process_time=i,
                   error="timeout" if i % 7 == 0 else "", emails=[f"a{rng.randrange(90)}@b.org"] * (i % 3), keywords={"k": 1} if i % 2 else {}) for i in range(600)]
    whole = results(spark, *rows)
    days = [date(2024, 1, d) for d in range(1, 6)]
    at_once, kept = (HourlyTotals(spark, str(tmp_path / n)) for n in ("once", "kept"))
    at_once.update(whole, days)
    kept.update(whole.filter(~((F.dayofmonth("processed_at").isin(2, 4)) & (F.col("process_time") % 5 == 0))), days)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    assert rows_of(kept) != rows_of(at_once)
    kept.update(whole, [date(2024, 1, 4), date(2024, 1, 2)])
    assert rows_of(kept) == rows_of(at_once)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    stayed = {p for p in before if after.get(p) == before[p]}
    assert {p.parent.name for p in stayed} == {f"day=2024-01-0{d}" for d in (1, 3, 5)} == {p.parent.name for p in before} - {p.parent.name for p in after.keys() - before.keys()}
    kept.update(whole, [])
    got, want = kept.totals().first(), reports.analyze_totals(spark.createDataFrame([], "url string"), whole).first()
    assert got["pages"] == 600 and got["errors"] == 86
    assert all(got[f"unique_{n}"] == want[f"unique_{n}"] for n in ("emails", "keywords", "domains"))
    assert sorted(map(tuple, kept.timeline().collect())) == sorted(map(tuple, reports.timeline_hourly(whole).collect()))


def test_merged_sketches_keep_their_error(spark, tmp_path):
    """60,000 addresses over 40 hours, most of them in several."""
    base = results(spark, result("http://a.org/", processed_at=START)).drop("emails", "processed_at")
    many = (spark.range(2_000).select((F.col("id") % 40).alias("h"), F.transform(F.sequence(F.col("id") * 29, F.col("id") * 29 + 1_000),
                                                                                  lambda x: F.concat(x.cast("string"), F.lit("@b.org"))).alias("emails"))
            .withColumn("processed_at", F.lit(START) + F.make_dt_interval(F.lit(0), F.col("h"))).crossJoin(base))
    kept = HourlyTotals(spark, str(tmp_path / "kept"))
    kept.update(many, [date(2024, 1, 1), date(2024, 1, 2)])
    exact = many.select(F.explode("emails").alias("e")).distinct().count()
    got = kept.totals().first()
    assert got["pages"] == 2_000 and exact > 50_000
    assert abs(got["unique_emails"] - exact) <= 4 * STANDARD_ERROR * exact


def test_days_reach_the_scan(spark, tmp_path):
    results(spark, *[result(f"http://h/{i}", processed_at=START + timedelta(days=i)) for i in range(9)]).write.parquet(str(tmp_path / "results"))
    kept = HourlyTotals(spark, str(tmp_path / "kept"))
    kept.update(spark.read.parquet(str(tmp_path / "results")), [date(2024, 1, 3)])
    assert kept.totals().first()["pages"] == 1


def test_nothing_stored(spark, tmp_path):
    kept = HourlyTotals(spark, str(tmp_path / "kept"))
    kept.update(results(spark, result("http://h/", processed_at=START)), [date(2023, 1, 1)])
    assert kept.rows().count() == 0 and kept.totals().first()["pages"] is None
