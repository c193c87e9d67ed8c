"""Reading stored results and frontier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.text import frontier_key, store_key
from ..schemas import CRAWL_RESULT, FRONTIER


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """Stored rows with a fixed schema; a row that cannot be decoded fails the read."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def scan_results(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Results with their store key, in key order if a limit has to pick the first ones."""
    keyed = results.withColumn("store_key", store_key(F.col("url"), F.col("processed_at")))
    return keyed if limit is None else keyed.orderBy("store_key", "dead_links").limit(limit)


def scan_frontier(frontier: DataFrame, limit: int | None = None) -> DataFrame:
    """Frontier rows with their store key, in key order if a limit has to pick the first ones."""
    keyed = frontier.withColumn("store_key", frontier_key(F.col("url")))
    return keyed if limit is None else keyed.orderBy("store_key").limit(limit)


def read_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, CRAWL_RESULT, fmt)


def read_frontier(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, FRONTIER, fmt)


def mark_lenient(lines: DataFrame, schema: StructType = CRAWL_RESULT) -> DataFrame:
    """The fields of each JSON text in ``value``, whether it is ``rejected``, and the text itself of those that are."""
    bad = "_corrupt"
    wide = StructType(schema.fields + [StructField(bad, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parsed = lines.filter(F.trim("value") != "").select(
        "value", F.from_json("value", wide, options).alias("r"))
    good = F.col(f"r.{bad}").isNull() & F.startswith(F.ltrim(F.col("value")), F.lit("{"))
    return parsed.withColumn("rejected", ~good).select(
        *[F.when(~F.col("rejected"), F.col(f"r.{f.name}")).alias(f.name) for f in schema],
        F.when(F.col("rejected"), F.col("value")).alias("value"), "rejected")


def decode_lenient(lines: DataFrame, schema: StructType = CRAWL_RESULT) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a table with one JSON text per row in ``value``."""
    marked = mark_lenient(lines, schema)
    return marked.filter(~F.col("rejected")).select(*schema.names), marked.filter("rejected").select("value")


def split_lenient(lines: DataFrame, path: str, schema: StructType = CRAWL_RESULT) -> tuple[DataFrame, DataFrame]:
    """Like ``decode_lenient``, but the input is read and parsed once: both parts are written to ``path`` in one pass."""
    mark_lenient(lines, schema).write.mode("overwrite").partitionBy("rejected").parquet(path)
    return read_split(lines.sparkSession, path, schema)


def read_split(spark: SparkSession, path: str, schema: StructType = CRAWL_RESULT) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) as ``split_lenient`` wrote them; each is a folder of its own, and the other is not read."""
    whole = StructType([*schema.fields, StructField("value", StringType()), StructField("rejected", BooleanType())])
    both = spark.read.schema(whole).parquet(path)
    return both.filter(~F.col("rejected")).select(*schema.names), both.filter("rejected").select("value")


def read_lenient(spark: SparkSession, path: str,
                 schema: StructType = CRAWL_RESULT) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): JSON lines that decode, and the text of those that do not."""
    return decode_lenient(spark.read.text(path), schema)
