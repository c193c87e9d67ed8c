"""Helpers the corpus operators share: tables, stored intermediates, blocks of documents."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lineage import application_folder

#: A NULL id is handled as the largest one.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python small: texts are long, and a batch is held whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared checkpoint folder and read it back.

    The stored rows, row ids included, stay the same whatever executor is lost later.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/corpus/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """Like ``stored``, and what was shuffled for it goes from the disks at once, not when the driver's garbage is collected."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before those that ``docs`` already has as columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def all_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def text_of(column: Column | str) -> Column:
    """The text, NULL counting as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: bytes) -> list[bytes]:
    """Maximal runs without the six ASCII white-space characters."""
    return text.split()


def fold_table(keep_marks: bool) -> bytes:
    """A byte table that lower-cases A-Z; without ``keep_marks`` other ASCII than letters and digits becomes a space.

    Bytes of 128 and more belong to multi-byte characters and stay.
    """
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if "A" <= c <= "Z":
            out[b] = b + 32
        elif not keep_marks and not c.isalnum():
            out[b] = 32
    return bytes(out)


def in_blocks(docs: DataFrame, column: str = "text", block_bytes: int = 12 << 20) -> tuple[DataFrame, int]:
    """(key, text in bytes, block) per row, dealt out by ranges of the id, and the number of blocks.

    Block numbers rise with the id, rows of one id share a block, and the mean block holds ``block_bytes`` of
    text. The bounds are quantiles of the ids, at most one per block; they are constants of the plan, so every
    later use, and every recomputed task, deals a row to the same block.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    rows = docs.select(key.alias("key"), text_of(column).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    bounds = []
    if blocks > 1:
        parts = [i / blocks for i in range(1, blocks)]
        bounds = rows.agg(F.percentile_approx("key", parts, max(10_000, 8 * blocks))).first()[0]
    edges = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def block_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), "left").astype(np.int32))

    return rows.withColumn("block", block_of("key")), len(edges) + 1
