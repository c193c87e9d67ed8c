"""Exact duplicates by exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange
from .common import all_columns, fresh, stored, table, text_of

#: Rows whose fingerprints one block sends.
BLOCK_ROWS = 500_000
#: Bits of the filter that keeps unsuspected texts out of the shuffle; fixed, 8 MB, whatever the corpus.
FILTER_BITS = 26


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row number, block, 64-bit fingerprint and SHA-256 of each row's text; stored, so that they stay."""
    # a row id is the number of the partition and, in its 33 lower bits, of the row there
    rows = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), text_of("text").alias("text"))
    return stored(rows.select(
        "doc_id", "row",
        F.concat_ws("-", F.shiftright("row", 33).cast("string"),
                    F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS).cast("string")).alias("part"),
        F.xxhash64("text").alias("fp"), F.sha2("text", 256).alias("sha")), "fingerprints")


def suspects(prints: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once, distinct per block; every repeated text is among them."""
    total = prints.count()
    span = exchange.owner_span(64, total)

    def values(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        return exchange.as_frame(exchange.messages(0, 0, values(pdf)[0], span)).assign(part=pdf["part"].iloc[0])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part").reset_index(drop=True)
        out = exchange.answer_repeated(pdf.assign(block=np.arange(len(pdf), dtype=np.int32)))
        return out.assign(part=pdf["part"].to_numpy()[out["block"].to_numpy()])

    def receive(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"fp": np.zeros(0, np.int64)})
        found, times = values(own)
        flags = exchange.flags_of(found, span, dict(zip(answers["owner"], answers["payload"])))
        return pd.DataFrame({"fp": found[flags | (times > 1)].view(np.int64)})

    narrow = prints.select("part", "fp")
    message = f"{exchange.MESSAGE}, part string"
    sent = narrow.groupBy("part").applyInPandas(send, message)
    answered = sent.groupBy("owner").applyInPandas(merge, message)
    return (narrow.groupBy("part").cogroup(answered.select("part", "owner", "payload").groupBy("part"))
            .applyInPandas(receive, "fp long"))


def membership_filter(prints: DataFrame, bits: int = FILTER_BITS):
    """A function from a fingerprint column to a boolean one: true for all of ``prints``, and for few others.

    The bitmap has a fixed size and is gathered from OR-ed 64-bit words. With very many fingerprints it lets more
    others pass, which only widens the shuffle behind it.
    """
    spot = F.col("fp").bitwiseAND((1 << bits) - 1)
    cells = (prints.select(F.shiftrightunsigned(spot, 6).alias("cell"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect())
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[[r["cell"] for r in cells]] = [r["bits"] for r in cells]
    shared = prints.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def passes(fp: pd.Series) -> pd.Series:
        v = fp.to_numpy(np.int64).view(np.uint64)
        cell = shared.value[(v & np.uint64((1 << bits) - 1)) >> np.uint64(6)]
        return pd.Series((cell >> (v & np.uint64(63))) & np.uint64(1) == 1)

    return passes


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, fp, keep_id, group_size, kept, text_sha256.

    Blocks send their sorted fingerprints to owners and get a bitmap of the repeated ones back; only rows with a
    repeated fingerprint are shuffled with their text. Grouping by the text itself, after map-side grouping, is the
    byte verification. Of equal texts the row with the largest doc_id stays.

    NULL texts count as empty, and empty texts form one group. A NULL doc_id ranks below all others. Rows that
    repeat a doc_id and its text belong to the group; exactly one of them can stay. An empty table gives no rows.
    Other columns are not read.
    """
    prints = fingerprints(docs)
    suspicious = stored(suspects(prints), "suspects").distinct()
    passes = membership_filter(suspicious)
    texts = docs.select(text_of("text").alias("text")).withColumn("fp", F.xxhash64("text"))
    verified = (texts.where(passes("fp")).groupBy("fp", "text").count()
                .groupBy("fp", F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("texts"), F.sum("count").alias("rows"))
                .where(F.col("rows") > 1)
                .where(F.when(F.col("texts") == 1, True).otherwise(
                    F.raise_error("two texts share a fingerprint and a SHA-256").cast("boolean"))))
    tops = (prints.join(suspicious, "fp", "left_semi").groupBy("fp", "sha")
            .agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
            .join(verified.select("fp", "sha"), ["fp", "sha"]))
    # stored, so that both sides of the join are plain exchanges and a hot text's rows can be split over tasks
    joined = prints.join(stored(tops, "tops"), ["fp", "sha"], "left")
    alone = F.col("top").isNull()
    return joined.select(
        "doc_id", "row", "fp", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Rows that repeat both doc_id and text differ in other columns at most; any one of them stays. NULL and empty texts
    are one group, whose row of the largest doc_id stays, NULL ranking below all ids. An empty table gives no rows.
    """
    found = stored(exact_duplicates(docs), "exact")
    repeated = found.where(F.col("group_size") > 1)
    passes = membership_filter(repeated.select("fp").distinct())
    sha, suspect, own_id, keep = fresh(docs, "__sha", "__suspect", "__id", "__keep")
    # a hash that cannot be NULL, so that no test for NULL works it out for all rows
    marked = docs.withColumns({sha: F.coalesce(F.sha2(text_of("text"), 256), F.lit("")), suspect: passes(F.xxhash64(text_of("text")))})
    keepers = found.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(keep))
    # keepers are unique, so this is a lookup; as a plain join it stays behind the grouping, which starts before the shuffle
    chosen = (marked.where(suspect).dropDuplicates(["doc_id", sha])
              .join(keepers, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(keep))).drop(own_id, keep))
    return marked.where(~F.col(suspect)).unionByName(chosen).select(all_columns(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
