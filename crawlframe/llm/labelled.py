"""Labelled samples and folds for the operators that learn from ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

FOLDS, HELD_FOLD = 4, 2
#: Stretches that a long text is learnt by.
PARTS = 4


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows no label may be learnt from; a NULL id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(True))


def part_of(text: Column, seed: Column, most: int, parts: int = PARTS) -> Column:
    """The text itself up to ``most`` characters; of a longer one, ``parts`` stretches of together ``most`` characters,
    one at a place chosen by ``seed`` in each of as many equal ranges of the text."""
    size, span = most // parts, F.floor(F.length(text) / parts).cast("int")
    place = lambda i: i * span + F.pmod(F.xxhash64(seed, F.lit(i)), span - size + 1).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(
        F.concat_ws("\n", *[F.substring(text, place(i), F.lit(size)) for i in range(parts)]))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, max_chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: at most ``per_class`` documents of either label, none of them held out.

    Documents come in the order of a hash of their id. Ids without a label, or without a document, are left out before
    any limit; a document with both labels counts as 1, and of several texts of one id the smallest is taken. A text
    of more than ``max_chars`` characters stands for itself by stretches of it (see ``part_of``).
    """
    known = (labels.where(F.col(column).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.col(column)).cast("int").alias("label")))
    # ids alone are shuffled, made distinct per task first; what comes of the limits is a list of bounded size
    present = known.join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id").withColumn("order", F.xxhash64("id"))
    ids = None
    for label in (0, 1):
        some = present.where(F.col("label") == label).orderBy("order", "id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of("text").alias("text"))
    chosen = texts.join(F.broadcast(ids), "id").withColumn("text", part_of(F.col("text"), F.col("id"), max_chars))
    rows = chosen.groupBy("id", "label", "order").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["label"], r["order"], r["id"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]
