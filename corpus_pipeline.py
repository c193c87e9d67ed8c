"""From raw documents to a training mix: five stages, each over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from crawlframe.llm.common import bounded_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores at its threshold or above go.

    NULL and empty texts score 0 and stay. Repeated rows score alike, so all or none of them stay. An empty table gives no rows.
    """
    bounded_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    NULL and empty texts are one group; a NULL doc_id ranks below all others; of rows equal in doc_id and text any one
    stays. An empty table gives no rows.
    """
    bounded_batches(spark)
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash the one with the smallest doc_id stays, one of each component.

    NULL and empty texts are one component; a NULL doc_id counts as the largest; of rows that tie, or are repeated, one
    stays. An empty table gives no rows.
    """
    bounded_batches(spark)
    return simhash.without_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    NULL and empty texts stay. Repeated rows stay or go together. An empty benchmark takes nothing, an empty table gives no rows.
    """
    bounded_batches(spark)
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pass, block and place in the block of the mix; a document may come in several passes.

    NULL sources are a source of their own. NULL and empty texts have no tokens and come in the passes that reach them.
    Repeated rows are taken each on its own; which of equal ones is at the edge is open. An empty table gives an empty mix.
    """
    bounded_batches(spark)
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The network of the first stage is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
