"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def balanced_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, which has at most one row per key.

    Both sides are shuffled by the key, and nothing else is read or counted. The adaptive planner splits a partition of
    ``left`` that is far larger than the others over several tasks, each with the partition of ``right`` beside it; a
    hot key costs its one right row once more per task. That holds for the joins allowed here, whose left rows can be
    split, and only while no other operator asks for the same partitioning above the join.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    return left.join(right, key, how)
