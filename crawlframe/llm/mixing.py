"""Mixing sources to target weights by temperature, realised as permutations of blocks under a token budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from .common import fresh, table, text_of

#: Aims of the query: entropy of the mix as a share of the largest possible one, and most passes over a source.
ENTROPY_SHARE, MOST_PASSES = 0.95, 4.0
#: Documents in one stretch of a source's permutation, on average.
STRETCH = 4_000
#: Rows of the plan, one per source, that are broadcast at most; a longer plan is joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Tokens in one block of the mix.
BLOCK_TOKENS = 1_000_000


def mix_of(shares: Sequence[float], exponent: float) -> list[float]:
    """Shares to the power ``exponent``, made to sum to one; a share of zero stays zero."""
    logs = [exponent * math.log(s) if s > 0 else -math.inf for s in shares]
    top = max(logs, default=0.0)
    raw = [math.exp(x - top) if x > -math.inf else 0.0 for x in logs]
    return [r / math.fsum(raw) for r in raw]


def entropy(weights: Sequence[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def passes_of(weights: Sequence[float], shares: Sequence[float], budget_share: float) -> float:
    """Most often that any source is gone through when the budget is ``budget_share`` of all tokens."""
    return max((budget_share * w / s for w, s in zip(weights, shares) if s > 0), default=0.0)


def temperature(shares: Sequence[float], entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES,
                budget_share: float = 1.0, steps: int = 60) -> float:
    """The largest exponent in [0, 1] whose mix has at least ``entropy_share`` of the largest entropy, raised where
    need be until no source is gone through more than ``most_passes`` times.

    Entropy falls and repetition of small sources falls too as the exponent rises from 0 (equal weights) to 1 (shares
    as they are), so either aim is met by bisection. Where even exponent 1 repeats more than ``most_passes`` times,
    which only a larger budget than the corpus brings about, the exponent is 1.
    """
    live = [s for s in shares if s > 0]
    if len(live) < 2:
        return 1.0
    goal = entropy_share * math.log(len(live))

    def bisect(good) -> float:
        """The end of [0, 1] up to which ``good`` holds, given that it holds at 0."""
        low, high = 0.0, 1.0
        if good(high):
            return high
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if good(middle) else (low, middle)
        return low

    for_entropy = bisect(lambda a: entropy(mix_of(live, a)) >= goal)
    too_often = lambda a: passes_of(mix_of(live, a), live, budget_share) > most_passes
    if not too_often(for_entropy):
        return for_entropy
    if too_often(1.0):
        return 1.0
    return min(1.0, bisect(too_often) + 2.0 ** -steps * 2)


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def mixture(docs: DataFrame, budget_share: float = 1.0, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES,
            block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The mix, one row per document and pass: the columns of ``docs``, then n_tokens, epoch, block and slot.

    Token shares of the sources are raised to an exponent found by bisection (see ``temperature``) and made weights;
    a source's budget is its weight times ``budget_share`` of all tokens. Each pass over a source is another
    permutation, by a hash of seed, pass and row; a document is taken while the tokens before it in the source's
    sequence of passes are below the budget. The sequence of each source is cut so that all sources fill every block
    in proportion to their weights: ``block`` is the place of the document's first token in the source's sequence, as
    a share of its budget, times the number of blocks. ``slot`` orders a block: blocks are permutations too.

    The permutations are cut into stretches of hash values, tokens are summed per stretch first, and only then within
    stretches, so a source with a third of all rows is dealt over many tasks. One row per source is gathered to find
    the exponent. A NULL source is a source of its own; a source without tokens, such as one of NULL and empty texts
    only, has no share. Rows without tokens are taken in the passes that reach them. Repeated rows are taken on their
    own; which of them is at the budget's edge is open. An empty table, or one without tokens, gives an empty mix. If
    ``docs`` has a column named as one of the four new ones, the new one gets underscores before its name.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own_id, source, text = (F.col(place[c]) for c in ("doc_id", "source", "text"))
    counted = docs.toDF(*place.values()).withColumns(
        {"tokens": token_count(text_of(text)), "hash": F.xxhash64(own_id, text_of(text))})
    facts = {r["source"]: (r["tokens"], r["rows"]) for r in counted.groupBy(source.cast("string").alias("source"))
             .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()}
    total = sum(t for t, _ in facts.values())
    names = sorted((s for s, (t, _) in facts.items() if t), key=lambda s: (s is None, s or ""))
    shares = [facts[s][0] / total for s in names]
    exponent = temperature(shares, entropy_share, most_passes, budget_share)
    weights = mix_of(shares, exponent) if names else []
    blocks = max(1, round(budget_share * total / block_tokens))
    plan = [(i, s, float(w * budget_share * total), math.ceil(w * budget_share * total / facts[s][0] - 1e-9),
             max(1, math.ceil(facts[s][1] / STRETCH))) for i, (s, w) in enumerate(zip(names, weights))]
    few = len(plan) <= BROADCAST_SOURCES
    plan = docs.sparkSession.createDataFrame(plan, "number int, name string, budget double, passes int, stretches int")
    drawn = (counted.join(F.broadcast(plan) if few else plan, source.cast("string").eqNullSafe(F.col("name")))
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
             .withColumn("order", F.xxhash64(F.lit(seed), "epoch", "hash"))
             # 31 bits of the hash give the stretch, in the order of the hash
             .withColumn("stretch", F.floor(F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-1 << 63)), 33)
                                            * F.col("stretches") / F.lit(float(1 << 31))).cast("int")))
    cut = ["number", "epoch", "stretch"]
    before = Window.partitionBy("number").orderBy("epoch", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (drawn.groupBy(cut).agg(F.sum("tokens").alias("sum"))
               .select(*cut, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")))
    near = Window.partitionBy(cut).orderBy("order", own_id).rowsBetween(Window.unboundedPreceding, -1)
    # join and window share one exchange of the rows
    placed = (drawn.join(offsets, cut).withColumn("at", F.col("offset") + F.coalesce(F.sum("tokens").over(near), F.lit(0)))
              .where(F.col("at") < F.col("budget")))
    added = fresh(docs, "n_tokens", "epoch", "block", "slot")
    return placed.select(
        *[F.col(place[c]).alias(c) for c in docs.columns], F.col("tokens").alias(added[0]), F.col("epoch").alias(added[1]),
        F.least(F.lit(blocks - 1), F.floor(F.col("at") / F.col("budget") * blocks)).cast("int").alias(added[2]),
        F.xxhash64(F.lit(seed + 1), "epoch", own_id, "at").alias(added[3]))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
