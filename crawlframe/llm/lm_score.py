"""Stupid-backoff scores of documents from n-gram counts of the corpus."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange
from .common import stored, stored_alone, table, text_of
from .substring_dedup import word_hashes

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
#: Bits of an n-gram's hash beyond twice those of the corpus' size in bytes. Some N = size / 3 n-grams make N^2 / 2 pairs, so
#: that two of them anywhere share a hash in one corpus of 20,000, whatever its size.
SPARE_BITS = 10
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def ngram_hashes(words: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of the n-gram that ends at each word; the first ``order`` - 1 values are of no use."""
    value = words.copy()
    for back in range(1, order):
        value[back:] = value[back:] * np.uint64(_STEPS[0]) + words[:-back] * np.uint64(pow(_STEPS[1], back, 1 << 64))
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def extra_bytes(total: int) -> int:
    """Bytes of an n-gram's second hash that go beside the first for a corpus of ``total`` bytes."""
    return min(8, max(0, math.ceil((2 * math.log2(max(total, 2)) + SPARE_BITS - 64) / 8)))


def in_order(hashes: np.ndarray, seconds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by both hashes, and in that order whether an n-gram differs from the one before it."""
    def differs(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new, first = np.ones(len(by), bool), hashes[by]
        new[1:] = first[1:] != first[:-1]
        if seconds is None:
            return new, np.zeros(0, bool)
        second = seconds[by]
        return new, ~new[1:] & (second[1:] != second[:-1])

    by = np.argsort(hashes).astype(np.int32)
    new, shared = differs(by)
    if shared.any():  # different n-grams share the first hash
        by = np.lexsort((seconds, hashes)).astype(np.int32)
        new, shared = differs(by)
        new[1:] |= shared
    elif not new.all():
        # two quick sorts are faster than a stable one: the second puts equal n-grams back in order of their places
        by = (np.sort(np.cumsum(new) << 32 | by) & 0xFFFFFFFF).astype(np.int32)
    return by, new


class Grams:
    """The n-grams of one order in a block: distinct hashes in order, their counts, and by position the place and own count.

    ``words`` has the words' hashes, and a second one where ``extra`` bytes of the n-grams' second hash are used.
    """

    def __init__(self, words: list[np.ndarray], row: np.ndarray, start: np.ndarray, order: int, extra: int):
        self.at = np.flatnonzero(start >= order - 1).astype(np.int32)  # positions with enough words before them in their row
        hashes = ngram_hashes(words[0], order)[self.at]
        seconds = ngram_hashes(words[1], order)[self.at] >> np.uint64(64 - 8 * extra) if extra else None
        by, new = in_order(hashes, seconds)  # equal n-grams stay in the order of rows
        rows = row[self.at][by]
        self.distinct = hashes[by[new]]
        self.seconds = seconds[by[new]] if extra else None
        del hashes, seconds
        run = new.copy()
        run[1:] |= rows[1:] != rows[:-1]
        first = np.flatnonzero(new)
        self.counts = np.diff(np.append(first, len(by)))
        sizes = np.diff(np.append(np.flatnonzero(run), len(by)))
        self.place, self.own = np.empty(len(by), np.int32), np.empty(len(by), np.int32)
        self.place[by] = np.cumsum(new) - 1
        self.own[by] = np.repeat(sizes, sizes)


def _positions(pdf: pd.DataFrame, extra: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block, and of each word its row and place in the row; words of each row."""
    words, sizes = word_hashes(pdf["text"].tolist(), 2 if extra else 1)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    start = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    return words, row, start, sizes


def _narrow(counts: np.ndarray) -> bytes:
    """Whole numbers as one byte each, compressed, since most are one; places and values of those from 255 on come first,
    with their number."""
    large = np.flatnonzero(counts >= 255)
    return zlib.compress(b"".join((len(large).to_bytes(8, "little"), large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes(),
                     np.minimum(counts, 255).astype(np.uint8).tobytes())), 1)


def _wide(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:8], "little")
    places, values = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
    out = np.frombuffer(data, np.uint8, -1, 8 + 16 * n).astype(np.int64)
    out[places] = values
    return out


def _packed(hashes: np.ndarray, seconds: np.ndarray | None, counts: np.ndarray, extra: int) -> bytes:
    """Layout: size of the coded hashes (8 bytes), bytes of a second hash (1), coded hashes, second hashes, counts."""
    coded = exchange.golomb_encode(hashes)
    beside = seconds.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :extra].tobytes() if extra else b""
    return b"".join((len(coded).to_bytes(8, "little"), bytes([extra]), coded, beside, _narrow(counts)))


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    at, extra = 9 + int.from_bytes(payload[:8], "little"), payload[8]
    hashes, seconds = exchange.golomb_decode(payload[9:at]), None
    if extra:
        wide = np.zeros((len(hashes), 8), np.uint8)
        wide[:, :extra] = np.frombuffer(payload, np.uint8, len(hashes) * extra, at).reshape(-1, extra)
        seconds = wide.view("<u8")[:, 0]
    return hashes, seconds, _wide(payload[at + len(hashes) * extra:])


def others_of(grams: Grams, corpus: np.ndarray, contexts: np.ndarray | None, size: int) -> np.ndarray:
    """By position, the count of its n-gram in the other rows. It is never above that of the context, which is true of
    counts and stays true where hashes meet."""
    out = np.zeros(size, np.int64)
    out[grams.at] = corpus[grams.place] - grams.own
    if contexts is not None:
        out[grams.at] = np.minimum(out[grams.at], contexts[grams.at - 1])
    return out


def count_and_join(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of the count tables: adds up the blocks' counts of each n-gram, and joins the sums to each block's
    n-grams, in the order sent."""
    rows = []
    for kind, group in pdf.groupby("kind", sort=True):
        hashes, seconds, counts = zip(*map(_unpacked, group["payload"]))
        every, own = np.concatenate(hashes), np.concatenate(counts)
        by, new = in_order(every, None if seconds[0] is None else np.concatenate(seconds))
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        table_ = np.bincount(place, own).astype(np.int64)
        at = 0
        for block, owner, h in zip(group["block"], group["owner"], hashes):
            rows.append((block, owner, kind, _narrow(table_[place[at:at + len(h)]])))
            at += len(h)
    return exchange.as_frame(rows)


def dealt_out(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(key, missing, text in bytes, block) per row, and the number of blocks, whose mean text is ``block_bytes``.

    ``missing`` marks rows without a doc_id. A score does not depend on which texts share a block, so the hash of id and
    text deals the rows out: those of one id, or of none, spread like others.
    """
    text = text_of("text").cast("binary")
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    own_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own_id, F.lit(0)).alias("key"), own_id.isNull().alias("missing"), text.alias("text"),
                       F.pmod(F.xxhash64(own_id, text), F.lit(blocks)).cast("int").alias("block")), blocks


def scored(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_score (natural logarithm, summed over the words).

    A word after the ``order`` - 1 words before it scores c(n-gram) / c(context) if that count is above zero, else
    ``backoff`` times its score after one word less; alone it scores c(word) / N, and a word seen nowhere else counts
    as one, with one more ``backoff``. All counts are of the other rows: the row's own n-grams are taken off, as is its
    length from N, so that each text is judged by the rest of the corpus. Copies in other rows do count.

    Blocks of documents explode their texts into n-grams and count them, before anything is shuffled; the count tables
    are partitioned by ranges of the n-grams' hashes, where blocks' counts are summed and joined back to each block's
    n-grams, and a block sums the scores per document. An n-gram in a third of all texts comes once per block. What is
    exchanged grows with the text; orders follow one another, so that only one of them is on the disks at a time.
    Hashes have 64 bits, and as many bytes more as the size of the corpus asks for (``extra_bytes``); an n-gram never counts as seen more often than its context.

    Words are runs without white space, unchanged. NULL and empty texts have no words and log_score 0. A NULL doc_id
    stays NULL. Repeated rows are scored one by one, each against the other. An empty table gives no rows. Other
    columns are not read.
    """
    rows, blocks = dealt_out(docs, block_bytes)
    total = blocks * block_bytes
    extra = extra_bytes(total)
    span = exchange.owner_span(64, total // 3)

    def exploded(n: int):
        def explode(pdf: pd.DataFrame) -> pd.DataFrame:
            block, out = int(pdf["block"].iloc[0]), []
            words, row, start, _ = _positions(pdf, extra)
            grams = Grams(words, row, start, n, extra)
            for owner, a, b in exchange.slices(grams.distinct, span):
                hashes, seconds = grams.distinct[a:b] - np.uint64(owner * span), grams.seconds[a:b] if extra else None
                out.append((block, owner, n, _packed(hashes, seconds, grams.counts[a:b], extra)))
            return exchange.as_frame(out)

        return explode

    def add_up(pdf: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "missing", "n_words", "log_counts", "alone"]
        if pdf.empty:
            return pd.DataFrame([], columns=columns)
        words, row, start, sizes = _positions(pdf, extra)
        logs, alone, contexts = np.zeros(len(row)), np.ones(len(row), bool), None
        for n in range(1, order + 1):
            grams = Grams(words, row, start, n, extra)
            own = dict(zip(joined.loc[joined["kind"] == n, "owner"], joined.loc[joined["kind"] == n, "payload"]))
            corpus = np.zeros(len(grams.distinct), np.int64)
            for owner, a, b in exchange.slices(grams.distinct, span):
                corpus[a:b] = _wide(own[owner])
            others = others_of(grams, corpus, contexts, len(row))
            if n == 1:
                logs = np.log(np.maximum(others, 1)) + np.where(others > 0, 0.0, math.log(backoff))
            else:
                seen = (others > 0) & (start >= n - 1)
                back = (start >= n - 1) & ~seen
                logs[back] += math.log(backoff)
                at = np.flatnonzero(seen)
                logs[at] = np.log(others[at]) - np.log(contexts[at - 1])
                alone[at] = False
            contexts = others
            del grams, corpus
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "missing": pdf["missing"].to_numpy(), "n_words": sizes, "log_counts": np.bincount(row, logs, len(sizes)),
                             "alone": np.bincount(row, alone, len(sizes)).astype(np.int64)})[columns]

    by_block, message = rows.groupBy("block"), exchange.MESSAGE
    # one order after another, each off the disks when its counts are joined
    parts = [stored_alone(by_block.applyInPandas(exploded(n), message).groupBy("owner").applyInPandas(count_and_join, message), f"lm-{n}")
             for n in range(1, order + 1)]
    joined = reduce(DataFrame.unionByName, parts)
    sums = stored_alone(by_block.cogroup(joined.groupBy("block")).applyInPandas(add_up, "key long, missing boolean, n_words long, log_counts double, alone long"), "lm")
    n = sums.agg(F.sum("n_words")).first()[0] or 0
    return sums.select(F.when(~F.col("missing"), F.col("key")).alias("doc_id"), "n_words",
                       (F.col("log_counts") - F.col("alone") * F.log(F.greatest(F.lit(n) - F.col("n_words"), F.lit(1)))).alias("log_score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b,
             CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, r) AS n1,
             CASE WHEN b IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, r) END AS n2,
             CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, r) END AS n3 FROM p),
x AS (SELECT *, lag(n1) OVER o AS m1, lag(n2) OVER o AS m2, (SELECT count(*) FROM p) - count(*) OVER (PARTITION BY r) AS n FROM k WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, CASE WHEN n3 > 0 THEN ln(n3) - ln(m2)
                     WHEN n2 > 0 THEN ln(n2) - ln(m1) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                     ELSE ln(greatest(n1, 1)) - ln(greatest(n, 1)) + CASE WHEN n1 > 0 THEN 0 ELSE ln(0.4) END + least(i - 1, 2) * ln(0.4) END AS v FROM x)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(t, 0.0), 4) AS log_score
FROM d LEFT JOIN (SELECT r, sum(v) AS t FROM s GROUP BY r) USING (r)
"""
