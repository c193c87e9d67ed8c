"""Quality by a factorisation machine over hashed words, structure statistics and metadata of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, table, text_of
from .labelled import held_out, labelled_sample

WORD_BUCKETS = 1 << 16
FACTORS = 8
#: Upper bounds of the bins each structure statistic falls in.
BINS = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SIZE_BINS = tuple(2.0 ** k for k in range(0, 24))
#: Labelled rows of either class the machine is fitted on, and the characters learnt of a text.
TRAIN_ROWS, TRAIN_CHARS = 3_000, 20_000
STEPS, BATCH, RATE, DECAY = 600, 128, 0.02, 1e-4
THRESHOLD = 0.7
REMEMBERED = 300_000

_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MARK = np.isin(np.arange(256), list(_MARKS))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)))
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_HIGH = np.arange(256) >= 128
_CLASSES = np.stack([_MARK, _DIGIT, _UPPER, _LETTER, _SPACE, _HIGH], 1).astype(np.int64)


def statistics(text: bytes, found: list[bytes]) -> tuple[list[float], list[float]]:
    """Shares (0 to 1) and sizes that describe the structure of a text, its metadata among them.

    Shares: marks, digits, capitals, letters, white space and bytes beyond ASCII; the commonest mark; distinct words;
    the commonest word; words with a mark at the end, inside, only of marks, all in capitals; lines that repeat; short
    lines; lines without a full stop. Sizes: bytes, words, lines, bytes per word (times 4), words per line.
    """
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _CLASSES / n).tolist()
    words = max(1, len(found))
    tally: dict[bytes, int] = {}
    for w in found:
        tally[w] = tally.get(w, 0) + 1
    lines = text.split(b"\n")
    own = {}
    for line in lines:
        own[line] = own.get(line, 0) + 1
    ended = only = inside = capital = 0
    for w, k in tally.items():
        bare = w.rstrip(_MARKS)
        ended += k * (len(bare) < len(w))
        only += k * (not bare)
        capital += k * (len(bare) > 1 and bare.isupper())
        inside += k * (not bare.lstrip(_MARKS).isalnum() and bool(bare) and bare.isascii())
    shares += [counts[_MARK].max() / n, len(tally) / words, max(tally.values(), default=0) / words, ended / words, inside / words,
               only / words, capital / words, 1 - len(own) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
               sum(not x.rstrip().endswith(b".") for x in lines) / len(lines)]
    return [float(s) for s in shares], [float(len(text)), float(len(found)), float(len(lines)), 4.0 * len(text) / words, len(found) / len(lines)]


N_SHARES, N_SIZES = 16, 5
SIZE = WORD_BUCKETS + N_SHARES * (len(BINS) + 1) + N_SIZES * (len(SIZE_BINS) + 1)


class Inputs:
    """Sparse inputs of texts; remembers the buckets of words."""

    def __init__(self):
        self.buckets: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, values): hashed words with a damped, normalised count, then one bin of each statistic."""
        found = text.lower().split()
        shares, sizes = statistics(text, text.split())
        buckets = self.buckets
        if len(buckets) > REMEMBERED:
            buckets.clear()
        own = []
        for w in found:
            b = buckets.get(w)
            if b is None:
                b = buckets[w] = xxhash.xxh64_intdigest(w, 3) % WORD_BUCKETS
            own.append(b)
        index, count = np.unique(np.array(own, np.int64), return_counts=True)
        value = np.log1p(count)
        norm = np.sqrt((value * value).sum())
        at = WORD_BUCKETS
        bins = at + np.arange(N_SHARES) * (len(BINS) + 1) + np.searchsorted(BINS, shares)
        at += N_SHARES * (len(BINS) + 1)
        sized = at + np.arange(N_SIZES) * (len(SIZE_BINS) + 1) + np.searchsorted(SIZE_BINS, sizes)
        index = np.concatenate((index, bins, sized))
        value = np.concatenate((value / max(norm, 1e-9), np.full(N_SHARES + N_SIZES, (N_SHARES + N_SIZES) ** -0.5)))
        return index, value.astype(np.float32)


@dataclass
class Machine:
    """Bias, linear weights and factor vectors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def random(cls, seed: int = 0) -> Machine:
        rng = np.random.default_rng(seed)
        return cls(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and the sums of its weighted factors. Pairs are never formed: the interactions of all pairs
        are half of (square of the sum minus sum of the squares), so the work is linear in the inputs."""
        weighted = self.factors[index] * value[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat((weighted * weighted).sum(1), starts)
        linear = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, index, value, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(index, value, starts)[0].astype(np.float64), -60, 60)))


def _joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(i) for i, _ in rows]
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum([0] + sizes)[:-1]


def train(texts: list[str], labels: list[int], seed: int = 0) -> Machine | float:
    """The fitted machine, or the share of label 1 where only one label (or none: 0) is there.

    Both classes weigh alike in the fit.
    """
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    inputs = Inputs()
    rows = [inputs.of(t.encode("utf-8", "replace")) for t in texts]
    rng, machine = np.random.default_rng(seed), Machine.random(seed)
    squares = [np.full_like(machine.linear, 1e-6), np.full_like(machine.factors, 1e-6)]
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for step in range(STEPS):
        part = rng.integers(0, len(rows), BATCH)
        index, value, starts = _joined([rows[i] for i in part])
        logits, sums = machine.logits(index, value, starts)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[part]) * weight[part] / BATCH
        sizes = np.diff(np.append(starts, len(index)))
        e = np.repeat(error, sizes) * value
        used, place = np.unique(index, return_inverse=True)
        order = np.argsort(place, kind="stable")
        firsts = np.flatnonzero(np.diff(place[order], prepend=-1))
        pull = e[:, None] * (np.repeat(sums, sizes, axis=0) - machine.factors[index] * value[:, None])
        for slot, weights, grad in ((0, machine.linear, e), (1, machine.factors, pull)):
            g = np.add.reduceat(grad[order], firsts, axis=0) + DECAY * weights[used]
            squares[slot][used] += g * g
            weights[used] -= RATE * 5 * g / np.sqrt(squares[slot][used])
        machine.bias -= RATE * float(error.sum())
    return machine


def with_quality(docs: DataFrame, labels: DataFrame, column: str = "__score", per_class: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with the quality score of each text, between 0 and 1, in ``column``; other columns are kept, and where
    one has that name the new one gets underscores before it.

    The machine is fitted on at most ``per_class`` labelled rows of either class that are not held out, of long ones on
    stretches of TRAIN_CHARS characters together, and scores whole texts. Its metadata are sizes of the text itself; ids, languages and sources are no inputs. NULL counts as
    the empty text, which is scored like others: it has no words, and a bin of each statistic. Without labels, or with
    one class only, each text gets the share of label 1. Repeated rows get equal scores. An empty table gives no rows.
    """
    fitted = train(*labelled_sample(docs, labels, "quality", per_class, TRAIN_CHARS))
    plain = (fitted.bias, fitted.linear, fitted.factors) if isinstance(fitted, Machine) else fitted
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fixed = shared.value
        machine, inputs = (Machine(*fixed), Inputs()) if isinstance(fixed, tuple) else (None, None)
        for texts in batches:
            if machine is None:
                yield pd.Series([fixed] * len(texts), dtype="float64")
            elif len(texts):
                yield pd.Series(machine.scores(*_joined([inputs.of(bytes(t)) for t in texts])))
            else:
                yield pd.Series([], dtype="float64")

    return docs.withColumn(fresh(docs, column)[0], score(text_of("text").cast("binary")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
