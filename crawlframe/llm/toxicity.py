"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import all_columns, fold_table, fresh, table, text_of
from .labelled import held_out, labelled_sample

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
#: Lengths of the character sequences of a word, its start and end counting as a character.
GRAMS = (3, 4, 5)
#: Labelled rows of either class that the network is fitted on, and the characters learnt of a text.
TRAIN_ROWS, TRAIN_CHARS = 1_500, 20_000
#: Steps of the fit, windows in a step, and rate of the first steps.
STEPS, BATCH, RATE = 400, 128, 0.01
THRESHOLD = 0.3
#: Words a task remembers, and windows it scores at a time.
REMEMBERED, AT_ONCE = 200_000, 4_096

_FOLD = fold_table(keep_marks=False)


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its word bucket; the buckets of its character sequences, end to end; where each word's begin."""
    points = np.frombuffer((" " + " ".join(w.decode("utf-8", "replace") for w in vocabulary) + " ").encode("utf-32-le"), np.uint32)
    points = points.astype(np.uint64)
    spaces = points == 32
    word_at = np.cumsum(spaces) - 1
    inner = np.concatenate(([0], np.cumsum(spaces)))
    places, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        ok = inner[n - 1:n - 1 + size] - inner[1:1 + size] == 0  # only the ends may be spaces
        value = np.full(size, n, np.uint64)
        for i in range(n):
            value = (value ^ points[i:i + size]) * np.uint64(0x100000001B3)
            value ^= value >> np.uint64(29)
        places.append(word_at[:size][ok])
        buckets.append(((value[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
    place, bucket = np.concatenate(places), np.concatenate(buckets)
    order = np.argsort(place, kind="stable")
    place, bucket = place[order], bucket[order]
    starts = np.searchsorted(place, np.arange(len(vocabulary)))
    from xxhash import xxh64_intdigest

    own = np.array([xxh64_intdigest(w, 1) % WORD_BUCKETS for w in vocabulary], np.int64)
    return own, bucket, starts


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start among all words, length) of all overlapping windows; a document without words has none."""
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    length = np.minimum(WINDOW, sizes[doc] - nth * STRIDE)
    return doc, begin[doc] + nth * STRIDE, length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """All weights, in single precision."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def random(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        size, out = WORD_DIM + CHAR_DIM, 3 * HIDDEN
        p = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM))}
        for d in "fb":
            p |= {f"W{d}": rng.normal(0, size ** -0.5, (size, out)), f"U{d}": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, out)), f"c{d}": np.zeros(out)}
        p |= {"attend": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.array([-1.0])}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Input vector of each word: its word embedding beside the scaled sum of its character embeddings."""
        out = np.zeros((len(own), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][own]
        counts = np.diff(np.append(starts, len(grams)))
        some = counts > 0
        if some.any():
            sums = np.add.reduceat(self.p["char"][grams], starts[some], axis=0)
            out[some, WORD_DIM:] = sums / np.sqrt(counts[some])[:, None]
        return out

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input parts of the gates."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], 1)

    def gates(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray, size: int = 20_000) -> np.ndarray:
        """``projected`` of the ``inputs`` of all words, some at a time."""
        ends, out = np.append(starts, len(grams)), []
        for a in range(0, len(own), size):
            b = min(a + size, len(own))
            out.append(self.projected(self.inputs(own[a:b], grams[ends[a]:ends[b]], starts[a:b] - ends[a])))
        return np.concatenate(out)

    def score(self, gates: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logit of each window of ``ids``; ``gates`` has the projected input of each id."""
        out = np.empty(len(starts), np.float32)
        order = np.argsort(-lengths, kind="stable")  # so that the windows still open at a step come first
        for at in range(0, len(order), AT_ONCE):
            rows = order[at:at + AT_ONCE]
            out[rows] = self._score(gates, ids, starts[rows], lengths[rows])
        return out

    def _score(self, gates, ids, starts, lengths):
        steps, n = int(lengths[0]), len(starts)
        open_at = np.searchsorted(-lengths, -np.arange(steps), "left")  # windows longer than t
        logits, values = np.zeros((n, steps), np.float32), np.zeros((n, steps), np.float32)
        for k, d in enumerate("fb"):
            U = self.p[f"U{d}"]
            own = gates[:, k * 3 * HIDDEN:(k + 1) * 3 * HIDDEN]
            attend, project = self.p["attend"][k * HIDDEN:(k + 1) * HIDDEN], self.p["out"][k * HIDDEN:(k + 1) * HIDDEN]
            both = np.stack((attend, project), 1)
            h = np.zeros((n, HIDDEN), np.float32)
            for step in range(steps):
                m = int(open_at[step])
                at = starts[:m] + step if d == "f" else starts[:m] + lengths[:m] - 1 - step
                g, hu = own[ids[at]], h[:m] @ U
                rz = sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
                new = np.tanh(g[:, 2 * HIDDEN:] + rz[:, :HIDDEN] * hu[:, 2 * HIDDEN:])
                h[:m] = new + rz[:, HIDDEN:] * (h[:m] - new)
                seen = h[:m] @ both
                if d == "f":
                    logits[:m, step] += seen[:, 0]
                    values[:m, step] += seen[:, 1]
                else:
                    back = lengths[:m] - 1 - step
                    logits[np.arange(m), back] += seen[:, 0]
                    values[np.arange(m), back] += seen[:, 1]
        logits[np.arange(steps) >= lengths[:, None]] = -np.inf
        weight = np.exp(logits - logits.max(1, keepdims=True))
        return (weight * values).sum(1) / weight.sum(1) + self.p["bias"][0]

    def gradients(self, words, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over windows: ``ids`` is (window, step) into the words of ``words``."""
        own, grams, starts = words
        p, n, T = self.p, len(ids), ids.shape[1]
        x = self.inputs(own, grams, starts)
        m = mask.astype(np.float32)[:, :, None]
        saved, outputs = {}, []
        for d in "fb":
            G = (x @ p[f"W{d}"] + p[f"c{d}"])[ids]
            U, h = p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            H, states = np.zeros((n, T, HIDDEN), np.float32), []
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                hu = h @ U
                rz = sigmoid(G[:, t, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(G[:, t, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
                states.append((t, h, hu, r, z, new))
                h = m[:, t] * (new + z * (h - new)) + (1 - m[:, t]) * h
                H[:, t] = h
            saved[d] = states
            outputs.append(H)
        H = np.concatenate(outputs, 2)
        s = np.where(mask, H @ p["attend"], -1e9)
        a = np.exp(s - s.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * H).sum(1)
        y = sigmoid(pooled @ p["out"] + p["bias"][0])
        dl = ((y - labels) / n).astype(np.float32)
        grad = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["out"]
        da = (H * dpool[:, None, :]).sum(2)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        grad["attend"] = np.tensordot(ds, H, ((0, 1), (0, 1)))
        dH = a[:, :, None] * dpool[:, None, :] + ds[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        flat = ids.reshape(-1)
        order = np.argsort(flat, kind="stable")
        firsts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        for k, d in enumerate("fb"):
            U, dU = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
            dG, carry = np.zeros((n, T, 3 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, hu, r, z, new in reversed(saved[d]):
                dh = dH[:, t, k * HIDDEN:(k + 1) * HIDDEN] + carry
                live = m[:, t] * dh
                dn = live * (1 - z) * (1 - new * new)
                dz = live * (h - new) * z * (1 - z)
                dr = dn * hu[:, 2 * HIDDEN:] * r * (1 - r)
                dG[:, t] = np.concatenate((dr, dz, dn), 1)
                dhu = np.concatenate((dr, dz, dn * r), 1)
                dU += h.T @ dhu
                carry = (dh - live) + live * z + dhu @ U.T
            grad[f"U{d}"] = dU
            by_word = np.add.reduceat(dG.reshape(-1, 3 * HIDDEN)[order], firsts, axis=0)
            used = flat[order][firsts]
            grad[f"W{d}"] = x[used].T @ by_word
            grad[f"c{d}"] = by_word.sum(0)
            dx[used] += by_word @ p[f"W{d}"].T
        grad["word"] = _sums(own, dx[:, :WORD_DIM], WORD_BUCKETS)
        counts = np.diff(np.append(starts, len(grams)))
        grad["char"] = _sums(grams, np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0), CHAR_BUCKETS)
        return grad


def _sums(buckets: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each bucket."""
    return np.stack([np.bincount(buckets, rows[:, j], size) for j in range(rows.shape[1])], 1).astype(np.float32)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for k, g in grad.items():
            g = g * np.float32(scale)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            up = self.m[k] / (1 - 0.9 ** self.t) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-7)
            self.p[k] -= (self.rate * up).astype(np.float32)


def _log_odds(have: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per bucket: how much more of the positive than of the negative documents have it, as a log ratio."""
    return np.log((have[1] + 0.5) / (labels.sum() + 1)) - np.log((have[0] + 0.5) / ((1 - labels).sum() + 1))


def _features_in_parts(vocabulary: list[bytes], size: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features``, worked out for some words at a time."""
    parts = [features(vocabulary[i:i + size]) for i in range(0, len(vocabulary), size)]
    before = np.cumsum([0] + [len(p[1]) for p in parts])
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int32) for p in parts]),
            np.concatenate([p[2] + n for p, n in zip(parts, before)]))


def train(texts: list[str], labels: list[int], seed: int = 0) -> Network | float:
    """The fitted network, or the share of label 1 where only one label (or none: 0) is there.

    Labels hold for documents, scores for windows: each round takes each document's window of the highest score, and
    another at random from the negative documents. In the first round log-odds of the inputs stand in for the score;
    they also start one dimension of either embedding.
    """
    y = np.array(labels, np.float32)
    lists = [tokens(t) for t in texts]
    full = [i for i, w in enumerate(lists) if w]
    y, lists = y[full], [lists[i] for i in full]
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for words in lists for w in words})
    index = {w: i for i, w in enumerate(vocabulary)}
    ids = np.fromiter((index[w] for words in lists for w in words), np.int64)
    sizes = np.array([len(w) for w in lists])
    own, grams, starts = _features_in_parts(vocabulary)
    counts = np.diff(np.append(starts, len(grams)))
    net = Network.random(seed)
    ends = np.cumsum(sizes)
    have = {"word": np.zeros((2, WORD_BUCKETS)), "char": np.zeros((2, CHAR_BUCKETS))}
    for label, a, b in zip(y.astype(int), ends - sizes, ends):
        used = np.unique(ids[a:b])
        have["word"][label][np.unique(own[used])] += 1
        have["char"][label][np.unique(grams[_spread(starts[used], counts[used])])] += 1
    word_odds, char_odds = (_log_odds(have[k], y) for k in ("word", "char"))
    net.p["word"][:, 0] += 0.3 * np.clip(word_odds, -1, 3)
    net.p["char"][:, 0] += 0.3 * np.clip(char_odds, -1, 3)
    best = np.full(len(vocabulary), -9.0)
    some = counts > 0
    best[some] = np.maximum.reduceat(char_odds[grams], starts[some])
    best = np.maximum(best, word_odds[own])
    doc, start, length = windows_of(sizes)
    cumulative = np.concatenate(([0], np.cumsum(np.exp(np.minimum(best, 4))[ids])))
    scores = cumulative[start + length] - cumulative[start]
    adam = Adam(net.p, RATE)
    while adam.t < STEPS:
        adam.rate = RATE * (1 - 0.8 * adam.t / STEPS)
        order = np.lexsort((-scores, doc))
        top = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        others = rng.permutation(np.flatnonzero(y[doc] == 0))[:len(top)]
        chosen = rng.permutation(np.concatenate((top, others, top[y[doc[top]] == 1])))
        for at in range(0, len(chosen), BATCH):
            part = chosen[at:at + BATCH]
            steps = int(length[part].max())
            mask = np.arange(steps) < length[part][:, None]
            at_word = np.where(mask, ids[np.minimum(start[part][:, None] + np.arange(steps), len(ids) - 1)], ids[start[part]][:, None])
            used, local = np.unique(at_word, return_inverse=True)
            local = local.reshape(at_word.shape)
            bits = counts[used]
            net_words = own[used], grams[_spread(starts[used], bits)], np.concatenate(([0], np.cumsum(bits)))[:-1]
            adam.step(net.gradients(net_words, local, mask, y[doc[part]]))
        if adam.t < STEPS:
            scores = net.score(net.gates(own, grams, starts), ids, start, length)
    return net


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes of the runs that begin at ``starts``."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(int(counts.sum()))


class Scorer:
    """Scores texts in batches, remembering the projected inputs of words."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _ids(self, lists: list[list[bytes]]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.index = {}
        index = self.index
        new = {w for words in lists for w in words if w not in index}
        if new:
            new = sorted(new)
            at = len(index)
            need = at + len(new)
            if need > len(self.gates):
                self.gates = np.concatenate((self.gates, np.zeros((need, 6 * HIDDEN), np.float32)))
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                self.gates[at + i:at + i + len(part)] = self.net.projected(self.net.inputs(*features(part)))
            index.update(zip(new, range(at, need)))
        return np.fromiter((index[w] for words in lists for w in words), np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest score of a text's windows; 0 for a text without words."""
        lists = [tokens(t) for t in texts]
        ids = self._ids(lists)
        doc, start, length = windows_of(np.array([len(w) for w in lists], np.int64))
        out = np.zeros(len(texts))
        if len(doc):
            np.maximum.at(out, doc, sigmoid(self.net.score(self.gates, ids, start, length).astype(np.float64)))
        return out


def with_toxicity(docs: DataFrame, labels: DataFrame, column: str = "__score", per_class: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with the toxicity score of each text, between 0 and 1, in ``column``; other columns are kept, and where
    one has that name the new one gets underscores before it.

    The network is fitted on at most ``per_class`` labelled rows of either class that are not held out, of long ones on
    stretches of TRAIN_CHARS characters together. It scores windows of WINDOW words, each STRIDE words on, of each whole
    text: every run of up to WINDOW - STRIDE + 1 words lies whole in a window. The highest window decides. NULL and empty texts, and texts without words,
    score 0. Without labels, or with one class only, every text with words gets the share of label 1. Repeated rows
    get equal scores. An empty table gives no rows.
    """
    fitted = train(*labelled_sample(docs, labels, "toxic", per_class, TRAIN_CHARS))
    shared = docs.sparkSession.sparkContext.broadcast(fitted.p if isinstance(fitted, Network) else fitted)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fixed = shared.value
        scorer = Scorer(Network(fixed)) if isinstance(fixed, dict) else None
        for texts in batches:
            found = texts.tolist()
            if scorer is None:
                yield pd.Series([float(fixed) if tokens(t) else 0.0 for t in found])
            else:
                yield pd.Series(scorer.scores(found))

    return docs.withColumn(fresh(docs, column)[0], score(text_of("text")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns.

    NULL and empty texts score 0 and stay, unless ``threshold`` is 0. Repeated rows score alike, so all or none of them
    stay; a score equal to ``threshold`` goes. An empty table gives no rows.
    """
    score, = fresh(docs, "__score")
    return with_toxicity(docs, labels, score).where(F.col(score) < threshold).select(all_columns(docs))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
