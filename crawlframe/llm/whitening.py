"""Whitening of embeddings: exact covariance on the cluster, eigenvectors refined from single precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

COMPONENTS = 8
#: Whole numbers are made of entries as floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Vectors per matrix product, and the bits of the parts that wider numbers are cut into: products stay below 2^53.
ROWS, PART_BITS = 1024, 21
#: Largest whole number taken; the sums of a batch then fit 64 bits.
LARGEST = 1 << 50
SWEEPS = 40
Wide = np.longdouble


def whole_vectors(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers, flags): one row for each vector that is kept, and for all vectors whether they are kept.

    NULL vectors, empty ones and those with a NULL or non-finite entry are not.
    """
    arrays = [None if v is None else np.asarray(v, np.float64) for v in vectors]
    kept = np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all()) for v in arrays], bool)
    rows = [v for v, k in zip(arrays, kept) if k]
    if not rows:
        return np.zeros((0, 0), np.int64), kept
    if len({len(v) for v in rows}) > 1:
        raise ValueError("vectors differ in length")
    x = np.floor(SCALE * np.stack(rows)) + SHIFT
    if np.abs(x).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST // SCALE}")
    return x.astype(np.int64), kept


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y^T y of whole numbers, exactly, as Python integers. Wide numbers are cut into parts whose products are exact."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        some, parts = y[at:at + ROWS], []
        while True:  # the last part keeps the sign
            if np.abs(some).max(initial=0) < 1 << PART_BITS:
                parts.append(some.astype(np.float64))
                break
            parts.append((some & ((1 << PART_BITS) - 1)).astype(np.float64))
            some = some >> PART_BITS
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                product = (a.T @ b).astype(np.int64).astype(object)
                out += product << (PART_BITS * (i + j)) if i + j else product
    return out


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per dimension and task: count and sum of the whole numbers."""
    n, total = 0, None
    for pdf in frames:
        x, _ = whole_vectors(pdf["v"])
        if len(x):
            own = x.sum(0).astype(object)
            if total is not None and len(total) != len(own):
                raise ValueError("vectors differ in length")
            n, total = n + len(x), own if total is None else total + own
    if n:
        yield pd.DataFrame({"dim": np.arange(len(total)), "n": n, "total": list(map(Decimal, total.tolist()))})


@dataclass(frozen=True)
class Whitening:
    """Count and sums per dimension of the fit list; eigenvalues, shares of the trace and unit eigenvectors (columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    vectors: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        if x.shape[1] != len(self.sums):
            raise ValueError("vectors differ in length")
        if self.n * (int(np.abs(x).max(initial=0)) + int(max(map(abs, self.sums.tolist()))) // max(self.n, 1) + 1) < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def squares(self, d: np.ndarray) -> np.ndarray:
        """Sum of squares of each row of deviations, exactly; an error where it is beyond 64 bits."""
        if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
            return (d * d).sum(1)
        return np.array([sum(v * v for v in row) for row in d.tolist()], np.int64)

    def project(self, d: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of deviations; NaN on components without variance."""
        known = self.values > 0
        out = np.full((len(d), len(self.values)), np.nan)
        out[:, known] = (d.astype(np.float64) / self.n) @ (self.vectors[:, known] / np.sqrt(self.values[known]))
        return out


def wide(whole: np.ndarray) -> np.ndarray:
    """Python integers as the widest floating-point numbers here, from two doubles each."""
    high = whole.astype(np.float64)
    low = np.vectorize(lambda v, h: float(v - int(h)), otypes=[np.float64])(whole, high) if whole.size else high
    return high.astype(Wide) + low.astype(Wide)


def refined(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix of the wide type.

    Single-precision eigenvectors are corrected by Ogita and Aishima's iteration: with R = I - X'X and S = X'AX, each
    sweep adds X E, where E divides S + value * R by the gap of two eigenvalues. It needs matrix products alone and
    converges quadratically where gaps are larger than the present error. Where they are not, the vectors of a cluster
    are turned by the eigenvectors of their own small matrix X'(A - shift)X, whose entries are small, so the cluster is
    resolved far below the size of A. Equal eigenvalues keep an orthonormal basis of their space.
    """
    d = len(a)
    size = Wide(np.abs(a).max(initial=0))
    if size == 0:
        return np.zeros(d, Wide), np.eye(d, dtype=Wide)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    eps = np.finfo(Wide).eps
    best = np.inf
    for _ in range(sweeps):
        r = np.eye(d, dtype=Wide) - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding alone makes them differ; over a small gap it would turn x out of square
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # twice a bound of the error of the values, from norms that bound the spectral one
        delta = 2 * (np.sqrt((off * off).sum()) + np.abs(values).max() * np.sqrt((r * r).sum())) + d * eps * np.abs(values).max()
        order = np.argsort(values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        cuts = np.flatnonzero(np.diff(values) > delta) + 1
        label = np.zeros(d, np.int64)
        label[cuts] = 1
        label = np.cumsum(label)
        gap = values[None, :] - values[:, None]
        apart = label[:, None] != label[None, :]
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, Wide(1)), r / 2)
        x = x + x @ e
        for part in np.split(np.arange(d), cuts):  # sub-solves
            if len(part) > 1:
                own = x[:, part]
                shift = values[part].mean()
                small = own.T @ (a @ own - shift * own)
                spread = np.abs(small).max()
                if spread > 0:
                    x[:, part] = own @ np.linalg.eigh((small / spread).astype(np.float64))[1].astype(Wide)
        change = float(np.abs(e).max())
        if change <= 8 * d * eps or (change >= best / 2 and change < 1e-15):
            break
        best = min(best, change)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on all vectors that ``whole_vectors`` keeps; None where there is none.

    Tasks add up whole numbers, centred on the whole number next to the mean before they are multiplied, and send one
    row per pair of dimensions; what the rounding of the centre leaves is taken off exactly. The covariance is thus
    exact; only the matrix of dimensions squared, whose size does not depend on the number of rows, comes to the
    driver.
    """
    narrow = vectors.select(F.col(column).alias("v"))
    rows = (narrow.mapInPandas(_sums, "dim int, n long, total decimal(38,0)").groupBy("dim")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect())
    if not rows:
        return None
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    n, sums = int(rows[0]["n"]), np.array([int(r["total"]) for r in rows], object)
    d = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums.tolist()], np.int64)
    upper = np.triu_indices(d)

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            x, _ = whole_vectors(pdf["v"])
            if len(x):
                own = exact_gram(x - centre)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(len(upper[0])), "total": list(map(Decimal, total[upper].tolist()))})

    cells = (narrow.mapInPandas(products, "cell int, total decimal(38,0)").groupBy("cell")
             .agg(F.sum("total").alias("total")).collect())
    gram = np.zeros((d, d), object)
    for r in cells:
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        gram[i, j] = gram[j, i] = int(r["total"])
    rest = sums - n * centre.astype(object)
    numerator = n * gram - np.outer(rest, rest)  # n^2 times the covariance
    values, basis = refined(wide(numerator))
    trace = wide(np.array([numerator.trace()], object))[0]
    square = Wide(n) * Wide(n)
    values[values <= d * np.finfo(np.float64).eps * values[0]] = 0
    values, basis = values[:components], basis[:, :components]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, Wide(-1), Wide(1))
    shares = values / trace if trace > 0 else np.zeros(len(values))
    return Whitening(n, sums, (values / square).astype(np.float64), np.asarray(shares, np.float64), basis.astype(np.float64))


def identity_error(vectors: DataFrame, fitted: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them.

    None where no component has variance.
    """
    known = fitted.values > 0
    k = int(known.sum())
    if k == 0:
        return None

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k))
        for pdf in frames:
            x, _ = whole_vectors(pdf["v"])
            if len(x):
                w = fitted.project(fitted.deviations(x))[:, known]
                total += np.vstack((w.T @ w, w.sum(0)))
        yield pd.DataFrame({"cell": np.arange(total.size), "total": total.reshape(-1)})

    cells = (vectors.select(F.col(column).alias("v")).mapInPandas(products, "cell int, total double")
             .groupBy("cell").agg(F.sum("total").alias("total")).collect())
    total = np.zeros((k + 1) * k)
    total[[r["cell"] for r in cells]] = [r["total"] for r in cells]
    total = total.reshape(k + 1, k) / fitted.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, fitted: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, deviation (sum of squares of n * x - sums, exact) and whitened (an array of doubles) for each vector kept.

    NULL and empty vectors, and those with a NULL or non-finite entry, give no row; vectors of different lengths are
    an error. Rows may share a key, or have none; equal vectors have equal results. A component without variance is
    NULL. Without a fit, as of an empty table, there are no rows. Other columns are not read.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, deviation long, whitened array<double>"
    rows = vectors.select(F.col(key), F.col(column).alias("v"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, kept = whole_vectors(pdf["v"])
            if len(x):
                d = fitted.deviations(x)
                points = [[None if np.isnan(v) else v for v in row] for row in fitted.project(d).tolist()]
                yield pd.DataFrame({key: pdf.loc[kept, key].to_numpy(), "deviation": fitted.squares(d), "whitened": points})

    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInPandas(place, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fitted = fit(vectors)
    rows = whitened(vectors, fitted)
    error = identity_error(vectors, fitted) if fitted else None
    shares = F.array(*[F.lit(float(s)) for s in fitted.shares]) if fitted else F.array().cast("array<double>")
    return rows.select("vec_id", F.posexplode("whitened").alias("place", "whitened"), "deviation").select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
