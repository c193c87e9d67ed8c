"""Whitening against exact rational arithmetic and known spectra."""

from fractions import Fraction

import numpy as np
import pytest

from crawlframe.llm import whitening
from crawlframe.llm.common import table

Wide = np.longdouble


def whole(v):
    return [int(np.floor(1024 * float(c))) + 100_000 for c in v]


def usable(vectors):
    return [v for v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]


def exact_covariance(x):
    n, d = len(x), len(x[0])
    means = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return [[sum((r[i] - means[i]) * (r[j] - means[j]) for r in x) / n for j in range(d)] for i in range(d)]


def check(rows, x):
    """``rows`` of the operator, sorted by id, against the definition."""
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    assert [r["deviation"] for r in rows] == [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    covariance = np.array([[float(c) for c in r] for r in exact_covariance(x)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums)] for r in x])
    expected = centred @ vectors / np.sqrt(values)
    got = np.array([r["whitened"] for r in rows])
    sign = np.sign((got * expected).sum(0))
    assert np.allclose(got, expected * sign, rtol=0, atol=1e-9)


def test_query_on_the_given_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    x = [whole(r["embedding"]) for r in vectors]
    got = whitening.op11_whitening(spark, sf_dir).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * len(x) and {r["n"] for r in got} == {len(x)}
    d = np.array(x) - np.mean(x, 0)
    covariance = d.T @ d / len(x)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    w = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    e = d @ basis / np.sqrt(values)
    assert np.allclose(w, e * np.sign((w * e).sum(0)), rtol=0, atol=1e-8)
    assert np.allclose([r["explained"] for r in got[:8]], values / np.trace(covariance), rtol=1e-9)
    assert [r["component"] for r in got[:8]] == list(range(1, 9)) and got[0]["identity_error"] < 1e-12
    assert len({r["identity_error"] for r in got}) == 1


def test_rows_that_count_and_rows_that_do_not(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(0, [3, 2, 1.5, 1, 0.7], (60, 5)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(100, None), (101, []), (102, [None] + good[0][1:]), (103, [float("nan")] + good[0][1:]),
            (104, [float("inf")] + good[0][1:]), (3, good[3]), (None, good[4])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    fitted = whitening.fit(docs)
    got = sorted(whitening.whitened(docs, fitted).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    kept = sorted([r for r in rows if r[1] and r[0] not in (102, 103, 104)], key=lambda r: (r[0] is None, r[0] or 0))
    assert [r["vec_id"] for r in got] == [i for i, _ in kept] and fitted.n == 62
    check(got, [whole(v) for _, v in kept])
    assert whitening.identity_error(docs, fitted) < 1e-12


def test_wide_entries_are_exact(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(0, 1, (40, 3)) * [1e9, 3e6, 40]).tolist()
    docs = spark.createDataFrame(list(enumerate(good)), "vec_id long, embedding array<double>")
    fitted = whitening.fit(docs)
    x = [whole(v) for v in good]
    exact = exact_covariance(x)
    assert abs(fitted.values.sum() / float(sum(exact[i][i] for i in range(3))) - 1) < 1e-14
    assert whitening.exact_gram(np.array(x)).tolist() == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    with pytest.raises(Exception, match="deviation|int|large|big"):
        whitening.whitened(docs, fitted).collect()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, -0.25]) for i in range(5)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fitted = whitening.fit(docs)
    got = whitening.whitened(docs, fitted).collect()
    assert len(got) == len(usable(v for _, v in rows))
    assert all(r["deviation"] == 0 and r["whitened"] == [None, None] for r in got)
    assert fitted is None or whitening.identity_error(docs, fitted) is None


def test_lengths_must_agree(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        whitening.fit(docs)


@pytest.mark.parametrize("values", [
    np.linspace(1, 3, 30), [5, 5, 5, 5 - 1e-9, 5 - 2e-9, 3, 3, 3, 1e-3, 1e-3 + 1e-12, 1, 1, 1, 1], [1] * 12, [1e6, 1, 1, 1, 1e-6, 1e-6, 0, 0]])
def test_clustered_spectra(values):
    d, rng = len(values), np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(Wide)
    for _ in range(4):
        q = q + q @ (np.eye(d, dtype=Wide) - q.T @ q) / 2
    spectrum = np.array(values, Wide)
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.abs(found - np.sort(spectrum)[::-1]).max() < 1e-17 * float(spectrum.max()) * d
    assert np.abs(x.T @ x - np.eye(d)).max() < 2e-15
    assert np.abs(a @ x - x * found).max() < 1e-17 * float(spectrum.max()) * d


def test_refinement_needs_few_sweeps_and_keeps_tight_gaps():
    """Eigenvectors of a gap of 1e-9, which single precision cannot see, come out to double precision."""
    d, rng = 16, np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(Wide)
    for _ in range(4):
        q = q + q @ (np.eye(d, dtype=Wide) - q.T @ q) / 2
    spectrum = np.array([2 + 1e-9, 2] + list(np.linspace(0.1, 1, d - 2)), Wide)
    a = (q * spectrum) @ q.T
    _, x = whitening.refined((a + a.T) / 2, sweeps=12)
    assert float(np.abs(np.abs((q[:, :2] * x[:, :2]).sum(0)) - 1).max()) < 1e-15
