"""Source mixing against a version in plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crawlframe.llm import mixing
from crawlframe.llm.common import table
from tests.llm.conftest import CLASHING


def test_the_exponent_meets_its_aim():
    shares = [0.9, 0.06, 0.03, 0.01]
    exponent = mixing.temperature(shares, entropy_share=0.8, most_passes=1e9)
    assert mixing.entropy(mixing.mix_of(shares, exponent)) == pytest.approx(0.8 * math.log(4), abs=1e-9)
    limited = mixing.temperature(shares, entropy_share=0.8, most_passes=3.0)
    assert limited > exponent
    assert mixing.passes_of(mixing.mix_of(shares, limited), shares, 1.0) == pytest.approx(3.0, abs=1e-9)


def test_edges_of_the_exponent():
    assert mixing.temperature([0.25] * 4) == 1.0
    assert mixing.temperature([1.0]) == mixing.temperature([]) == 1.0
    assert mixing.temperature([0.9, 0.1], most_passes=2.0, budget_share=5.0) == 1.0
    assert mixing.mix_of([0.5, 0.0, 0.5], 0.5) == [0.5, 0.0, 0.5]


@pytest.mark.parametrize("stretch", [4_000, 3])
def test_mix_keeps_budgets_and_permutes(spark, sf_dir, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'hot', source) AS source")
    mixed = mixing.mixture(docs, budget_share=2.0, entropy_share=0.99, most_passes=6.0, block_tokens=4_000).collect()
    tokens = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    have = Counter()
    for i, n in tokens.items():
        have[source[i]] += n
    total, names = sum(have.values()), sorted(have)
    shares = [have[s] / total for s in names]
    weights = mixing.mix_of(shares, mixing.temperature(shares, 0.99, 6.0, 2.0))
    assert len({(r["doc_id"], r["epoch"]) for r in mixed}) == len(mixed)
    got, by_source = Counter(), defaultdict(lambda: defaultdict(set))
    for r in mixed:
        assert r["n_tokens"] == tokens[r["doc_id"]]
        got[r["source"]] += r["n_tokens"]
        by_source[r["source"]][r["epoch"]].add(r["doc_id"])
    longest = max(tokens.values())
    for s, w in zip(names, weights):
        assert w * 2 * total <= got[s] < w * 2 * total + longest
        epochs = by_source[s]
        assert sorted(epochs) == list(range(len(epochs)))
        full = {i for i in tokens if source[i] == s}
        assert all(epochs[e] == full for e in range(len(epochs) - 1))  # only the last pass is cut
    blocks = defaultdict(Counter)
    for r in mixed:
        blocks[r["block"]][r["source"]] += r["n_tokens"]
    hot = dict(zip(names, weights))["hot"]
    assert len(blocks) > 5
    for own in blocks.values():
        assert abs(own["hot"] - hot * 2 * total / len(blocks)) <= 2 * longest


def plain_mix(rows, hashes, budget_share, entropy_share, most_passes, block_tokens):
    """(doc_id, epoch) to (tokens, block): a source's passes one after another, each sorted by its hash, cut at the budget."""
    size = {i: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for i, _, t in rows}
    members = defaultdict(list)
    for i, source, _ in rows:
        members[source].append(i)
    have = {s: sum(size[i] for i in ids) for s, ids in members.items()}
    total, names = sum(have.values()), sorted((s for s in have if have[s]), key=lambda s: (s is None, s or ""))
    shares = [have[s] / total for s in names]
    weights = mixing.mix_of(shares, mixing.temperature(shares, entropy_share, most_passes, budget_share))
    blocks, out = max(1, round(budget_share * total / block_tokens)), {}
    for s, weight in zip(names, weights):
        budget, at, epoch = weight * budget_share * total, 0, 0
        while at < budget - 1e-6:
            for i in sorted(members[s], key=lambda i: (hashes[i, epoch], i)):
                if at < budget:
                    out[i, epoch] = (size[i], min(blocks - 1, math.floor(at / budget * blocks)))
                at += size[i]
            epoch += 1
    return out


@pytest.mark.parametrize("stretch", [4_000, 5])
def test_mix_row_by_row(spark, sf_dir, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN ' \n' ELSE concat(' \t', text, '\f ') END AS text",
        "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source")
    settings = dict(budget_share=1.7, entropy_share=0.99, most_passes=5.0, block_tokens=3_000)
    inner = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", "text", *[F.xxhash64(F.lit(0), F.lit(e), inner).alias(f"h{e}") for e in range(8)]).collect()
    hashes = {(r["doc_id"], e): r[f"h{e}"] for r in rows for e in range(8)}
    expected = plain_mix([(r["doc_id"], r["source"], r["text"]) for r in rows], hashes, **settings)
    found = mixing.mixture(docs, **settings).collect()
    assert {(r["doc_id"], r["epoch"]): (r["n_tokens"], r["block"]) for r in found} == expected and len(found) == len(expected)
    assert max(e for _, e in expected) > 1


def test_awkward_rows(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns + ["_n_tokens", "_epoch", "_block", "_slot"]
    rows = mixed.collect()
    assert all(r["epoch"].startswith("epoch-") for r in rows) and all(c in mixed.columns for c in CLASHING)
    assert {r["_n_tokens"] for r in rows} == {len((r["text"] or "").split()) for r in rows}


def test_no_tokens_no_mix(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "s", "  ")], "doc_id long, source string, text string")
    assert mixing.mixture(docs).collect() == []
