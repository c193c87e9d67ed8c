"""The pipeline's stages, each written and read again, against plain versions."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from crawlframe.llm import toxicity
from crawlframe.llm.common import stored, table
from tests.llm.test_dedup import brute_components, brute_fingerprint
from tests.llm.test_text_scans import plain_words


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 30)


def stages(spark, folder):
    """Rows of documents, then of every stage's result."""
    docs = table(spark, folder, "documents")
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        if name != "mixing":
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_stages_come_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("which", ["sf_dir", "odd_dir"])
def test_every_stage_does_its_work(spark, request, which):
    folder = request.getfixturevalue(which)
    given, clean, exact, near, plain, mixed = stages(spark, folder)
    key = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)

    scored = toxicity.with_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), "toxic_score").collect()
    assert key(clean) == key(r for r in scored if r["toxic_score"] < toxicity.THRESHOLD)

    largest = {}
    for r in clean:
        text, i = r["text"] or "", r["doc_id"]
        old = largest.setdefault(text, i)
        largest[text] = i if old is None or (i is not None and i > old) else old
    assert Counter((r["doc_id"], r["text"] or "") for r in exact) == Counter((i, t) for t, i in largest.items())

    roots = brute_components([brute_fingerprint(r["text"] or "") for r in exact])
    groups = defaultdict(list)
    for root, r in zip(roots, exact):
        groups[root].append(r["doc_id"])
    smallest = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    # groups of rows without an id have no smallest id; one of all such rows stays
    assert Counter(r["doc_id"] for r in near if r["doc_id"] is not None) == Counter({i: n for i, n in smallest.items() if i is not None})
    assert sum(r["doc_id"] is None for r in near) == (None in smallest)

    windows = set()
    for r in table(spark, folder, "benchmark").collect():
        w = plain_words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    def leaks(text):
        w = plain_words(text)
        return any(tuple(w[i:i + n]) in windows for n in range(1, 11) for i in range(len(w) - n + 1))

    assert key(plain) == key(r for r in near if not leaks(r["text"]))
    assert key(mixed).keys() <= key(plain).keys() and len(mixed) > 0


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    last = stages(spark, sf_dir)[-1]
    assert Counter(map(tuple, ran)) == Counter(map(tuple, last))


def test_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
