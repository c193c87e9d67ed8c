"""Exact, substring and SimHash dedup against brute force, on awkward rows and on the given documents."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlframe.llm import exact_dedup, simhash, substring_dedup
from crawlframe.llm.common import LAST_ID, table
from crawlframe.llm.components import components
from tests.llm.conftest import CLASHING


def rows_of(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, folder, "documents").collect()]


@pytest.mark.parametrize("which", ["odd_dir", "sf_dir"])
def test_exact_groups(spark, request, which):
    folder = request.getfixturevalue(which)
    found = exact_dedup.exact_duplicates(table(spark, folder, "documents")).collect()
    groups = defaultdict(list)
    for doc_id, text in rows_of(spark, folder):
        groups[hashlib.sha256(text.encode()).hexdigest()].append(doc_id)
    assert Counter((r["doc_id"], r["text_sha256"]) for r in found) == Counter((i, s) for s, ids in groups.items() for i in ids)
    for sha, ids in groups.items():
        own = [r for r in found if r["text_sha256"] == sha]
        largest = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(largest, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [largest]


def test_exact_filter_keeps_one_row_of_each_text_and_all_columns(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert Counter(r["text"] or "" for r in kept) == Counter(set(t for _, t in rows_of(spark, odd_dir)))
    assert all(r["__fp"].startswith("__fp-") and r["a.b"].startswith("a.b-") for r in kept)
    assert {r["doc_id"] for r in kept if r["text"] == "Alpha beta gamma delta"} == {17}


def test_a_filter_bitmap_passes_its_members(spark):
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    passes = exact_dedup.membership_filter(prints.limit(300), bits=12)
    known = {r["fp"] for r in prints.limit(300).collect()}
    for row in prints.withColumn("p", passes("fp")).collect():
        assert row["p"] or row["fp"] not in known
    assert prints.where(passes("fp")).count() < 600


def brute_repeats(rows, window):
    """Kept words of each row; windows in order of (id, start), one position shared by rows of one id."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for s in range(len(w) - window + 1):
            k, at = tuple(w[s:s + window]), (LAST_ID if i is None else i, s)
            first[k] = min(first.get(k, at), at)
    out = Counter()
    for (i, _), w in zip(rows, split):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (LAST_ID if i is None else i, s):
                gone.update(range(s, s + window))
        out[(i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone))] += 1
    return out


@pytest.mark.parametrize("window,block", [(20, 8 << 20), (3, 500), (1, 200)])
def test_repeated_passages(spark, odd_dir, window, block):
    docs = table(spark, odd_dir, "documents")
    found = substring_dedup.remove_repeats(docs, window, block).collect()
    rows = rows_of(spark, odd_dir)
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in found) == brute_repeats(rows, window)


def test_repeated_passages_over_many_blocks(spark, sf_dir):
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 8, 20_000).collect()
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in found) == brute_repeats(rows_of(spark, sf_dir), 8)


def thue_morse(steps, zero, one):
    """Two words that every polynomial over their letters modulo 2^64 takes for equal."""
    word = [0]
    for _ in range(steps):
        word += [1 - x for x in word]
    return "".join(zero if x == 0 else one for x in word), "".join(one if x == 0 else zero for x in word)


def test_words_made_to_collide_are_told_apart(spark):
    a, b = thue_morse(11, "a", "b")
    rest = " ".join(f"common{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 20}
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, window=substring_dedup.MOST_WORDS + 1)


def test_hashes_of_a_text_above_a_chunk(monkeypatch):
    texts = [b"one two\tthree  \n", b"", b"x" * 300 + b" y " + b"z" * 500, b" \v\f\r ", "é ñ ß\u00a0ü".encode()]
    whole, sizes = substring_dedup.word_hashes(texts)
    assert sizes.tolist() == [3, 0, 3, 0, 3]
    for size in (1, 7, 100):
        monkeypatch.setattr(substring_dedup, "CHUNK", size)
        parts, again = substring_dedup.word_hashes(texts)
        assert again.tolist() == sizes.tolist() and all((x == y).all() for x, y in zip(whole, parts))


def test_a_long_text_is_hashed_in_bounded_memory():
    import tracemalloc
    text = b"some words of a very long text " * 1_600_000  # 50 MB
    tracemalloc.start()
    (one, two), sizes = substring_dedup.word_hashes([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.tolist() == [11_200_000] and len(np.unique(one)) == len(np.unique(two)) == 7 and peak < 600 << 20


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Component number of each fingerprint, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("which", ["odd_dir", "sf_dir"])
def test_simhash_components(spark, request, which):
    folder = request.getfixturevalue(which)
    rows = rows_of(spark, folder)
    prints = [brute_fingerprint(t) for _, t in rows]
    roots, least = brute_components(prints), {}
    for root, (i, _) in zip(roots, rows):
        least[root] = min(least.get(root, LAST_ID), LAST_ID if i is None else i)
    expected = Counter((i, p, None if least[r] == LAST_ID else least[r]) for (i, _), p, r in zip(rows, prints, roots))
    found = simhash.near_duplicates(table(spark, folder, "documents")).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected


def test_fingerprint_hash_is_sparks(spark):
    text = "one two three"
    assert simhash.fingerprint(text.encode()) == spark.sql(f"SELECT xxhash64('{text}') AS h").first()["h"] % (1 << 64)


@pytest.mark.parametrize("block,small", [(16_384, 24), (50, 24), (50, 2)])
def test_links_of_a_dense_cluster_are_not_lost(spark, monkeypatch, block, small):
    monkeypatch.setattr(simhash, "CELL_BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64 - 1, dtype=np.uint64)
    near = [centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 5, 300)]
    far = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    chain = [np.uint64(1 << 60)]
    for i in range(30):
        chain.append(chain[-1] ^ np.uint64(7 << (i * 2 % 56)))
    values = np.unique(np.concatenate([near, far, chain]).astype(np.uint64))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash.links(prints)
    pairs = links.collect()
    assert len(pairs) < 26 * len(values)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    expected, found = defaultdict(set), defaultdict(set)
    for v, root in zip(values.view(np.int64).tolist(), brute_components(values)):
        expected[root].add(v)
        found[roots.get(v, v)].add(v)
    assert sorted(map(sorted, expected.values())) == sorted(map(sorted, found.values()))


def test_simhash_filter_keeps_the_smallest_id(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = {r["root"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(found.values())
    assert all(c in kept.columns for c in CLASHING)


def test_simhash_filter_keeps_one_row_of_each_component(spark):
    long = " ".join(f"v{i * 13 % 71}" for i in range(400))
    rows = [(None, "no id one and more words"), (None, "no id two is another text"), (None, "no id one and more words"), (None, None),
            (None, ""), (7, "seven is here once"), (7, "seven is there with another text"), (7, "seven is here once"),
            (3, long), (3, "three has a text that stands alone"), (9, long), (9, "nine again in words of its own"), (None, long), (11, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    roots, best = brute_components([brute_fingerprint(t or "") for _, t in rows]), {}
    for root, (i, t) in zip(roots, rows):
        best[root] = min(best.get(root, (LAST_ID, "~")), (LAST_ID if i is None else i, t or ""))
    kept = simhash.without_near_duplicates(docs).collect()
    assert Counter((LAST_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept) == Counter(best.values())
    assert len(kept) == 9


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i + 1, i) for i in range(40)] + [(200 + i, 100) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filters_group_equal_rows_before_the_join_and_look_at_suspected_texts_alone(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for kept, costly in ((simhash.without_near_duplicates(docs), "of(cast("), (exact_dedup.without_duplicates(docs), "sha2(")):
        lines = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
        at = {k: next(i for i, line in enumerate(lines) if k in line) for k in ("Join Inner", "Aggregate [")}
        assert at["Join Inner"] < at["Aggregate ["]
        # the costly expression is worked out above the filter of suspected rows, which is a line further down
        places = [i for i, line in enumerate(lines) if costly in line]
        assert len(places) == 1 and places[0] < next(i for i, line in enumerate(lines) if "Filter pythonUDF" in line)
