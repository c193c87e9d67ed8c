"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from crawlframe.llm import spelling
from crawlframe.llm.common import table

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_near(words):
    """Words one edit apart share what is left when a letter is left out, or one is the other without a letter."""
    left_out, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            left_out[w[:i], w[i + 1:]].add(w)
    for (a, b), found in left_out.items():
        for w in found:
            near[w] |= found - {w}
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    return near


def brute(rows):
    words = brute_words(rows)
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(((-words[o], o) for o in near[w]), default=(0, None))
        form[w] = (best[1], -best[0]) if -best[0] >= 2 * n else (None, None)
    out = set()
    for w, n in words.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out.add((w, form[w][0], root, n, len(near[w]), form[w][1]))
    return out


def variants(docs):
    rows = spelling.spelling_variants(docs).select(*COLUMNS).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


@pytest.mark.parametrize("which", ["odd_dir", "sf_dir"])
def test_query_on_whole_texts(spark, request, which):
    folder = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    got = spelling.op12_spelling(spark, folder)
    assert got.columns == COLUMNS
    assert set(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("own,guests,ends", [(4_096, 16_384, None), (3, 5, 1), (2, 2, 4)])
def test_chains_ties_and_crowded_cells(spark, monkeypatch, own, guests, ends):
    monkeypatch.setattr(spelling, "OWN_BLOCK", own)
    monkeypatch.setattr(spelling, "GUEST_BLOCK", guests)
    if ends:
        monkeypatch.setattr(spelling, "end_letters", lambda words: ends)
    counts = {"abcde": 3, "abcdef": 6, "abcdefg": 13, "abcdefgh": 30, "xbcde": 6, "abcdx": 6, "ABCDE": 1, "zzzzz": 5, "zzzzzz": 11,
              "zzzzzzz": 10, "aaaaa": 4, "aabaa": 8, "aacaa": 8, "straße": 3, "strasse": 9, "àéîõü": 4, "àéîõv": 8, "four": 50, "fours": 3,
              "abcedf": 3, "fedcba": 3, "×÷×÷×": 3, "×÷×÷÷": 6}
    rng = np.random.default_rng(5)
    for _ in range(150):
        counts["thing" + "".join(rng.choice(list("abc"), 3))] = int(rng.integers(3, 40))
    rows, at = [], 0
    for word, n in counts.items():
        for _ in range(n):
            rows.append((at, f"{word}, 7"))
            at += 1
    rows += [(None, "thingaaa"), (None, "thingaaa"), (7, None), (8, ""), (9, "lone" + "ly" * 40_000), (9, "lone" + "ly" * 40_000), (9, "lone" + "ly" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = variants(docs)
    assert got == brute(rows)
    assert any(r[1] != r[2] and r[1] for r in got)


def test_no_word_is_near_too_long_or_cut(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 50)
    monkeypatch.setattr(spelling, "COUNTED", 3)
    rows = [(i, "Wörter über Straßen " * 20 + "endet" + "é" * 120 + " wörtern") for i in range(40)]
    assert variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_an_empty_table_and_one_without_words(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")) == set()
    assert variants(spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")) == set()


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=5, max_size=9), st.text("abc", min_size=5, max_size=9), st.integers(1, 5))
def test_two_words_meet_once_if_near(a, b, ends):
    near = bool(brute_near({a, b})[a]) if a != b else False
    met = []
    for home, guest in ((a, b), (b, a)):
        own = {cell for cell, role in spelling.cells_of(home, ends) if role == 0}
        for cell, role in spelling.cells_of(guest, ends):
            if cell in own and role and (role == 2 or home < guest):
                last = spelling.LAST in cell
                found, _ = spelling.near_pairs([home], [guest], len(cell.split(spelling.LAST if last else spelling.FIRST)[1]), last)
                met += found.tolist()
    assert len(met) == near
