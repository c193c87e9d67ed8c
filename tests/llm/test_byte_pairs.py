"""Byte-level encoding against the library's own encoder, and decoding as its round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from crawlframe.llm import bpe
from crawlframe.llm.common import table

RANKS = bpe.read_ranks(bpe.VOCABULARY)
PATTERNS = bpe.spelled_out(public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, PATTERNS)


def ids(encoder, *texts):
    return [np.frombuffer(packed, "<u4").tolist() for packed in encoder.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abe st'lrvm\n\t éß1२٣\x1c")), max_size=60), max_size=4))
def test_ids_are_the_librarys(texts):
    assert ids(ENCODER, *texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_every_character_is_classed_as_in_the_library():
    for top in range(0, 0x110000, 0x4000):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(top, top + 0x4000) if not 0xD800 <= c < 0xE000)
        assert ids(ENCODER, text) == [LIBRARY.encode_ordinary(text)]


@pytest.mark.parametrize("text", ["a" * 100_000, "abcdefghij" * 10_000, " " * 60_000 + "x", "éñß" * 20_000, "word " * 300_000])
def test_very_long_texts_and_pieces(monkeypatch, text):
    assert ids(ENCODER, text) == [LIBRARY.encode_ordinary(text)]
    monkeypatch.setattr(bpe, "LISTED", 10)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 1_000)
    assert ids(bpe.Encoder(RANKS, PATTERNS), text[:50_000]) == [LIBRARY.encode_ordinary(text[:50_000])]


@settings(max_examples=200, deadline=None)
@given(st.permutations(["ab", "bc", "abc", "ca", "cab", "aa", "aaa", "bcab", "aab"]), st.text("abc", max_size=30))
def test_ranks_in_any_order(longer, text):
    """A merge may make a pair of a lower rank than its own, which then comes first."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(longer)}
    library = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids(bpe.Encoder(ranks, PATTERNS), text) == [library.encode_ordinary(text)]


def test_pieces_are_remembered_in_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 5)
    encoder = bpe.Encoder(RANKS, PATTERNS)
    texts = [f"zyx{i % 37}q wv{i % 11}k {'long' * 20}{i}" for i in range(300)]
    assert ids(encoder, *texts) == [LIBRARY.encode_ordinary(t) for t in texts]
    assert len(encoder.known) + len(encoder.older) < 100 and not any(len(p) > bpe.CACHE_LENGTH for p in encoder.known)


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0}, PATTERNS)


def test_ranks_come_out_in_order():
    queue, rng = bpe.RankQueue(60_000), np.random.default_rng(1)
    ranks = rng.choice(60_000, 500, replace=False).tolist()
    for r in ranks:
        queue.add(r, [r + 1])
    assert [queue.take() for _ in ranks] == [(r, [r + 1]) for r in sorted(ranks)] and queue.take() is None


@pytest.mark.parametrize("which", ["odd_dir", "sf_dir"])
def test_query_on_whole_texts(spark, request, which):
    docs = table(spark, request.getfixturevalue(which), "documents").select("doc_id", "text").collect()
    expected = []
    for r in docs:
        found = LIBRARY.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op13_byte_bpe(spark, request.getfixturevalue(which)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_columns_are_kept_and_a_clash_is_refused(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    assert bpe.with_token_ids(docs, out="ids").columns == [*docs.columns, "ids"]
    with pytest.raises(ValueError):
        bpe.with_token_ids(docs, out="N_Tokens")


def test_ids_that_mean_nothing_decode_to_null(spark):
    rows = [(None,), (bytearray(),), (bytearray(b"\x00\x00\x00"),), (bytearray((70_000).to_bytes(4, "little")),), (bytearray(4),)]
    packed = spark.createDataFrame(rows, "ids binary").coalesce(1)
    assert [r[0] and bytes(r[0]) for r in packed.select(bpe.decoded(spark, F.col("ids"))).collect()] == [None, b"", None, None, b"!"]
