import numpy as np
from hypothesis import given, settings, strategies as st

from crawlframe.llm import exchange


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 63))
def test_golomb_codes_round_trip(numbers, shift):
    values = np.sort(np.array(numbers, np.uint64) >> np.uint64(shift))
    assert np.array_equal(exchange.golomb_decode(exchange.golomb_encode(values)), values)


def test_golomb_codes_are_short():
    values = np.unique(np.random.default_rng(0).integers(0, 2**40, 100_000, dtype=np.uint64))
    bits = 8 * len(exchange.golomb_encode(values)) / len(values)
    assert bits < 40 - np.log2(len(values)) + 2.2


def test_slices_cover_all_owners_once():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    for owners in (1, 2, 64, 1024):
        span = 2**64 // owners
        parts = exchange.slices(values, span)
        assert sum(b - a for _, a, b in parts) == len(values)
        assert all(int(v) // span == owner for owner, a, b in parts for v in values[a:b])


def test_owner_tells_what_other_blocks_sent():
    a, b = np.array([1, 5, 9], np.uint64), np.array([5, 7], np.uint64)
    sent = exchange.as_frame(exchange.messages(0, 0, a, 100) + exchange.messages(1, 0, b, 100) + exchange.messages(2, 1, b, 100))
    got = {(r.block, r.kind): exchange.unpack_bits(r.payload, 3).tolist() for r in exchange.answer_repeated(sent).itertuples()}
    assert got == {(0, 0): [False, True, False], (1, 0): [True, False, False], (2, 1): [False, False, False]}


def test_preceded_looks_at_both_halves_of_a_digest():
    first = np.array([3, 3, 8], np.uint64)
    sent = exchange.as_frame(exchange.messages(4, 2, first, 100, np.array([1, 2, 5], np.uint64))
                             + exchange.messages(7, 2, first, 100, np.array([1, 9, 5], np.uint64)))
    got = {r.block: exchange.unpack_bits(r.payload, 3).tolist() for r in exchange.answer_preceded(sent).itertuples()}
    assert got == {4: [False] * 3, 7: [True, False, True]}
