"""Exchange of sorted hashes between blocks of documents and owners of hash ranges.

A block sends its distinct hashes, sorted and Golomb-coded, to the owners of their ranges: one row per block and
owner. The owner merges what all blocks sent and answers each with one bit per hash, in the order sent. A hash
that fills a third of the corpus still comes at most once from each block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

MESSAGE = "block int, owner int, kind int, payload binary"


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers as Golomb-Rice codes: a power of two near 0.69 of the mean gap divides.

    Layout: count (8 bytes), remainder width (1), length of the unary part (8), unary part, whole bytes of the
    remainders, left-over bits of the remainders.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return n.to_bytes(8, "little")
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / n
    width = min(63, max(0, int(math.log2(max(mean * 0.69, 1)))))
    stops = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    unary = np.packbits(unary).tobytes()
    rest = gaps & np.uint64((1 << width) - 1)
    whole, over = divmod(width, 8)
    low = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :whole].tobytes()
    high = (rest >> np.uint64(8 * whole)).astype(np.uint8)
    bits = np.packbits((high[:, None] >> np.arange(over, dtype=np.uint8)) & 1).tobytes() if over else b""
    return b"".join((n.to_bytes(8, "little"), bytes([width]), len(unary).to_bytes(8, "little"), unary, low, bits))


def golomb_decode(data: bytes) -> np.ndarray:
    """What ``golomb_encode`` was given."""
    n = int.from_bytes(data[:8], "little")
    if n == 0:
        return np.zeros(0, np.uint64)
    width, size = data[8], int.from_bytes(data[9:17], "little")
    at = 17 + size
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 17)))[:n]
    high = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    whole, over = divmod(width, 8)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :whole] = np.frombuffer(data, np.uint8, n * whole, at).reshape(n, whole)
    if over:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + n * whole))[:n * over].reshape(n, over)
        rest[:, whole] = (bits << np.arange(over, dtype=np.uint8)).sum(1, dtype=np.uint8)
    gaps = (high << np.uint64(width)) | rest.view("<u8")[:, 0]
    return np.cumsum(gaps, dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting beats hashing for millions of numbers."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def slices(values: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """(owner, from, to) of sorted ``values``, where each owner holds a range of ``span`` values."""
    if len(values) == 0:
        return []
    owners = values // np.uint64(span) if span < 1 << 64 else np.zeros(len(values), np.uint64)
    cuts = np.flatnonzero(np.diff(owners)) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(values)]))
    return [(int(owners[a]), int(a), int(b)) for a, b in zip(starts, ends)]


def messages(block: int, kind: int, values: np.ndarray, span: int, beside: np.ndarray | None = None) -> list[tuple]:
    """Rows of MESSAGE for sorted distinct ``values``; ``beside`` adds one fixed-width number to each value."""
    out = []
    for owner, a, b in slices(values, span):
        base = np.uint64(owner * span)
        payload = golomb_encode(values[a:b] - base)
        if beside is not None:
            payload = len(payload).to_bytes(8, "little") + payload + beside[a:b].tobytes()
        out.append((block, owner, kind, payload))
    return out


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "owner", "kind", "payload"])


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)


def answer_repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owner of one range: per message a bitmap of the values that other blocks sent too."""
    rows = []
    for kind, group in pdf.groupby("kind", sort=True):
        lists = [golomb_decode(p) for p in group["payload"]]
        every = np.sort(np.concatenate(lists))
        repeated = distinct(every[1:][every[1:] == every[:-1]])
        del every
        for block, owner, values in zip(group["block"], group["owner"], lists):
            rows.append((block, owner, kind, pack_bits(_among(values, repeated))))
    return as_frame(rows)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if len(sorted_set) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def answer_preceded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owner of one range: per message a bitmap of the 128-bit values that a block of a smaller number sent too."""
    rows = []
    for kind, group in pdf.groupby("kind", sort=True):
        group = group.sort_values("block")
        firsts, seconds, sizes = [], [], []
        for payload in group["payload"]:
            size = int.from_bytes(payload[:8], "little")
            firsts.append(golomb_decode(payload[8:8 + size]))
            seconds.append(np.frombuffer(payload, np.uint64, -1, 8 + size))
            sizes.append(len(firsts[-1]))
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        rank = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rank, second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        flags = np.zeros(len(first), bool)
        flags[order[1:][same]] = True
        at = 0
        for block, owner, size in zip(group["block"], group["owner"], sizes):
            rows.append((block, owner, kind, pack_bits(flags[at:at + size])))
            at += size
    return as_frame(rows)


def flags_of(values: np.ndarray, span: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers of all owners, aligned with sorted ``values``."""
    out = np.zeros(len(values), bool)
    for owner, a, b in slices(values, span):
        out[a:b] = unpack_bits(answers[owner], b - a)
    return out


def owner_span(bits: int, total: int, per_owner: int = 2_000_000) -> int:
    """Width of an owner's range in a space of 2^bits, so that it gets about ``per_owner`` of ``total`` values."""
    owners = 1 << max(0, math.ceil(math.log2(max(1, total / per_owner))))
    return (1 << bits) // owners
