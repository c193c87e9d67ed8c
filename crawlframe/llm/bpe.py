"""Byte-level byte-pair encoding and decoding with a queue of merge ranks."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, table, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces in either generation of those a worker remembers with their ids, none of them longer than so many characters.
CACHE_PIECES, CACHE_LENGTH = 400_000, 50
#: Texts beyond so many characters are split into pieces a part at a time; so many pieces are looked up at once.
LONG_TEXT, PIECES_AT_ONCE = 1 << 20, 100_000
#: Bits of a word of the rank queue.
WORD = 256
_BITS = [1 << i for i in range(WORD)]
#: Classes a pattern may name, and the last code point of the two bytes that most texts keep to.
_CLASSES, _TWO_BYTES = (r"\p{L}", r"\p{N}", r"\s"), 0xFFFF
#: Up to so many bytes lists, which are quicker, hold the linked list; beyond, arrays, which are smaller.
LISTED = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: one line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions in buckets by rank; the bucket of the smallest rank comes first.

    A bit of a word says whether a rank's bucket holds anything, and a bit of the top whether a word has any bit. The
    first rank is found by the lowest set bit of the top and then of one word.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * (ranks // WORD + 1)
        self.top = 0

    def add(self, rank: int, positions: list[int]) -> None:
        """``positions`` as the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word = rank // WORD
        self.words[word] |= _BITS[rank % WORD]
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]] | None:
        """The smallest rank and its bucket, taken out; None where nothing is left."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        self.words[word] = rest = bits & (bits - 1)
        if not rest:
            self.top = top & (top - 1)
        rank = word * WORD + (bits ^ rest).bit_length() - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Ids of pieces of text, four bytes each, by merging the pair of the lowest rank, the leftmost one of these.

    Short pieces are remembered with their ids, in two generations: when the younger one is full it becomes the older
    one, whose pieces are forgotten unless they were met again.
    """

    def __init__(self, ranks: dict[bytes, int], patterns: tuple[str, str]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.ranks, self.longest, self.size = ranks, max(map(len, ranks)), max(ranks.values()) + 1
        self.patterns = patterns
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.first = np.full(1 << 16, -1, np.int32)  # ranks of pairs of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Tokens are a linked list of their first bytes' positions; a pair's rank is that of its bytes.

        All pieces share one queue. Between two of them lies a place that no pair reaches over. A bucket is worked off
        from the left until a merge makes a pair of a lower rank, which then comes first. An entry is stale when its
        pair has been merged or has grown since; such entries are skipped. Time is near linear in the bytes, also
        where they are one piece.
        """
        rank_of, longest, queue = self.ranks.get, self.longest, RankQueue(self.size)
        buckets, add, take = queue.buckets, queue.add, queue.take
        data = b" ".join(pieces) + b" "
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        octets = np.frombuffer(data, np.uint8).astype(np.int64)
        ranks = np.append(self.first[octets[:-1] << 8 | octets[1:]], np.int32(-1))  # of the pair that starts here, -1 for none
        ranks[ends - 1] = -1
        ranks[ends[ends > 1] - 2] = -1
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data))
        after[ends - 1] = ends + longest  # so far that nothing from before it is a token
        before[np.append(0, ends[:-1])] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        found, cuts = np.unique(ranks[order], return_index=True)
        for rank, positions in zip(found.tolist(), np.split(order, cuts[1:])):
            add(rank, positions.tolist())
        del octets, order
        if len(data) <= LISTED:
            after, before, current = after.tolist(), before.tolist(), ranks.tolist()
        else:
            after, before, current = array("q", after.tobytes()), array("q", before.tobytes()), array("i", ranks.tobytes())
        while (entry := take()) is not None:
            rank, bucket = entry
            bucket.sort(reverse=True)
            lowest = rank
            while bucket and lowest >= rank:
                i = bucket.pop()
                if current[i] != rank:
                    continue
                middle = after[i]
                after[i] = end = after[middle]
                before[end] = i
                current[middle] = current[i] = -1
                upto, left = after[end], before[i]
                if upto - i <= longest and (found := rank_of(data[i:upto])) is not None:
                    current[i] = found
                    if found in buckets:
                        buckets[found].append(i)
                    else:
                        add(found, [i])
                    if found < lowest:
                        lowest = found
                if left >= 0:
                    found = rank_of(data[left:end]) if end - left <= longest else None
                    if found is None:
                        current[left] = -1
                    else:
                        current[left] = found
                        if found in buckets:
                            buckets[found].append(left)
                        else:
                            add(found, [left])
                        if found < lowest:
                            lowest = found
            if bucket:
                add(rank, bucket)
        out, tokens, start = [], self.ranks, 0
        for piece in pieces:
            ids, i, end = [], start, start + len(piece)
            while i < end:
                ids.append(tokens[data[i:after[i]]])
                i = after[i]
            out.append(ids)
            start = end + 1
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of ``pieces``."""
        known, rank_of, rest = self.known, self.ranks.get, []
        for piece in pieces:
            rank = rank_of(piece.encode())
            if rank is None:
                rest.append(piece)
            else:
                known[piece] = rank.to_bytes(4, "little")
        for piece, ids in zip(rest, self.merged([piece.encode() for piece in rest])):
            known[piece] = np.array(ids, "<u4").tobytes() if len(ids) > 50 else b"".join([i.to_bytes(4, "little") for i in ids])

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's matches of the pattern, in lists of bounded length."""
        narrow = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        pattern = re.compile(self.patterns[0 if narrow else 1])
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            yield from iter(lambda: list(islice(found, PIECES_AT_ONCE)), [])

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        held: list[tuple[list[bytes], list[str]]] = []
        size = 0

        def look_up() -> None:
            unknown = set().union(*(some for _, some in held)).difference(self.known)
            met = unknown & self.older.keys()
            self.known.update((piece, self.older[piece]) for piece in met)
            unknown -= met
            self.learn(unknown)
            for parts, some in held:
                parts.append(b"".join(map(self.known.__getitem__, some)))
            for piece in unknown:
                if len(piece) > CACHE_LENGTH:
                    self.known.pop(piece, None)
            if len(self.known) > CACHE_PIECES:
                self.known, self.older = {}, self.known
            held.clear()

        for text in texts:
            out.append([])
            for some in self.pieces(text):
                held.append((out[-1], some))
                size += len(some)
                if size >= PIECES_AT_ONCE:
                    look_up()
                    size = 0
        look_up()
        return [b"".join(parts) for parts in out]


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    values = np.array(points, np.int64)
    starts = np.flatnonzero(np.diff(values, prepend=-2) > 1)
    stops = np.append(starts[1:], len(values)) - 1
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(values[starts].tolist(), values[stops].tolist()))


def spelled_out(pattern: str) -> tuple[str, str]:
    """The pattern with its classes as ranges of code points: over two-byte characters alone, and over all.

    Engines know different versions of the character tables. What is a letter, a number or white space is asked of the
    engine of the library whose results are wanted: one encoding per class, over all characters, keeps those that match.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    points = {}
    for kind in _CLASSES:
        engine = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        points[kind] = list(map(ord, bytes(engine.encode_ordinary(every)).decode()))
    out = []
    for top in (_TWO_BYTES, 0x10FFFF):
        text, inside = "", False
        for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
            inside = part == "[" or inside and part != "]"
            kind = part.replace(r"\S", r"\s")
            if kind in points:
                ranges = _ranges([c for c in points[kind] if c <= top])
                if kind != part and inside:
                    raise ValueError("a negated class inside a class")
                text += ranges if inside else f"[{'^' if kind != part else ''}{ranges}]"
            else:
                text += part
        out.append(text)
    return out[0], out[1]


def encoder_of(spark: SparkSession, vocabulary: str):
    """A function for tasks that gives each Python worker one ``Encoder``. The file, of bounded size, is read here.

    A worker keeps what was broadcast from task to task, and with it the encoder and the pieces it knows.
    """
    shared = spark.sparkContext.broadcast({"parts": (read_ranks(vocabulary), spelled_out(public_tokenizers.PATTERN))})

    def get() -> Encoder:
        if "encoder" not in shared.value:
            shared.value["encoder"] = Encoder(*shared.value["parts"])
        return shared.value["encoder"]

    return get


def with_token_ids(docs: DataFrame, column: str = "text", out: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a column ``out``: the ids of the text, as little-endian unsigned 32-bit integers in one binary value.

    Every match of the pattern is encoded by itself; special tokens are ordinary text. NULL and empty texts have no
    ids (an empty value, not NULL). Very long texts are split a part at a time, and a piece of any length takes time
    near its length and some hundred bytes of memory per byte. Equal texts have equal ids, every row is encoded for
    itself, an empty table gives no rows, and other columns are kept; ``out`` must not be one of them.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out} already")
    encoder = encoder_of(docs.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder().encode(texts), dtype=object)

    return docs.withColumn(out, ids(text_of(column)))


def decoded(spark: SparkSession, ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes that packed ids stand for; NULL for NULL and where an id is not in the vocabulary or cut short."""
    shared = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(vocabulary).items()})

    def back(packed: bytes | None) -> bytes | None:
        if packed is None or len(packed) % 4:
            return None
        try:
            return b"".join(map(shared.value.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except KeyError:
            return None

    @F.pandas_udf("binary")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series(list(map(back, column)), dtype=object)

    return text(ids)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    (ids,) = fresh(docs, "token_ids")
    return with_token_ids(docs, out=ids).select(
        "doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(decoded(spark, F.col(ids)), 256).alias("decoded_sha256"))
