"""Secrets in texts: fixed patterns, and random strings that a token vocabulary encodes badly."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, table, text_of

#: A file of base64 token and rank per line, and the pattern that splits text for it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A string of at least this many characters, other than a number or a run of words, is random at this many characters per token.
SHORTEST, RATIO = 16, 2.0
KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are greedy, so shorter ones fail as a whole
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Known digests (hexadecimal MD5, SHA-1, SHA-2) and identifiers (UUIDs, names of words and numbers set apart by marks).
_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
_KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
                    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
                    rf"|[-_/+=]*{_WORD}(?:[-_/+=]+{_WORD})*[-_/+=]*|[-_/+=]+)")
#: Marks that join strings into paths and assignments, but may also stand inside a random string.
_PIECE = re.compile(r"[^/=]+")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """The spans of the three fixed patterns, leftmost and non-overlapping within each kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class RandomStrings:
    """Finds strings of few characters per token."""

    def __init__(self, vocabulary: bytes, split: str = SPLIT, ratio: float = RATIO):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.ratio = ratio

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Spans that overlap none of ``taken``, are no known digest or identifier, and have a low ratio.

        Runs of the alphabet are cut at ``taken``. What is left is judged piece by piece between "/" and "=": pieces that
        are words, numbers, digests or of a high ratio are left out, and the strings made of the others that follow one
        another, with the marks between them, are tested as a whole.
        """
        out = []
        for start, end in free_runs(text, taken):
            first = last = -1
            for m in _PIECE.finditer(text, start, end):
                if self.plain(m[0]):
                    self._test(text, first, last, out)
                    first = -1
                else:
                    first, last = m.start() if first < 0 else first, m.end()
            self._test(text, first, last, out)
        return out

    def plain(self, string: str) -> bool:
        return bool(_KNOWN.fullmatch(string)) or len(string) > self.ratio * len(self.encoding.encode_ordinary(string))

    def _test(self, text: str, start: int, end: int, out: list[Span]) -> None:
        if start >= 0 and end - start >= SHORTEST and not self.plain(text[start:end]):
            out.append((start, 3, end))


def free_runs(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Parts of at least SHORTEST characters of the runs of the alphabet that ``taken``, sorted, leaves."""
    cuts, upto = [], 0
    for start, _, end in taken:  # as stretches that do not overlap
        if end > upto:
            cuts.append((max(start, upto), end))
            upto = end
    nth = 0
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        while nth < len(cuts) and cuts[nth][1] <= at:
            nth += 1
        here = nth
        while here < len(cuts) and cuts[here][0] < end:
            if cuts[here][0] - at >= SHORTEST:
                yield at, cuts[here][0]
            at = max(at, cuts[here][1])
            here += 1
        if end - at >= SHORTEST:
            yield at, end


def with_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO, column: str = "__spans") -> DataFrame:
    """``docs`` with an array of structs (kind, start, end) in ``column``; positions are code points, ends exclusive.
    Other columns are kept, and where one has that name the new one gets underscores before it.

    Kinds are those of KINDS: three fixed patterns, and ``token`` for strings with at most ``ratio`` characters per
    token of the vocabulary, outside the spans of the fixed patterns (see ``RandomStrings.spans``). Letters of one case
    alone count as a word, so a random string without digits is found only in mixed case. Spans come by start, then kind. NULL and empty
    texts have none. Rows are independent: repeated rows get equal spans, and an empty table gives no rows. The
    vocabulary file is read by the driver and broadcast; its size does not depend on the documents.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("kinds array<int>, starts array<int>, ends array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        random = RandomStrings(shared.value, ratio=ratio)
        for texts in batches:
            rows = []
            for text in texts:
                found = base_spans(text)
                found = sorted(found + random.spans(text, found))
                rows.append(([k for _, k, _ in found], [a for a, _, _ in found], [b for _, _, b in found]))
            yield pd.DataFrame(rows, columns=["kinds", "starts", "ends"])

    names = F.array(*map(F.lit, KINDS))
    column, raw = fresh(docs, column, "__found")
    found = docs.withColumn(raw, find(text_of("text")))
    return found.withColumn(column, F.transform(
        F.arrays_zip(F.col(f"{raw}.kinds").alias("k"), F.col(f"{raw}.starts").alias("a"), F.col(f"{raw}.ends").alias("b")),
        lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["a"].alias("start"), x["b"].alias("end")))).drop(raw)


def joined(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__spans")
    count = lambda kind: F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__spans", lambda x: x["kind"] != "token")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined("__spans").alias("spans"))
