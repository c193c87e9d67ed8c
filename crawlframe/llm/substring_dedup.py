"""Repeated passages: a count-min prefilter over word windows, then exact grouping of the suspected ones."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange
from .common import LAST_ID, in_blocks, table, words

WINDOW = 20
BLOCK_BYTES = 8 << 20
#: Cells of a sketch row per byte of text; a word has about six bytes, so a row has some sixteen cells per window.
CELLS_PER_BYTE = 2.5
#: The two multipliers of a window's 128-bit digest, odd and else arbitrary.
_ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Longest window. From 1,024 words on there are orders of two words that all such sums modulo 2^64 take for equal.
MOST_WORDS = 512
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[ \t\n\v\f\r]")
#: Kinds of message: cells of the two sketch rows, digests, and a block's note to itself.
ROWS, DIGESTS, NOTE = (0, 1), 2, 3


def _powers(root: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``root`` and of its inverse modulo 2^64."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, r, np.uint64))), dtype=np.uint64)
                 for r in (root, pow(root, -1, 1 << 64)))


def word_hashes(texts: list[bytes], halves: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """``halves`` arrays of 64 bits of the XXH3 of every word of all texts, end to end, and the number of words of each text.

    Texts are split a chunk at a time, at white space, so that only the hashes of a long one are held whole.
    """
    parts, sizes = [], []
    for text in texts:
        at, n = 0, 0
        while at < len(text):
            found = _SPACE.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            upto = found.start() if found else len(text)
            some = words(text[at:upto])
            parts.append(b"".join(map(xxhash.xxh3_128_digest, some)))
            at, n = upto, n + len(some)
        sizes.append(n)
    flat = np.frombuffer(b"".join(parts), "<u8")
    del parts
    return [flat[k::2].copy() for k in range(halves)], np.array(sizes, np.int64)


def window_digests(hashes: np.ndarray, window: int, root: int) -> np.ndarray:
    """Sum of the word hashes times rising powers of ``root`` (mod 2^64) for each window, from prefix sums."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    up, down = _powers(root, len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)], dtype=np.uint64)))
    n = len(hashes) - window + 1
    return (sums[window:] - sums[:n]) * down[:n]


class Block:
    """The windows of one block of documents, in order of (key, start)."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        self.rows = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        (one, two), self.sizes = word_hashes(self.rows["text"].tolist())
        ends = np.cumsum(self.sizes)
        at = np.arange(max(0, len(one) - window + 1))
        at = at[np.repeat(ends, self.sizes)[:len(at)] - at >= window]  # windows lie in one row
        self.at = at
        self.first = window_digests(one, window, _ROOTS[0])[at]
        self.second = window_digests(two, window, _ROOTS[1])[at]
        keys = self.rows["key"].to_numpy(np.int64)
        row = np.repeat(np.arange(len(keys)), self.sizes)[at]
        self.rank = np.arange(len(at))
        self.tied = len(np.unique(keys)) < len(keys)
        if self.tied:  # rows of one id share their positions
            start = at - (ends - self.sizes)[row]
            place = np.stack((keys[row], start), 1)
            self.rank = np.unique(place, axis=0, return_inverse=True)[1].reshape(-1)

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - bits)
        return self.first >> shift, self.second >> shift

    def groups(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows ``chosen``: distinct digests in order (two arrays), each window's place among them, and
        whether it is the first of its digest here."""
        first, second, rank = self.first[chosen], self.second[chosen], self.rank[chosen]
        order = np.lexsort((rank, second, first))
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place, lead = np.empty(len(order), np.int64), np.empty(len(order), bool)
        group = np.cumsum(new) - 1
        place[order] = group
        lowest = rank[order][new]
        lead[order] = rank[order] == lowest[group]
        return a[new], b[new], place, lead


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the kept words, joined by one space), n_words, n_removed.

    A word goes if a window of ``window`` words over it starts earlier too: in a row of a smaller doc_id, or earlier
    in the same document. Blocks of documents (ranges of ids) sketch their windows in the two rows of a count-min
    sketch and send the cells in use, Golomb-coded, to the owners of the cells, who merge the sketches and answer with
    a bitmap of cells counted twice or more. A count is never underestimated, so each repeated window is suspected;
    only suspected windows' 128-bit digests are then grouped exactly by their owners. A window that fills a third of
    the corpus is sent once by each block. Digests are two sums of 64 bits over halves of the words' 128-bit hashes:
    among N different windows two are taken for one with a chance near N^2 / 2^129, below 10^-15 for 10^11 windows.

    NULL and empty texts have no words. A NULL doc_id counts as the largest id. Rows that repeat a doc_id count as one
    document with shared positions: a window goes if it also starts at a smaller position, so equal rows lose nothing
    to each other. Texts of fewer words than a window stay whole, with white space made single spaces. An empty table
    gives no rows. Other columns are not read.
    """
    if not 0 < window <= MOST_WORDS:
        raise ValueError(f"a window has 1 to {MOST_WORDS} words")
    rows, blocks = in_blocks(docs, block_bytes=block_bytes)
    total = blocks * block_bytes
    bits = int(np.ceil(np.log2(total * CELLS_PER_BYTE)))
    cell_span = exchange.owner_span(bits, total // 6)
    digest_span = exchange.owner_span(64, total // 12)
    owners = 1 << 64
    owners //= digest_span

    def sketch(pdf: pd.DataFrame) -> pd.DataFrame:
        block, out = int(pdf["block"].iloc[0]), []
        for kind, cells in zip(ROWS, Block(pdf, window).cells(bits)):
            out += exchange.messages(block, kind, exchange.distinct(cells), cell_span)
        return exchange.as_frame(out)

    def suspect(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return exchange.as_frame([])
        number, block = int(pdf["block"].iloc[0]), Block(pdf, window)
        chosen = np.ones(len(block.first), bool)
        for kind, cells in zip(ROWS, block.cells(bits)):
            own = answers[answers["kind"] == kind]
            found, place, times = np.unique(cells, return_inverse=True, return_counts=True)
            flags = exchange.flags_of(found, cell_span, dict(zip(own["owner"], own["payload"])))
            chosen &= (flags | (times > 1))[place]
        first, second, _, _ = block.groups(chosen)
        out = exchange.messages(number, DIGESTS, first, digest_span, second)
        out.append((number, number % owners, NOTE, exchange.pack_bits(chosen)))
        return exchange.as_frame(out)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        notes = pdf[pdf["kind"] == NOTE]
        sent = pdf[pdf["kind"] == DIGESTS]
        parts = [x for x in (notes, exchange.answer_preceded(sent) if len(sent) else None) if x is not None]
        return pd.concat(parts, ignore_index=True)[["block", "owner", "kind", "payload"]]

    def keep(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "text", "n_words", "n_removed"]
        if pdf.empty:
            return pd.DataFrame([], columns=columns)
        block = Block(pdf, window)
        note = answers.loc[answers["kind"] == NOTE, "payload"].iloc[0]
        chosen = exchange.unpack_bits(note, len(block.first))
        first, _, place, lead = block.groups(chosen)
        own = answers[answers["kind"] == DIGESTS]
        preceded = exchange.flags_of(first, digest_span, dict(zip(own["owner"], own["payload"])))
        starts = block.at[chosen][preceded[place] | ~lead]
        steps = np.zeros(int(block.sizes.sum()) + 1, np.int32)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
        gone = np.cumsum(steps)[:-1] > 0
        out, at = [], 0
        for key, text, size in zip(block.rows["key"], block.rows["text"], block.sizes):
            mask = gone[at:at + size]
            at += size
            removed = int(mask.sum())
            kept = words(text)
            if removed:
                kept = [w for w, g in zip(kept, mask.tolist()) if not g]
            out.append((key, b" ".join(kept), int(size), removed))
        return pd.DataFrame(out, columns=columns)

    by_block = rows.groupBy("block")
    message = exchange.MESSAGE
    repeated = by_block.applyInPandas(sketch, message).groupBy("owner").applyInPandas(exchange.answer_repeated, message)
    suspects = by_block.cogroup(repeated.groupBy("block")).applyInPandas(suspect, message)
    preceded = suspects.groupBy("owner").applyInPandas(group, message)
    kept = by_block.cogroup(preceded.groupBy("block")).applyInPandas(keep, "key long, text binary, n_words long, n_removed long")
    return kept.select(F.nullif("key", F.lit(LAST_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), "n_words", "n_removed")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
