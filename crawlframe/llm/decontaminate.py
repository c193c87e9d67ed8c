"""Benchmark passages in documents by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from .common import all_columns, fold_table, fresh, stored, table, text_of

WINDOW = 10
#: Benchmark windows, and bytes of their text, that one pass searches for; more take further passes.
PASS_WINDOWS = 200_000
PASS_BYTES = 16 << 20
#: Windows in one piece of a long benchmark item.
PIECE_WINDOWS = 2_000

_FOLD = fold_table(keep_marks=False)
HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def benchmark_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split()


class WuManber:
    """Search tables for word sequences of one length.

    ``shift`` maps a block of words to how far a scan may jump when a position ends with it; a block no pattern has
    allows the largest jump. ``buckets`` maps the last block of a pattern, then its first, to the patterns.
    """

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, length), length - end)
            at = self.buckets.setdefault(words[-self.block:], {}).setdefault(words[:self.block], [])
            at.append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of every occurrence, overlapping ones included."""
        length, block, shift, far = self.length, self.block, self.shift, self.length - self.block + 1
        end, n = length, len(words)
        while end <= n:
            tail = tuple(words[end - block:end])
            jump = shift.get(tail, far)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, items in self.buckets[tail].get(tuple(words[start:start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, end, items
            end += 1


def tables_for(pieces: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One table for each length of window among the pieces; a piece is (item id, words joined by a space)."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, joined in pieces:
        words = joined.split(b" ")
        length = min(window, len(words))
        for start in range(len(words) - length + 1):
            items = by_length.setdefault(length, {}).setdefault(tuple(words[start:start + length]), set())
            if item is not None:
                items.add(item)
    return [WuManber(length, patterns) for length, patterns in sorted(by_length.items())]


def find(tables: list[WuManber], text: bytes) -> tuple[int, list[int], list[int], list[str]]:
    """(words, starts and ends of the merged hit spans, ids of the items found)."""
    words = benchmark_words(text)
    spans, items = [], set()
    for searcher in tables:
        for start, end, found in searcher.search(words):
            spans.append((start, end))
            items |= found
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return len(words), starts, ends, sorted(items)


def pieces_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words, windows) of the items with words; long items are cut so that no window is lost."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"]):
                words = benchmark_words(bytes(text))
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WINDOWS):
                    piece = words[at:at + PIECE_WINDOWS + window - 1]
                    rows.append((item, b" ".join(piece), max(1, len(piece) - window + 1)))
            yield pd.DataFrame(rows, columns=["item", "words", "windows"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text_of("text").cast("binary").alias("text"))
    return rows.mapInPandas(cut, "item string, words binary, windows long")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   pass_windows: int = PASS_WINDOWS) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of HITS, and its name; of several passes the starts and ends are not merged yet.

    Each pass gathers and broadcasts at most about ``pass_windows`` windows or PASS_BYTES of benchmark text; the number
    of passes grows with the benchmark. One pass is a narrow map. Several run one after another over the rows, stored
    with a number: each stores the hits of the rows that have some and drops its tables before the next one starts, so
    a task never holds more than one pass's tables. Only these hits are shuffled, no text of a document is.
    """
    pieces = pieces_of(benchmark, window)
    size = pieces.agg(F.sum("windows"), F.sum(F.octet_length("words"))).first()
    passes = max(1, math.ceil((size[0] or 0) / pass_windows), math.ceil((size[1] or 0) / PASS_BYTES))
    name, row, found = fresh(docs, "__hits", "__row", "__found")
    text = text_of("text").cast("binary")
    if passes == 1:
        return docs.withColumn(name, _search(_shared(pieces), window)(text)), name
    pieces = stored(pieces, "benchmark-pieces")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "benchmark-rows")
    parts = []
    for k in range(passes):
        shared = _shared(pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k))
        hits = rows.select(F.col(row).alias("row"), _search(shared, window)(text).alias("hits"))
        parts.append(stored(hits.where(F.size("hits.starts") > 0), f"benchmark-hits-{k}"))
        shared.destroy()
    lists = [F.flatten(F.collect_list(f"hits.{c}")).alias(c) for c in ("starts", "ends", "items")]
    together = (reduce(DataFrame.unionByName, parts).groupBy(F.col("row").alias(row))
                .agg(F.max("hits.n_words").alias("n_words"), *lists).select(row, F.struct("n_words", "starts", "ends", "items").alias(found)))
    none = [F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("starts", "int"), ("ends", "int"), ("items", "string"))]
    out = rows.join(stored(together, "benchmark-hits"), row, "left")
    return out.withColumn(name, F.coalesce(found, F.struct(_word_count(text).alias("n_words"), *none))).drop(row, found), name


def _shared(pieces: DataFrame):
    """The pieces of one pass, broadcast."""
    own = [(r["item"], bytes(r["words"])) for r in pieces.select("item", "words").distinct().collect()]
    return pieces.sparkSession.sparkContext.broadcast(own)


def _search(shared, window: int):
    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = tables_for(shared.value, window)
        for texts in batches:
            yield pd.DataFrame([find(tables, bytes(t)) for t in texts], columns=["n_words", "starts", "ends", "items"])

    return search


@F.pandas_udf(LongType())
def _word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(benchmark_words(bytes(t))) for t in texts], dtype="int64")


def merged(name: str) -> Column:
    """The passes' hits as one struct: n_words, n_hit, spans, items."""
    spans = F.array_sort(F.arrays_zip(F.col(f"{name}.starts").alias("start"), F.col(f"{name}.ends").alias("end")))
    seen = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], x["end"]).alias("upto")))
    return F.struct(F.col(f"{name}.n_words").alias("n_words"), seen["n"].cast("long").alias("n_hit"), spans.alias("spans"),
                    F.array_sort(F.array_distinct(f"{name}.items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans of hit words, and the benchmark items found.

    A window is WINDOW consecutive words of an item, or all words of a shorter one; a word inside an occurrence of a
    window is hit. NULL and empty texts have no words. Items without words match nothing; items that repeat an id
    count once; windows of an item without an id hit words but add no item. Rows that repeat a doc_id are judged
    each on their own. Empty tables give no rows, or rows without hits.
    """
    found, name = benchmark_hits(docs.select("doc_id", "text"), benchmark, pass_windows=pass_windows)
    return found.select("doc_id", merged(name).alias("hits")).select("doc_id", "hits.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all columns.

    NULL and empty texts, and texts without words, stay. Rows that repeat a doc_id or a text are judged each on their
    own, so copies stay or go together. An empty benchmark, or one of items without words, takes nothing; an empty
    table gives no rows. Columns of any name are kept.
    """
    found, name = benchmark_hits(docs, benchmark, pass_windows=pass_windows)
    return found.where(F.size(f"{name}.starts") == 0).select(all_columns(docs))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT r, i, dw.m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
