"""Spelling variants: words one edit apart, found by products of blocks of letter counts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, stored, table, text_of

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many, by the checksum of id and run, loses a letter.
DAMAGE = 97
#: A form is so many times as frequent as its variant, at least.
RATIO = 2
#: Words of a cell in one block of a product, on its own side and on the side of those that visit it.
OWN_BLOCK, GUEST_BLOCK = 4_096, 16_384
#: Words that one product compares with a block, and rows a task gathers before it works them off.
SLICE, GATHER = 1_024, 50_000
#: Words for each task that compares; marks of a cell of words with the same first, or last, letters.
TASK_WORDS = 5_000
FIRST, LAST = "<", ">"
#: Distinct words a task counts before it sends them on, and characters of a text it looks at at once.
COUNTED, PART = 200_000, 1 << 20

#: Code points up to U+00FF are bytes here: letters stay, A-Z lower-cased, and all others become spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of at least LEAST_LENGTH letters, lower-cased and in Latin-1, in lists of bounded length."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        upto = data.find(b" ", at + PART)
        upto = len(data) if upto < 0 else upto
        yield [run for run in data[at:upto].split() if len(run) >= LEAST_LENGTH]
        at = upto


def checksum(run: bytes, prefix: int) -> int:
    """That of the run in UTF-8, carried on from that of the id."""
    return zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)


def word_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more, over all texts.

    Tasks count before they send, so a word that fills a third of the corpus comes once per task and flush.
    """
    def as_frame(total: Counter[bytes]) -> pd.DataFrame:
        rows = [(word.decode("latin-1"), n) for word, n in total.items() if n and len(word) >= LEAST_LENGTH]
        return pd.DataFrame(rows, columns=["word", "n"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for pdf in frames:
            for key, text in zip(pdf["id"], pdf["text"]):
                prefix = zlib.crc32(f"{key}:".encode())
                for some in runs(text):
                    total.update(some)
                    # equal runs of a document share the checksum, and so all lose the same letter or none
                    hit = {run for run in set(some) if checksum(run, prefix) % DAMAGE == 0}
                    for run in filter(hit.__contains__, some) if hit else ():
                        at = checksum(run, prefix) % len(run)
                        total[run] -= 1
                        total[run[:at] + run[at + 1:]] += 1
                    if len(total) > COUNTED:
                        yield as_frame(total)
                        total.clear()
        yield as_frame(total)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of(column).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def end_letters(words: int) -> int:
    """How many letters at an end place a word, so that the words of a block stay in the hundreds."""
    return max(1, int(math.log(max(words, 1) / 400, 8))) if words > 400 else 1


def cells_of(word: str, ends: int) -> list[tuple[str, int]]:
    """(cell, role) of a word: at home (0), as a guest at home (1), and as a guest among words one letter longer (2).

    A cell holds words of one length that share their first letters, or their last ones. Of k letters at either end,
    2k not above the longer word's length, one edit leaves one end as it is, so two words one edit apart meet.
    """
    out = []
    for length, role in ((len(word), 0), (len(word), 1), (len(word) + 1, 2)):
        k = min(ends, length // 2)
        out += [(f"{length}{FIRST}{word[:k]}", role), (f"{length}{LAST}{word[-k:]}", role)]
    return out


def letter_counts(points: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """One row per word: how often it has each letter. Single precision where that is exact."""
    place = np.repeat(np.arange(len(lengths)), lengths) * len(alphabet) + np.searchsorted(alphabet, points)
    kind = np.float32 if lengths.max() < 2_000 else np.float64
    return np.bincount(place, minlength=len(lengths) * len(alphabet)).reshape(len(lengths), -1).astype(kind)


class Words:
    """Words of one length as a matrix of code points, with their letter counts."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.letters = points.reshape(len(words), -1)
        self.points = points

    def count(self, alphabet: np.ndarray) -> None:
        self.counts = letter_counts(self.points, self.lengths, alphabet)
        self.squares = (self.counts * self.counts).sum(1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one replaced letter (rows of equal length), or one more letter in ``b``, is all that differs in each row."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    prefix = np.logical_and.accumulate(a == b[:, :n], 1).sum(1)
    suffix = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return prefix + suffix >= n


def near_pairs(own: list[str], guests: list[str], k: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of words one edit apart: ``own`` of one length, ``guests`` of the same length or of one letter less.

    The squared distance of two words' letter counts is |a|^2 + |b|^2 - 2 ab, products of whole blocks; one edit makes
    it one or two, so all other pairs are out, and the rest are compared letter by letter. Words that share both ends
    meet twice: among those with the same last letters they count only if the first ``k`` differ.
    """
    home, visitors = Words(own), Words(guests)
    alphabet = np.unique(np.concatenate((home.points, visitors.points)))
    home.count(alphabet)
    visitors.count(alphabet)
    left, right = [], []
    for top in range(0, len(own), SLICE):
        for at in range(0, len(guests), SLICE):
            distance = home.squares[top:top + SLICE, None] + visitors.squares[at:at + SLICE]
            distance -= 2 * (home.counts[top:top + SLICE] @ visitors.counts[at:at + SLICE].T)
            distance -= 1  # one and two become zero and one, zero and three and more do not
            i, j = np.nonzero((distance == 0) | (distance == 1))
            a, b = home.letters[top + i], visitors.letters[at + j]
            near = one_edit(b, a)
            if last:
                near &= (a[:, :k] != b[:, :k]).any(1)
            left.append(top + i[near])
            right.append(at + j[near])
    return np.concatenate(left), np.concatenate(right)


def _link_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell and blocks; a group is never cut and holds two blocks of bounded size."""
    held: list[pd.DataFrame] = []

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        role, word, n = pdf["role"].to_numpy(), pdf["word"].to_numpy(), pdf["n"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for (cell, _, _), places in pdf.groupby(["cell", "i", "j"], sort=False).indices.items():
            last = LAST in cell
            k = len(cell.split(LAST if last else FIRST)[1])
            kinds = role[places]
            own = places[kinds == 0]
            for kind in (1, 2):
                guests = places[kinds == kind]
                if len(own) and len(guests):
                    a, b = near_pairs(word[own].tolist(), word[guests].tolist(), k, last)
                    a, b = own[a], guests[b]
                    if kind == 1:
                        later = word[a] < word[b]
                        a, b = a[later], b[later]
                    out.append((a, b))
        a = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in out)])
        b = np.concatenate([np.zeros(0, np.int64), *(y for _, y in out)])
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        return pd.DataFrame({"word": word[a], "other": word[b], "other_n": n[b]})

    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= GATHER:
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            open_rows = ((whole["cell"] == last["cell"]) & (whole["i"] == last["i"]) & (whole["j"] == last["j"])).to_numpy()
            if not open_rows.all():
                yield links(whole[~open_rows].reset_index(drop=True))
            held = [whole[open_rows]]
    if held and sum(map(len, held)):
        yield links(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, count: int) -> DataFrame:
    """(word, other, other_n) for ``count`` distinct ``words`` (word, n) one edit apart, each pair in both directions.

    Home words of a cell are dealt to blocks, guests to blocks of their own, and every two blocks meet once in a group
    of its own.
    """
    ends, tasks = end_letters(count), math.ceil(max(count, 1) / TASK_WORDS)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(cell, role, word, n) for word, n in zip(pdf["word"], pdf["n"]) for cell, role in cells_of(word, ends)]
            yield pd.DataFrame(rows, columns=["cell", "role", "word", "n"])

    placed = words.select("word", "n").mapInPandas(place, "cell string, role int, word string, n long")
    home = F.col("role") == 0
    # stored, so that both sides of the join are plain exchanges and a large cell's rows can be split over tasks
    sizes = stored(placed.groupBy("cell").agg(F.count_if(home).alias("own"), F.count_if(~home).alias("guests")).where(F.col("own") > 0)
                   .select("cell", F.ceil(F.col("own") / OWN_BLOCK).cast("int").alias("own_blocks"),
                           F.ceil(F.col("guests") / GUEST_BLOCK).cast("int").alias("guest_blocks")), "spelling-cells")

    def block(blocks: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(blocks)).cast("int")

    def all_of(blocks: str) -> Column:
        return F.sequence(F.lit(0), F.col(blocks) - 1)

    dealt = (placed.join(sizes, "cell")
             .withColumn("i", F.explode(F.when(home, F.array(block("own_blocks"))).otherwise(all_of("own_blocks"))))
             .withColumn("j", F.explode(F.when(home, all_of("guest_blocks")).otherwise(F.array(block("guest_blocks")))))
             .select("cell", "i", "j", "role", "word", "n"))
    # so many tasks, however few bytes their rows have: comparing is what takes time
    return (dealt.repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
            .mapInPandas(_link_cells, "word string, other string, other_n long"))


def roots_of(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the end of each word's path over ``forms`` (word, form); every word with a form is there.

    Each round takes twice as many steps at once. A path at most doubles its count with every step, so that it is
    short, and has no circle.
    """
    paths = stored(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    for _ in range(rounds):
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "spelling-paths")
        paths = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return paths
    raise RuntimeError(f"paths do not end after {rounds} rounds")


def spelling_variants(docs: DataFrame, column: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of the texts.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least five letters
    and with three occurrences over all; a run whose checksum with the doc_id is divisible by 97 loses one letter
    first. n_near counts words exactly one edit away. ``form`` is the most frequent of these (ties: the first in
    code-point order) if it is at least twice as frequent as the word, and ``root`` what the forms end in, the word
    itself without a form.

    Cells bring together words of equal and adjacent lengths that share an end; within them products of letter-count
    blocks give squared distances, pairs at a distance above two go, and the rest are compared exactly.

    NULL and empty texts have no words. A NULL doc_id counts as an empty one. Repeated rows count each time. An empty
    table, or one without such words, gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    words = stored(word_counts(docs, column), "spelling-words")
    near = near_words(words, words.count())
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    far = F.col("other_n") >= RATIO * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(far, F.col("other")).alias("form"), F.when(far, F.col("other_n")).alias("form_n")),
                   "spelling-forms")
    roots = roots_of(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
