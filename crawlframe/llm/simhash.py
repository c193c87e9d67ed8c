"""Near duplicates by SimHash, linked through a grid of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LAST_ID, all_columns, fold_table, fresh, stored, table, text_of, words
from .components import components
from .exact_dedup import membership_filter

SHINGLE = 3
DISTANCE = 3
#: Fingerprints of one grid cell that meet in one task; larger cells are dealt over pairs of blocks.
CELL_BLOCK = 16_384
#: Cells up to this size are compared pair by pair, larger ones by growing their components.
SMALL_CELL = 24
#: Rows a task gathers before it looks for links.
GATHER = 200_000

_LOWER = fold_table(keep_marks=True)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 values of all word shingles, repeats included; zero without words."""
    found = words(text.translate(_LOWER))
    if not found:
        return 0
    if len(found) < shingle:
        hashes = np.array([_hash(b" ".join(found))], np.uint64)
    else:
        runs = zip(*(found[i:] for i in range(shingle)))
        hashes = np.fromiter(map(_hash, map(b" ".join, runs)), np.uint64, len(found) - shingle + 1)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(column: str) -> Column:
    """Fingerprint of a text column, its 64 bits as a long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(bytes(t)) for t in texts], np.uint64).view(np.int64))

    return of(text_of(column).cast("binary"))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""
    return docs.select("doc_id", fingerprint_of("text").alias("fp"))


def segment_counts(halves: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 two-bit segments of 32-bit halves, two bits each: a point of a 16-dimensional grid."""
    m = np.uint64(0x55555555)
    return (halves & m) + ((halves >> np.uint64(1)) & m)


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint): for either half the own cell, and every cell one step lower in one dimension.

    Of two fingerprints at most three bits apart, one half differs in at most one bit. The Manhattan distance of the
    segments' counts never exceeds the number of differing bits, so in that half the points are equal or one step
    apart, and the two meet in the lower point's cell.
    """
    keys, owners = [], []
    for half in (0, 1):
        points = segment_counts((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
        base = np.uint64(half << 32)
        keys.append(points | base)
        owners.append(prints)
        for j in range(16):
            up = ((points >> np.uint64(2 * j)) & np.uint64(3)) > 0
            keys.append((points[up] - np.uint64(1 << (2 * j))) | base)
            owners.append(prints[up])
    return np.concatenate(keys), np.concatenate(owners)


def _grow(members: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members, smallest member) of the components with at least two members; each member is compared with those not
    yet reached, in slices."""
    pending = members
    while len(pending) > 1:
        reached, frontier, pending = [pending[:1]], pending[:1], pending[1:]
        while len(frontier) and len(pending):
            near = np.zeros(len(pending), bool)
            for a in frontier:
                todo = np.flatnonzero(~near)
                near[todo[np.bitwise_count(pending[todo] ^ a) <= distance]] = True
            frontier, pending = pending[near], pending[~near]
            reached.append(frontier)
        found = np.concatenate(reached)
        if len(found) > 1:
            yield found, found.min()


def cell_links(keys: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a > b) that join the fingerprints of each cell into their components; rows are sorted by cell."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    large = np.repeat(sizes > SMALL_CELL, sizes)
    left, right = [], []
    for step in range(1, min(SMALL_CELL, int(sizes.max()))):
        same = (keys[step:] == keys[:-step]) & ~large[step:]
        a, b = prints[step:][same], prints[:-step][same]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        left.append(np.maximum(a[near], b[near]))
        right.append(np.minimum(a[near], b[near]))
    for at, size in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        for found, root in _grow(np.unique(prints[at:at + size]), distance):
            others = found[found != root]
            left.append(others)
            right.append(np.full(len(others), root))
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        keys, owners = cells(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        yield pd.DataFrame({"cell": keys.view(np.int64), "fp": owners.view(np.int64)})


def _link_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group; a group is never cut, and a group has at most about two CELL_BLOCKs of rows."""
    held: list[pd.DataFrame] = []

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf.groupby(["cell", "i", "j"], sort=False).ngroup().to_numpy()
        a, b = cell_links(keys, pdf["fp"].to_numpy(np.int64).view(np.uint64))
        pairs = pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()
        swap = pairs["a"] < pairs["b"]  # signed order from here on
        return pd.DataFrame({"a": pairs["a"].where(~swap, pairs["b"]), "b": pairs["b"].where(~swap, pairs["a"])})

    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= GATHER:
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            open_rows = ((whole["cell"] == last["cell"]) & (whole["i"] == last["i"]) & (whole["j"] == last["j"])).to_numpy()
            if not open_rows.all():
                yield links(whole[~open_rows])
            held = [whole[open_rows]]
    if held and sum(map(len, held)):
        yield links(pd.concat(held, ignore_index=True))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` at most DISTANCE bits apart, enough of them to keep components."""
    placed = prints.mapInPandas(_to_cells, "cell long, fp long")
    crowded = (placed.groupBy("cell").count().where(F.col("count") > CELL_BLOCK)
               .select("cell", F.ceil(F.col("count") / CELL_BLOCK).cast("int").alias("blocks")))
    # a crowded cell's members are dealt to blocks, and every two blocks meet once
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = placed.join(crowded, "cell", "left").select(
        "cell", "fp", own.alias("p"), F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                                                .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("q"))
    groups = dealt.select("cell", F.coalesce(F.least("p", "q"), F.lit(0)).alias("i"), F.coalesce(F.greatest("p", "q"), F.lit(0)).alias("j"), "fp")
    return (groups.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
            .mapInPandas(_link_cells, "a long, b long").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (64 bits as a long), component_id and root, a fingerprint that names the
    component even where ids are missing or repeated.

    The fingerprint is over lower-cased (A-Z) three-word shingles; fingerprints at most three bits apart are linked,
    and component_id is the smallest doc_id reachable. Equal fingerprints meet as one before cells are formed. Each
    fingerprint goes to about 26 cells of a grid over bit counts per segment; sharing a cell means a Manhattan
    distance of at most one in a half, and the exact distance decides.

    NULL and empty texts have fingerprint zero and are linked like others. A NULL doc_id counts as the largest id;
    a group of such rows alone has a NULL component_id. Repeated rows share a component. An empty table gives no
    rows. Other columns are not read.
    """
    prints = stored(with_fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).alias("least"))
    roots = components(links(nodes.select("fp")), "near")
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(named, "root").select("fp", F.nullif("component_id", F.lit(LAST_ID)).alias("component_id"), "root")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "root")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, NULL counting as the largest; all columns stay.

    Where several rows of a component have that doc_id, the one of the smallest fingerprint stays, then that of the
    smallest hash of its text. Rows that share a doc_id, or have none, go only as members of a component. NULL and empty
    texts are one component; of repeated rows one stays. An empty table gives no rows.
    """
    found = stored(near_duplicates(docs), "simhash-found")
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    grouped = found.join(sizes, "root", "left_semi")
    key = lambda c: F.xxhash64(F.col(c).cast("long"))  # noqa: E731  a hash, so that the filter's cells are even
    passes = membership_filter(grouped.select(key("doc_id").alias("fp")).distinct())
    suspect, own_id, own_fp, row = fresh(docs, "__suspect", "__id", "__own_fp", "__row")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    chosen = (found.groupBy("root").agg(F.min(F.struct(id_of.alias("i"), "fp")).alias("first"))
              .select(F.col("first.i").alias(own_id), F.col("first.fp").alias(own_fp)))
    marked = docs.withColumn(suspect, passes(key("doc_id")))
    # one row of each id and fingerprint before the join, so that rows equal in both do not meet in one task; the plain
    # join keeps that order, and keys that cannot be NULL keep a test for NULL, and with it all rows' fingerprints, out
    single = (marked.where(suspect).select(id_of.alias(own_id), F.coalesce(fingerprint_of("text"), F.lit(0)).alias(own_fp),
                                           F.xxhash64(text_of("text")).alias(suspect), F.struct(*all_columns(docs)).alias(row))
              .groupBy(own_id, own_fp).agg(F.min_by(row, suspect).alias(row)))
    kept = single.join(chosen, [own_id, own_fp]).select(f"{row}.*")
    return marked.where(~F.col(suspect)).select(all_columns(docs)).unionByName(kept)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
