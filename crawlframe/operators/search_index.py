"""Which files of stored results can hold a term: a table of trigrams, so that a search reads those files alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZE = 3
BITS = 21  # of a character
STRETCH = 4 << 20  # bytes of text that are cut at a time
MOST_GIVEN = 1_000_000  # trigrams of a file that a task remembers; beyond that some are given twice
_INDEX = "trigram string, file string"


def result_texts() -> Column:
    """All texts of a result that ``search_results`` or ``search_db_view`` look at, lists as the view joins them."""
    keywords = F.array_join(F.array_sort(F.map_keys("keywords")), " ")
    lists = [F.array_join(c, " ") for c in ("emails", "dead_links", "dead_domains")]
    return F.array(F.col("url"), F.col("title"), F.to_json(F.struct("title")), keywords, *lists)


def trigrams(texts: pa.Array) -> np.ndarray:
    """Distinct runs of three characters of lower-cased texts, a number each; none of a shorter text.

    Texts are made distinct and laid end to end in stretches, so that memory is bounded by a stretch or the longest text.
    """
    texts, parts = pc.unique(texts.drop_null()), [np.empty(0, np.int64)]
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // STRETCH)) + 1  # a text that a multiple of the size falls into begins a stretch
    for start, stop in zip([0, *cuts], [*cuts, len(texts)]):
        some = texts.slice(start, stop - start).to_pylist()
        chars = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.int64)
        within = np.ones(max(0, len(chars) - (SIZE - 1)), bool)
        last = np.cumsum([len(t) for t in some], dtype=np.int64) - 1
        for back in range(SIZE - 1):  # no run reaches from one text into the next
            over = last - back
            within[over[(over >= 0) & (over < len(within))]] = False
        codes = sum(chars[i:i + len(within)] << BITS * (SIZE - 1 - i) for i in range(SIZE))
        parts.append(pd.unique(codes[within]))
    return pd.unique(np.concatenate(parts))


def _written_out(codes: np.ndarray) -> list[str]:
    """The runs of three characters that ``trigrams`` numbered."""
    chars = np.stack([codes >> BITS * (SIZE - 1 - i) & (1 << BITS) - 1 for i in range(SIZE)], 1)
    text = chars.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i:i + SIZE] for i in range(0, len(text), SIZE)]


def _file_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, file: those of each batch that a task has not given for the file yet."""
    last, given = None, np.empty(0, np.int64)
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        for i, file in enumerate(files.dictionary.to_pylist()):
            if file != last or len(given) > MOST_GIVEN:
                last, given = file, np.empty(0, np.int64)
            codes = trigrams(batch.column("texts").filter(pc.equal(files.indices, i)).flatten())
            codes = codes[~np.isin(codes, given)]
            given = np.concatenate([given, codes])
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array(_written_out(codes), pa.string()), pa.array([file] * len(codes), pa.string())], ["trigram", "file"])


def _place(file: str) -> str:
    """The path of a file name, however its scheme and characters are written."""
    return unquote(urlparse(file).path)


class TrigramIndex:
    """An index at ``path`` of the Parquet table at ``table``; files it does not know yet are always searched."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path = spark, table.rstrip("/"), path.rstrip("/")

    def _files(self) -> dict[str, str]:
        return {_place(f): f for f in self.spark.read.parquet(self.table).inputFiles()}

    def _read(self, name: str, schema: str) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else None

    def known(self) -> set[str]:
        """Files of the index, one name per file of the table."""
        files = self._read("files", "file string")
        return {r["file"] for r in files.collect()} if files is not None else set()

    def update(self, texts: Column | None = None) -> None:
        """Index the files that are not in the index yet, and only these.

        Trigrams are made distinct per file and task, in Arrow batches, before they are shuffled. They are written in
        order, with a Bloom filter, so that a search reads those of its term alone. File names follow last: a failure
        in between leaves the files unknown, and some of their trigrams twice, which changes no search.
        """
        known = self.known()
        fresh = sorted(f for place, f in self._files().items() if place not in known)
        if not fresh:
            return
        lowered = F.transform(result_texts() if texts is None else texts, F.lower)
        rows = self.spark.read.parquet(*fresh).select(lowered.alias("texts"), F.col("_metadata.file_path").alias("file"))
        found = rows.mapInArrow(_file_trigrams, _INDEX).distinct()
        (found.repartitionByRange("trigram").sortWithinPartitions("trigram", "file").write.mode("append")
         .option("parquet.bloom.filter.enabled#trigram", "true").parquet(f"{self.path}/trigrams"))
        self.spark.createDataFrame([(_place(f),) for f in fresh], "file string").coalesce(1).write.mode("append").parquet(f"{self.path}/files")

    def candidates(self, term: str) -> list[str]:
        """Files that hold all trigrams of the term, and those the index does not know. All of them for a short term."""
        files, lowered = self._files(), term.lower()
        grams = sorted({lowered[i:i + SIZE] for i in range(len(lowered) - SIZE + 1)})
        index = self._read("trigrams", _INDEX)
        if not grams or index is None:
            return sorted(files.values())
        hits = (index.filter(F.col("trigram").isin(grams)).distinct().groupBy("file").count()
                .filter(F.col("count") == len(grams)).select("file").collect())
        may = {_place(r["file"]) for r in hits} | (files.keys() - self.known())
        return sorted(f for place, f in files.items() if place in may)

    def rows(self, term: str) -> DataFrame:
        """The table's rows in files that can hold the term; what then searches them decides on each row."""
        schema = self.spark.read.parquet(self.table).schema
        files: Iterable[str] = self.candidates(term)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
