"""A stored frontier from which batches of URLs are taken, each row once."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import first_per_key
from ..operators.frontier import first_by_url
from ..schemas import FRONTIER


class WaitingUrls:
    """Frontier rows on disk in versions; a version is a small file that names folders of rows.

    Rows come in by ``spill`` and are taken out by ``refill``. Each first writes a folder of its own, which nobody
    reads yet, and then one file with the next version's number, which must not exist: that is the step that counts.
    A failure before it leaves the last version, with no row lost or taken; one after it leaves the new version, whose
    batch can be read again. Of two writers at a time one fails and has changed nothing. No table is rewritten to take
    rows out; ``compact`` does so when asked.

    A URL is there once: a later spill of it replaces the row, also after it was taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> dict:
        """The last version: its number, and the folders of rows put in and taken out, each with the version it came with."""
        files, folder = self._system(), self._file("versions")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "put": [], "taken": []}
        text = self.spark.read.text(f"{self.path}/versions/{max(numbers):012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, last: dict, **changes) -> dict:
        """Write the version after ``last``; an error if there is one already."""
        new = {**last, **changes, "number": last["number"] + 1}
        hadoop, made = self._hadoop, self._file(f"versions/{uuid.uuid4().hex}.tmp")
        out = self._system().create(made, False)
        out.write(json.dumps(new).encode())
        out.close()
        context = hadoop.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(made, self._file(f"versions/{new['number']:012d}.json"), kinds)
        return new

    def _written(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.select(*FRONTIER.names).write.parquet(f"{self.path}/{name}")
        return name

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(FRONTIER).parquet(f"{self.path}/{folder}")

    def spill(self, rows: DataFrame) -> None:
        """Put rows in; URLs must be unique among them (see ``upsert_frontier``)."""
        last = self.version()
        self._commit(last, put=[*last["put"], [self._written(rows, "put"), last["number"] + 1]])

    def waiting(self, version: dict | None = None) -> DataFrame:
        """Rows that were put in and not taken since. What happened last to a URL counts."""
        version = version or self.version()
        none = self.spark.createDataFrame([], FRONTIER).withColumns({"_at": F.lit(0), "_in": F.lit(False)})
        events = [self._rows(folder).withColumns({"_at": F.lit(at), "_in": F.lit(kind == "put")})
                  for kind in ("put", "taken") for folder, at in version[kind]]
        return first_per_key(reduce(DataFrame.unionByName, events, none), ["url"], [F.col("_at").desc()]).filter("_in").drop("_at", "_in")

    def refill(self, needed: int) -> DataFrame:
        """Take the first ``needed`` rows in key order; they are waiting no longer. None are taken where none are needed."""
        last = self.version()
        if needed <= 0:
            return self.spark.createDataFrame([], FRONTIER)
        folder = self._written(first_by_url(self.waiting(last), needed), "taken")
        self._commit(last, taken=[*last["taken"], [folder, last["number"] + 1]])
        return self._rows(folder)

    def batches(self) -> DataFrame:
        """All rows taken since the last ``compact``, with the version that took them: a reader that failed starts here."""
        taken = self.version()["taken"]
        none = self.spark.createDataFrame([], FRONTIER).withColumn("batch", F.lit(0))
        return reduce(DataFrame.unionByName, [self._rows(f).withColumn("batch", F.lit(at)) for f, at in taken], none)

    def compact(self) -> None:
        """Rewrite what is waiting as one folder and forget the batches; folders no version names may then be deleted."""
        last = self.version()
        self._commit(last, put=[[self._written(self.waiting(last), "put"), last["number"] + 1]], taken=[])

    def clean(self) -> None:
        """Delete the folders the last version does not name. Nobody may be reading or writing older ones."""
        last, files = self.version(), self._system()
        named = {folder for kind in ("put", "taken") for folder, _ in last[kind]} | {"versions"}
        for status in files.listStatus(self._file("")):
            if status.getPath().getName() not in named:
                files.delete(status.getPath(), True)
