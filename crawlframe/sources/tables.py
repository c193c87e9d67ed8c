"""Input tables of one data directory, and tables staged from them."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import application_folder

_lock = threading.RLock()  # one staged table may be built from another
_staged: set[str] = set()


class Tables:
    """Lazy access to ``<directory>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def stage(self, name: str, build: Callable[["Tables"], DataFrame]) -> DataFrame:
        """``build(self)``, written once per application to the shared folder and read back.

        Reports read stored results, as they would in production: only the
        columns they need, with filters pushed into the scan. A stored table
        also survives the loss of executors.
        """
        return self.spark.read.parquet(self.staged_path(name, build))

    def staged_path(self, name: str, build: Callable[["Tables"], DataFrame]) -> str:
        """Folder of a staged table, written if need be; a stream can read it."""
        path = f"{self.working_folder()}/{name}"
        with _lock:
            if path not in _staged:
                build(self).write.mode("overwrite").parquet(path)
                _staged.add(path)
        return path

    def working_folder(self) -> str:
        """Folder for what this application derives from this directory."""
        source = hashlib.md5(self.directory.encode()).hexdigest()[:12]
        return f"{application_folder(self.spark)}/{source}"
