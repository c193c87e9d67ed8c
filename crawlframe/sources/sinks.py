"""Writing results, frontier rows, findings and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import OPTIONAL_RESULT_COLUMNS, TIMESTAMP_FORMAT


def omit_empty(df: DataFrame) -> DataFrame:
    """NULL in place of empty lists, maps and strings of optional columns; JSON then leaves them out."""
    types = dict(df.dtypes)
    columns = []
    for name in df.columns:
        c = F.col(name)
        if name in OPTIONAL_RESULT_COLUMNS:
            c = F.when(c != "" if types[name] == "string" else F.size(c) > 0, c)
        columns.append(c.alias(name))
    return df.select(*columns)


def _write(df: DataFrame, path: str, fmt: str, mode: str, files: int | None = None, **options) -> None:
    # Few files only on request: a single file is written by a single task.
    out = df if files is None else df.repartition(files)
    out.write.mode(mode).options(timestampFormat=TIMESTAMP_FORMAT, **options).format(fmt).save(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, empty optional fields left out."""
    _write(omit_empty(df), path, "json", "append", ignoreNullFields="true")


def export_json(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write any table or export as JSON lines."""
    _write(omit_empty(df), path, "json", "overwrite", files, ignoreNullFields="true")


def export_findings_csv(findings: DataFrame, path: str, files: int | None = None) -> None:
    """Write findings as CSV with a header; quotes are doubled."""
    _write(findings, path, "csv", "overwrite", files, header="true", escape='"')


def export_db_view(entries: DataFrame, path: str, files: int | None = None) -> None:
    """Write database-view entries as JSON lines; the error message is left out when there is none."""
    shown = entries.drop("search_text").withColumn(
        "error_message", F.when(F.col("error_message") != "", F.col("error_message")))
    _write(shown, path, "json", "overwrite", files, ignoreNullFields="true")


def store_by_url(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows for lookup by URL: sorted by it over all files, so that each holds a range, and with a Bloom filter."""
    ordered = df.repartitionByRange("url").sortWithinPartitions("url")
    ordered.write.mode(mode).option("parquet.bloom.filter.enabled#url", "true").parquet(path)
