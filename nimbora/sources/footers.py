"""What the footers of Parquet files say, read by tasks over lists of files: no data page is read.

A file whose footer cannot be read by a task, or has no statistics for a column, is said to be unknown; what hangs on it is
read from that file's column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTERS = "path string, size long, row_group int, rows long, column string, known boolean, low date, high date, nulls long"

#: Files that one task looks into.
FILES = 200


def listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The Parquet files in ``folders``: path, length, modificationTime. Only listings are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folders).select("path", "length", "modificationTime")


def _read(columns: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    local = path.startswith("file:")
                    files, name = (pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else pyarrow.fs.FileSystem.from_uri(path)
                    footer = pq.read_metadata(name, filesystem=files)
                    places = {footer.schema.column(k).path: k for k in range(footer.num_columns)}
                except Exception:  # noqa: BLE001 - this file's columns are read instead
                    found += [(path, size, -1, None, c, False, None, None, None) for c in columns]
                    continue
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    for c in columns:
                        stats = group.column(places[c]).statistics if c in places else None
                        empty = stats is not None and stats.has_null_count and stats.null_count == group.num_rows
                        known = empty or (stats is not None and stats.has_min_max)
                        low, high = (stats.min, stats.max) if known and not empty else (None, None)
                        found.append((path, size, g, group.num_rows, c, known, low, high, stats.null_count if known and stats.has_null_count else None))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.date32(), pa.date32(), pa.int64()]
            columns_ = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns_, kinds, strict=True)], names=[x.split()[0] for x in FOOTERS.split(", ")])

    return rows


def footers(spark: SparkSession, folders: list[str], columns: list[str]) -> DataFrame:
    """For each row group of each file, and each of ``columns`` (dates): the least and largest value, as the footer says.

    ``known`` is false, and row_group -1, where a footer cannot be read; it is false, too, without statistics. A row group
    of nulls alone is known and has no values.
    """
    files = listed(spark, folders)
    parts = max(1, -(-files.count() // FILES))
    return files.select("path", "length").repartition(parts).mapInArrow(_read(columns), FOOTERS)


def distinct_dates(spark: SparkSession, folders: list[str], column: str) -> DataFrame:
    """The distinct non-null values of a date column, from footers: one column, named like it.

    A row group whose least and largest value are the same has that one. The column is read only of files that have
    another row group, or whose footers do not say.
    """
    found = footers(spark, folders, [column]).persist()
    exact = found.where("known AND low = high").select(F.col("low").alias(column))
    open_files = [r["path"] for r in found.where("NOT known OR low < high").select("path").distinct().collect()]  # names of files
    if open_files:
        exact = exact.union(spark.read.parquet(*open_files).select(F.col(column).cast("date")).where(F.col(column).isNotNull()))
    return exact.distinct()


def spans(spark: SparkSession, folders: list[str], column: str) -> DataFrame:
    """For each file: path, size, rows (null if its footer cannot be read), first_day, last_day and whether they are known."""
    groups = footers(spark, folders, [column])
    return groups.groupBy("path").agg(F.max("size").alias("size"), F.sum("rows").alias("rows"), F.min("low").alias("first_day"), F.max("high").alias("last_day"), F.min("known").alias("known"))


def signature(spark: SparkSession, folders: list[str]) -> str:
    """A text that changes with any file's name or length, from listings alone; it does not hang on the order of files."""
    files = listed(spark, folders).select(F.xxhash64(F.regexp_extract("path", "[^/]+$", 0), "length").cast("decimal(20,0)").alias("h"))
    made = files.agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).first()
    return f"{made['n']}:{made['h'] or 0}"
