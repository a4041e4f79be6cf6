"""Text and JSON sources of logs, traces and reports.

A log is read as lines, so Spark cuts a large one by byte ranges. What a line belongs to depends on all lines before it; each
range gives a small summary (its lines and the records that begin in it), the summaries are added up in order, and every
line gets its place from its range's sum and its own place in the range. So no task holds a whole log, and a record that
goes across ranges is whole.

Small files come one in a row. Their folders are listed by tasks and their names written, so the driver holds none of them
however many there are.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.session import stored
from corpusloom.sources.tree import BATCH_BYTES, PARTITION_BYTES, filesystem

#: Names in a batch, the least that a file counts for, and the tasks of a listing for each core.
NAMES, FILE_BYTES, TASKS = 10_000, 4_096, 4
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_READ = pa.schema([("path", pa.string()), ("raw", pa.binary())])


def read_logs(spark: SparkSession, location: str) -> DataFrame:
    """One row per log file: ``(path, text)``; for small files, one in a row. Hidden and empty files are left out.

    A pattern, a single file and a store that Arrow does not open are left to Spark, which lists on the driver.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    found = None if re.search(r"[*?\[{]", location) else _folder(top)
    if found is None:
        files = spark.read.option("recursiveFileLookup", True).text(location, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    begin, cut = (top.removesuffix(found), 0) if top.endswith(found) else (top, len(found))
    files = _listed(spark, top, found)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest("size", F.lit(FILE_BYTES))), F.lit(0))).first()
    tasks = max(1, min(n, TASKS * spark.sparkContext.defaultParallelism), -(-size // PARTITION_BYTES))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(top)
        rows, held = [], 0
        for batch in batches:
            for name in batch["path"].to_pylist():
                with store.open_input_stream(name) as f:  # decompressed by its ending
                    raw = f.read()
                rows.append((begin + _encoded(name[cut:]), raw))
                held += len(raw)
                if held >= BATCH_BYTES or len(rows) >= NAMES:
                    yield _batch(rows, _READ)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _READ)

    # as Spark's own reader, the bytes are taken for UTF-8
    return files.select("path").repartition(tasks).mapInArrow(read, "path string, raw binary").select("path", F.col("raw").cast("string").alias("text"))


def _store(top: str) -> tuple[pafs.FileSystem, str]:
    return filesystem(re.sub("^file:/+", "/", top))


def _folder(top: str) -> str | None:
    """The folder as its store names it; none if it is no folder or Arrow does not open the store."""
    try:
        store, name = _store(top)
        name = name.rstrip("/")
        return name if name and store.get_file_info(name).type == pafs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def _listed(spark: SparkSession, top: str, folder: str) -> DataFrame:
    """``(path, size)`` of all files below ``folder``, depth by depth; the names are written by the tasks that list them."""

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(top)
        rows = []
        for batch in batches:
            for name in batch["path"].to_pylist():
                for row in _entries(store, name):
                    rows.append(row)
                    if len(rows) >= NAMES:
                        yield _batch(rows, _LISTED)
                        rows = []
        if rows:
            yield _batch(rows, _LISTED)

    level, files = spark.createDataFrame([(folder,)], "path string"), []
    while True:
        tasks = level if not files else level.repartition(TASKS * spark.sparkContext.defaultParallelism)
        found = stored(tasks.mapInArrow(entries, "path string, size bigint, folder boolean"), "listed")
        files.append(found.filter("not folder").select("path", "size"))
        level = found.filter("folder").select("path")
        if level.isEmpty():
            break
    whole = files[0]
    for some in files[1:]:
        whole = whole.unionByName(some)
    return whole


def _entries(store: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """Files with content and folders, without those that Spark passes over. A local folder is read as a stream, however many files it has."""
    if isinstance(store, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            listed = ((f"{folder}/{e.name}", e.is_dir(), e.stat().st_size) for e in found if not _passed_over(e.name))
            yield from ((path, 0 if is_dir else size, is_dir) for path, is_dir, size in listed if is_dir or size and not _hidden(path))
    else:
        for e in store.get_file_info(pafs.FileSelector(folder)):
            is_dir = e.type == pafs.FileType.Directory
            if not _passed_over(e.base_name) and (is_dir or e.size and not _hidden(e.path)):
                yield e.path, 0 if is_dir else e.size, is_dir


def _hidden(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _passed_over(name: str) -> bool:
    return (_hidden(name) or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))


def _encoded(path: str) -> str:
    """A path as Spark gives it: characters that no URI may hold as their bytes."""
    whole = lambda c: c in "/+&=~!'();,@$:*-._" or (c.isalnum() if c < "\x80" else unicodedata.category(c)[0] != "Z" and unicodedata.category(c) != "Cc")
    return "".join(c if whole(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_log_lines(spark: SparkSession, location: str) -> DataFrame:
    """``(path, range, seq, line)``: lines in byte ranges of their files; ``seq`` has their order within a range."""
    lines = spark.read.option("recursiveFileLookup", True).text(location)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"),
    )


def numbered_records(lines: DataFrame, begins: Column) -> DataFrame:
    """``lines`` with ``line_no`` and ``record`` in their file: a record begins at each line for which ``begins`` holds.

    Lines before the first of them are record 0.
    """
    marked = lines.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int"))
    order = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("path", "range").agg(F.count(F.lit(1)).alias("_lines"), F.sum("_begins").alias("_records"))
    before = sums.select(
        "path", "range", F.coalesce(F.sum("_lines").over(order), F.lit(0)).alias("_l"), F.coalesce(F.sum("_records").over(order), F.lit(0)).alias("_r")
    )
    inside = Window.partitionBy("path", "range").orderBy("seq")
    placed = marked.withColumn("_n", F.row_number().over(inside)).withColumn("_m", F.sum("_begins").over(inside))
    return placed.join(before, ["path", "range"]).select(
        "path", (F.col("_l") + F.col("_n")).alias("line_no"), (F.col("_r") + F.col("_m")).alias("record"), "line"
    )


def log_records(lines: DataFrame, begins: Column) -> DataFrame:
    """``(path, record, first_line, text)``: the records of each log, whole; what a task holds is one record."""
    numbered = numbered_records(lines, begins)
    grouped = numbered.groupBy("path", "record").agg(F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return grouped.select("path", "record", "first_line", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def read_coverage(spark: SparkSession, location: str) -> DataFrame:
    """One row per coverage document: ``(run_id, json)`` with the file path as run id; there may be millions of them."""
    return read_logs(spark, location).select(F.col("path").alias("run_id"), F.col("text").alias("json"))
