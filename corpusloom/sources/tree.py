"""A directory tree as a Spark data source that prunes while it lists and plans its partitions by bytes.

``format("corpus_files")`` walks the tree directory by directory. Ignored directories are never entered, ignored files, other
extensions and too large files never planned; filters on ``size_bytes`` and ``repo`` reach the walk. A partition is a run of
files of about ``partitionBytes``; its task opens them one by one and hands them on in Arrow batches of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from corpusloom.functions import paths

SCHEMA = "repo string, path string, size_bytes bigint, raw binary"
ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("raw", pa.binary())])
PARTITION_BYTES, BATCH_BYTES, LISTERS = 128 << 20, 16 << 20, 32


@dataclass
class Files(InputPartition):
    """``(repo, path, place, size)`` of the files of one task."""

    files: list[tuple[str, str, str, int]]


def filesystem(location: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(location if "://" in location else f"file://{os.path.abspath(location)}")


class CorpusFiles(DataSource):
    """Options: ``path``; ``repo``, ``profile``, ``maxBytes``, ``overBytes``, ``extensions`` (comma-joined), ``content`` (``false``:
    names and sizes only), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.repo, self.profile = options.get("repo"), options.get("profile", "scan")
        self.most = int(options["maxBytes"]) if options.get("maxBytes") else None
        self.over = int(options["overBytes"]) if options.get("overBytes") else None
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.content = options.get("content", "true") == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.repos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the size and sets of repositories are kept here; all others go back to Spark."""
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("size_bytes",):
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(most, self.most)
            elif isinstance(f, EqualTo | In) and f.attribute == ("repo",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repos = wanted if self.repos is None else self.repos & wanted
            else:
                yield f

    def listed(self) -> Iterator[tuple[str, str, str, int]]:
        """All wanted files. Directories of one depth are listed at the same time."""
        store, top = filesystem(self.root)
        level = [top]
        with ThreadPoolExecutor(LISTERS) as pool:
            while level:
                below = []
                for entries in pool.map(lambda d: store.get_file_info(pafs.FileSelector(d)), level):
                    for e in sorted(entries, key=lambda e: e.path):
                        repo, path = self._named(e.path[len(top) :].lstrip("/"))
                        if self.repos is not None and repo is not None and repo not in self.repos:
                            continue
                        if e.type == pafs.FileType.Directory:
                            if (self.repo is None and not path) or not paths.is_ignored_dir_name(e.base_name, self.profile):
                                below.append(e.path)
                        elif e.type == pafs.FileType.File and repo is not None and self._wanted(e):
                            yield repo, path, e.path, e.size
                level = below

    def _named(self, relative: str) -> tuple[str | None, str]:
        """Repository and path within it; without a name of its own the first segment is the repository."""
        if self.repo is not None:
            return self.repo, relative
        repo, _, path = relative.partition("/")
        return (repo, path) if path or repo else (None, "")

    def _wanted(self, e: pafs.FileInfo) -> bool:
        if self.most is not None and e.size > self.most or self.over is not None and e.size <= self.over:
            return False
        if self.extensions and not e.base_name.endswith(self.extensions):
            return False
        return not paths.is_ignored_file_name(e.base_name)

    def partitions(self) -> list[Files]:
        planned, held = [[]], 0
        for f in self.listed():
            if planned[-1] and held + f[3] > self.partition_bytes:
                planned.append([])
                held = 0
            planned[-1].append(f)
            held += max(f[3], 4096)
        return [Files(files) for files in planned]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.root)
        rows, held = [], 0
        for repo, path, place, size in partition.files:
            raw = None
            if self.content:
                with store.open_input_stream(place) as f:
                    raw = f.read()
            rows.append((repo, path, size, raw))
            held += size if self.content else 0
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
