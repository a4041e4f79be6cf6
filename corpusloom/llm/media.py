"""Media columns kept in archives, behind a custom Spark data source.

Writing: each task packs its members into ZIP archives (members stored as they are) in a folder that all executors share;
an archive ends at ``archiveBytes``, so its directory stays small. Task attempts write under names of their own, and each
commit adds a manifest that names the archives of the successful ones, so lost executors leave no rows and appends add up; an
overwriting commit's manifest names the manifests it replaces.

Reading: a partition is a byte range of an archive. It reads the archive's directory, takes the members whose offset lies
in its range, and streams them in Arrow batches. A member that cannot be read is tried again by its offset, on a newly
opened file, without touching the others; after ``retries`` attempts its row carries the error instead of the bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.llm.common import shared_folder

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3

MEMBER_SCHEMA = "doc_id bigint, n_bytes bigint, media binary, error string"
ARROW_MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
MANIFEST = "_archives-"

WIDTH = 192
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---- the data source ------------------------------------------------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


class MediaArchives(DataSource):
    """``format("media_archives")``: options ``path``, and ``archiveBytes``, ``rangeBytes``, ``retries``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.limit = int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _filesystem(self.path)
        store.create_dir(folder, recursive=True)
        task, done, out, archive, name = TaskContext.get().partitionId(), [], None, None, ""

        def close():
            archive.close()
            done.append((name, out.tell()))
            out.close()

        for batch in iterator:
            for doc_id, n_bytes, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                if archive is not None and out.tell() >= self.limit:
                    close()
                    archive = None
                if archive is None:
                    name = f"part-{task:05d}-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{folder}/{name}")
                    archive, members = zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED), 0
                member = zipfile.ZipInfo(f"{members:08d},{'' if doc_id is None else doc_id},{n_bytes}.png")
                archive.writestr(member, media)
                members += 1
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        store, folder = _filesystem(self.path)
        store.create_dir(folder, recursive=True)
        archives = sorted(a for m in messages if m is not None for a in m.archives)
        replaces = sorted(_manifests(store, folder)) if self.overwrite else []
        with store.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"archives": archives, "replaces": replaces}).encode())

    def abort(self, messages) -> None:
        """Nothing to undo: archives that no manifest names are never read."""


def _manifests(store, folder: str) -> dict[str, dict]:
    """The manifests of all commits by file name; one per commit, however many archives it has."""
    found = {}
    for info in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_file(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    return found


class _Forward:
    """An output stream without seek, as ``zipfile`` wants to see it."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def tell(self) -> int:
        return self.out.tell()

    def flush(self) -> None:
        self.out.flush()


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        store, folder = _filesystem(self.path)
        commits = _manifests(store, folder)
        replaced = {name for m in commits.values() for name in m["replaces"]}
        archives = sorted((name, size) for commit, m in commits.items() if commit not in replaced for name, size in m["archives"])
        ranges = [ByteRange(name, a, min(a + self.range, size)) for name, size in archives for a in range(0, size, self.range)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, folder = _filesystem(self.path)
        path = f"{folder}/{partition.archive}"
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        for member in members:
            _, doc_id, n_bytes = member.filename.removesuffix(".png").split(",")
            media, error = self._member(store, path, member)
            rows.append((int(doc_id) if doc_id else None, int(n_bytes), media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _member(self, store, path: str, member: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        error = ""
        for _ in range(self.retries):
            try:
                return read_member(store, path, member), None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error


def read_member(store, path: str, member: zipfile.ZipInfo) -> bytes:
    """The stored bytes of one member by its offset, checked against the directory's size and checksum."""
    with store.open_input_file(path) as f:
        f.seek(member.header_offset)
        head = f.read(30)
        signature, names, extra = struct.unpack("<4s22xHH", head)
        if signature != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        f.seek(member.header_offset + 30 + names + extra)
        data = f.read(member.compress_size)
    if len(data) != member.compress_size or zlib.crc32(data) != member.CRC:
        raise ValueError("member is damaged")
    return data


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_MEMBERS.types)], schema=ARROW_MEMBERS)


# ---- the stored form: 8-bit grey PNG, 192 samples a row ---------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(text: bytes) -> bytes:
    """With blanks up to a positive multiple of the row width."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without row filters; ``ValueError`` for anything else or damaged chunks."""
    if not media.startswith(PNG_SIGNATURE):
        raise ValueError("not a PNG")
    at, header, body = len(PNG_SIGNATURE), None, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at) if at + 12 <= len(media) else (len(media), b"")
        if at + 12 + size > len(media):
            raise ValueError("image is cut off")
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(header[1], header[0] + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not supported")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Rows, mean, deviation, entropy in bits and a 64-bit hash of block means against the overall mean."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int(counts @ values) / n
    spread = max(0.0, int(counts @ (values * values)) / n - mean * mean) ** 0.5
    shares = counts[counts > 0] / n
    edges = np.arange(64) * n // 64
    blocks = np.add.reduceat(samples, edges, dtype=np.int64) / np.diff(np.append(edges, n))
    bits = int.from_bytes(np.packbits(blocks > mean).tobytes(), "big")
    entropy = float(-(shares * np.log2(shares)).sum())
    return f"rows={n // WIDTH};mean={mean:.4f};std={spread:.4f};entropy={abs(entropy):.4f};blocks={bits:016x}"


# ---- operators ------------------------------------------------------------------------------------------------------


def text_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every row: the text's UTF-8 bytes, padded, as a PNG. A null text counts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows, held = [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                media = encode_png(padded(text))
                rows.append((ids[i].as_py(), len(text), media))
                held += len(media)
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_MEMBERS.types)], names=["doc_id", "n_bytes", "media"])
                    rows, held = [], 0

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(encode, "doc_id bigint, n_bytes bigint, media binary")


def write_archives(media: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, mode: str = "append") -> None:
    media.sparkSession.dataSource.register(MediaArchives)
    media.write.format("media_archives").mode(mode).option("path", path).option("archiveBytes", archive_bytes).save()


def read_archives(spark, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, media, error`` of every member."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", path).option("rangeBytes", range_bytes).load()


def stored_media(docs: DataFrame) -> DataFrame:
    """The documents' media written to archives under the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    write_archives(text_media(docs), path)
    return read_archives(spark, path)


FEATURE_SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, error string"
)


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of every member, from its stored bytes.

    A member that could not be read or decoded keeps its id, size and error; its other columns are null.
    """
    names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]

    def row(doc_id, n_bytes, media, error):
        try:
            payload = decode_png(media) if media is not None else None
        except (ValueError, zlib.error, struct.error) as e:
            payload, error = None, f"{type(e).__name__}: {e}"
        if payload is None:
            return (doc_id, n_bytes, None, None, None, None, None, None, error)
        return (
            doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
            hashlib.sha256(media).hexdigest(), features(payload), error,
        )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "n_bytes", "media", "error")]
            rows = [row(*(c[i].as_py() for c in columns)) for i in range(batch.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return members.mapInArrow(compute, FEATURE_SCHEMA)
