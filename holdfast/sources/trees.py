"""File trees on a store that all executors reach: listing, streamed hashes, ranges of bytes, zip directories, written files.

A tree is a root (an absolute path of a shared mount, or an address that pyarrow.fs opens) and paths below it. Listing is a
Spark data source: the driver walks the first levels only, until there are enough folders, and tasks walk the rest; files
of no bytes are listed like any other. Contents are read in blocks by the tasks, so no file is ever held whole and none is
too large; a task's share of a listing is dealt by bytes.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..snapshots import snapshot
from .files import bare_offset

BLOCK = 1 << 20
#: Bytes of contents that one task reads.
SHARE = 1 << 30


def _at(root: str, path: str = "") -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(root)
    return store, f"{base.rstrip('/')}/{path}" if path else base


def open_file(root: str, path: str) -> pa.NativeFile:
    store, full = _at(root, path)
    return store.open_input_file(full)


def _children(store: fs.FileSystem, base: str, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """Folders (below base) and files in a folder; links are followed, but not to a folder that they lie in."""
    full = f"{base}/{folder}".rstrip("/")
    found = store.get_file_info(fs.FileSelector(full or "/"))
    name = lambda i: f"{folder}/{i.base_name}".lstrip("/")
    folders = sorted(name(i) for i in found if i.type == fs.FileType.Directory)
    if isinstance(store, fs.LocalFileSystem):
        own = os.path.realpath(full)
        folders = [f for f in folders if not (own + "/").startswith(os.path.realpath(f"{base}/{f}").rstrip("/") + "/")]
    return folders, sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path)


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, least: int):
        self.root, self.least = root, least

    def partitions(self) -> list[InputPartition]:
        store, base = _at(self.root)
        if store.get_file_info(base).type != fs.FileType.Directory:
            raise ValueError(f"{self.root} is no folder")
        walked, front = [], [""]
        while front and len(front) < self.least and len(walked) < self.least:
            walked += front
            front = [f for folder in front for f in _children(store, base.rstrip("/"), folder)[0]]
        return [_Part(f, False) for f in walked] + [_Part(f, True) for f in front]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, base = _at(self.root)
        base = base.rstrip("/")
        left = [partition.folder]
        while left:
            folder = left.pop()
            folders, files = _children(store, base, folder)
            left += folders if partition.deep else []
            for i in files:
                yield f"{folder}/{i.base_name}".lstrip("/"), i.size, i.mtime


class FileTree(DataSource):
    """path (below the root), size and modified of all files below a root. Options: path, and folders to list apart."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, size long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("folders", 256)))


def listed(spark: SparkSession, root: str, folder: str = "", folders: int = 256) -> DataFrame:
    """All files below root, or below a folder of it; paths are those below the root."""
    spark.dataSource.register(FileTree)
    found = spark.read.format("filetree").option("path", f"{root.rstrip('/')}/{folder}".rstrip("/") if folder else root).option("folders", folders).load()
    return found.withColumn("path", F.concat(F.lit(folder.strip("/") + "/"), "path")) if folder else found


def dealt(rows: DataFrame, bytes_col: str, share: int = SHARE) -> DataFrame:
    """rows in random order over as many tasks as their bytes need; rows themselves are small, so Spark cannot tell."""
    rows = snapshot(rows)
    total = rows.agg(F.coalesce(F.sum(bytes_col), F.lit(0))).first()[0]
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // share)))


HASHED = "path string, size long, sha1 string, md5 string, crc32 string, sha1_no_header string, error string"
FAULTS = (OSError, pa.ArrowException)


def _blocks(source, start: int = 0, length: int | None = None) -> Iterator[bytes]:
    source.seek(start)
    while length is None or length > 0:
        block = source.read(BLOCK if length is None else min(BLOCK, length))
        if not block:
            return
        length = None if length is None else length - len(block)
        yield block


def digest(source, path: str) -> tuple:
    """size, sha1, md5, crc32 and sha1_no_header of an open file, in one pass over its blocks."""
    whole, other, crc, size, bare, skip = hashlib.sha1(), hashlib.md5(), 0, 0, hashlib.sha1(), None
    for block in _blocks(source):
        if skip is None:
            skip = bare_offset(block[:128], source.size(), path)
        whole.update(block)
        other.update(block)
        crc = zlib.crc32(block, crc)
        if skip and size + len(block) > skip:
            bare.update(block[max(0, skip - size) :])
        size += len(block)
    return size, whole.hexdigest().upper(), other.hexdigest().upper(), f"{crc:08X}", bare.hexdigest().upper() if skip and size > skip else None


def _hash(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open_file(root, path) as source:
                        row = (path, *digest(source, path), None)
                except FAULTS as e:
                    row = (path, None, None, None, None, None, str(e))
                yield pa.RecordBatch.from_pylist([dict(zip((c.split(" ")[0] for c in HASHED.split(", ")), row))], _schema(HASHED))

    return run


TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def hash_files(listing: DataFrame, root: str) -> DataFrame:
    """Hashes of the listed files (path, size); one with an error keeps its row, with the error's text."""
    return dealt(listing.select("path", "size"), "size").select("path").mapInArrow(_hash(root), HASHED)


class _Seekable:
    """An open file that tells of a place before its start as Python's files do."""

    def __init__(self, source: pa.NativeFile):
        self._source = source

    def __getattr__(self, name: str):
        return getattr(self._source, name)

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self._source.seek(to, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def _heads(root: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open_file(root, path) as source:
                        row = {"path": path, "head": source.read(length)}
                except FAULTS as e:
                    row = {"path": path, "error": str(e)}
                yield pa.RecordBatch.from_pylist([row], _schema("path string, head binary, error string"))

    return run


def heads(listing: DataFrame, root: str, length: int = 124) -> DataFrame:
    """The first bytes of each file, without reading on: what tells a disk image and its hash."""
    return listing.select("path").repartition(4 * listing.sparkSession.sparkContext.defaultParallelism).mapInArrow(_heads(root, length), "path string, head binary, error string")


ENTRY = "path string, entry string, size long, compressed long, crc32 string, modified string, error string"


def _directory(root: str):
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open_file(root, path) as source, zipfile.ZipFile(_Seekable(source)) as archive:
                        rows = [(path, i.filename, i.file_size, i.compress_size, f"{i.CRC:08X}", "{}-{:02}-{:02} {:02}:{:02}:{:02}".format(*i.date_time), None) for i in archive.infolist()]
                except (zipfile.BadZipFile, *FAULTS) as e:
                    rows = [(path, None, None, None, None, None, str(e))]
                for i in range(0, max(len(rows), 1), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 10_000]], _schema(ENTRY))

    return run


def zip_directory(archives: DataFrame, root: str) -> DataFrame:
    """The entries that zip archives (path) say they hold, from their directories alone: folders too; nothing is decompressed."""
    n = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("path").repartition(4 * n).mapInArrow(_directory(root), ENTRY)


# Fixed value: the modification time that this format gives to each entry.
STAMP = "1996-12-24 23:32:00"


def stamped(archives: DataFrame, directory: DataFrame) -> DataFrame:
    """path and whether all entries of the archive have the fixed time; true for an archive of none, null for an unreadable one."""
    per = directory.groupBy("path").agg(F.every(F.col("modified") == STAMP).alias("all"), F.max("error").isNotNull().alias("bad"))
    return archives.select("path").join(per, "path", "left").select("path", F.when(F.col("bad"), None).otherwise(F.coalesce("all", F.lit(True))).alias("stamped"))


def _segments(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column("segments").to_pylist():
                sha1, fault = hashlib.sha1(), None
                try:
                    for part in parts:
                        with open_file(root, part["path"]) as source:
                            read = 0
                            for block in _blocks(source, part["offset"], part["length"]):
                                sha1.update(block)
                                read += len(block)
                        if read < part["length"]:
                            raise OSError(f"{part['path']} ends early")
                except FAULTS as e:
                    fault = str(e)
                found.append((None if fault else sha1.hexdigest(), fault))
            keep = batch.drop_columns(["segments"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*keep.schema.names, "sha1", "error"])

    return run


def hash_segments(rows: DataFrame, root: str) -> DataFrame:
    """rows with the SHA-1 of their `segments` (path, offset, length), read one after the other, in place of these; error if one fails."""
    kept = [f for f in rows.schema.fields if f.name != "segments"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sha1 string, error string"
    return rows.mapInArrow(_segments(root), ddl)


WRITTEN = "path string, size long"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                store, full = _at(root, path)
                store.create_dir(full.rpartition("/")[0], recursive=True)
                part = f"{full}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content or b"")
                store.move(part, full)
                yield pa.RecordBatch.from_pylist([{"path": path, "size": len(content or b"")}], _schema(WRITTEN))

    return run


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each content (binary) at its path below root, and gives path and size of what was written.

    A file appears under its name when it is whole, so an attempt that is lost or repeated leaves no half of one.
    """
    return snapshot(files.select("path", "content").mapInArrow(_write(root), WRITTEN))
