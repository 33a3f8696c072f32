"""Archives built by tasks: the repacks of a plan carried out, each in one stream of blocks, and what zip archives hold.

An archive is built by the task that its operation falls to: sources are opened one after the other, checked against the
SHA-1 that the plan states, and written as entries; the archive appears under its name when it is whole. Nothing is taken
away here. An operation that fails keeps its row, with the error; the others are carried out all the same.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import trees

# Time of every entry of the fixed format, and compression levels of the two formats.
FIXED_TIME, PLAIN_TIME = (1996, 12, 24, 23, 32, 0), (1980, 1, 1, 0, 0, 0)
LEVELS = {"torrentzip": 9, "zip": 6}
BUILT = "op_id long, dest string, entries long, size long, error string"
FAULTS = (*trees.FAULTS, zipfile.BadZipFile, zlib.error, KeyError, NotImplementedError, RuntimeError, EOFError)


def _stream(root: str, path: str, entry: str | None):
    """Blocks of a file, or of an entry of a zip archive."""
    with trees.open_file(root, path.lstrip("/")) as source:
        if entry is None:
            yield from trees._blocks(source)
            return
        with zipfile.ZipFile(trees._Seekable(source)) as archive, archive.open(entry) as inside:
            while block := inside.read(trees.BLOCK):
                yield block


def _build(root: str, op: dict) -> tuple[int, int]:
    """Writes one archive; how many entries and bytes it has."""
    plain: dict[str, dict] = {}
    for s in sorted(op["sources"], key=lambda s: (s["entry_name"] or "", s["path"], s["archive_path"] or "")):
        name = s["entry_name"] or (s["archive_path"] or s["path"]).rpartition("/")[2]
        if plain.setdefault(name, s)["sha1"] != s["sha1"]:
            raise OSError(f"two contents for the entry {name}")
    store, full = trees._at(root, op["dest"].lstrip("/"))
    store.create_dir(full.rpartition("/")[0], recursive=True)
    part = f"{full}.{uuid.uuid4().hex}.part"
    fixed = op["format"] == "torrentzip"
    names = sorted(plain, key=lambda n: (n.lower(), n))
    try:
        with store.open_output_stream(part, compression=None) as out, zipfile.ZipFile(io.BufferedWriter(_Raw(out), trees.BLOCK), "w", zipfile.ZIP_DEFLATED, compresslevel=LEVELS[op["format"]]) as archive:
            for name in names:
                s, sha1, info = plain[name], hashlib.sha1(), zipfile.ZipInfo(name, FIXED_TIME if fixed else PLAIN_TIME)
                info.compress_type = zipfile.ZIP_DEFLATED
                with archive.open(info, "w", force_zip64=False) as entry:
                    for block in _stream(root, s["path"], s["archive_path"]):
                        sha1.update(block)
                        entry.write(block)
                if sha1.hexdigest().upper() != s["sha1"].upper():
                    raise OSError(f"{s['path']} is not what the plan states")
        store.move(part, full)
    except BaseException:
        if store.get_file_info(part).is_file:
            store.delete_file(part)
        raise
    return len(names), store.get_file_info(full).size


class _Raw(io.RawIOBase):
    """An output stream that is written to from front to back, as one of Python's."""

    def __init__(self, out: pa.NativeFile):
        self._out = out

    def writable(self) -> bool:
        return True

    def write(self, block) -> int:
        self._out.write(bytes(block))
        return len(block)


def _builds(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for op in batch.to_pylist():
                try:
                    entries, size, error = *_build(root, op), None
                except FAULTS as e:
                    entries, size, error = None, None, str(e)
                yield pa.RecordBatch.from_pylist([{"op_id": op["op_id"], "dest": op["dest"], "entries": entries, "size": size, "error": error}], trees._schema(BUILT))

    return run


def build(operations: DataFrame, sources: DataFrame, root: str = "/") -> DataFrame:
    """Carries out the repacks of a plan as zip archives below root; op_id, dest, entries, size, error.

    Of several sources of one entry the first by path serves; a format other than zip and torrentzip is an error of its row.
    """
    own = operations.where("kind = 'repack'").select("op_id", "dest", "format", F.col("size").alias("bytes"))
    parts = sources.groupBy("op_id").agg(F.collect_list(F.struct("path", "archive_path", "sha1", "entry_name")).alias("sources"))
    met = own.join(parts, "op_id")
    good, other = met.where(F.col("format").isin(*LEVELS)), met.where(~F.coalesce(F.col("format").isin(*LEVELS), F.lit(False)))
    made = trees.dealt(good, "bytes").drop("bytes").mapInArrow(_builds(root), BUILT)
    none = F.lit(None).cast("long")
    told = other.select("op_id", "dest", none.alias("entries"), none.alias("size"), F.concat(F.lit("no writer for "), F.coalesce("format", F.lit("this"))).alias("error"))
    return trees.snapshot(made.unionByName(told))


HASHED = "path string, archive_path string, size long, sha1 string, md5 string, crc32 string, error string"


def _entries(root: str):
    names = [c.split(" ")[0] for c in HASHED.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        try:
            with trees.open_file(root, path) as source, zipfile.ZipFile(trees._Seekable(source)) as archive:
                for info in archive.infolist():
                    if info.is_dir():
                        continue
                    sha1, md5, crc, size = hashlib.sha1(), hashlib.md5(), 0, 0
                    with archive.open(info) as entry:
                        while block := entry.read(trees.BLOCK):
                            sha1.update(block)
                            md5.update(block)
                            crc, size = zlib.crc32(block, crc), size + len(block)
                    yield path, info.filename, size, sha1.hexdigest().upper(), md5.hexdigest().upper(), f"{crc:08X}", None
        except FAULTS as e:
            yield path, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held: list[dict] = []
                for row in rows(path):
                    held.append(dict(zip(names, row)))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, trees._schema(HASHED))
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, trees._schema(HASHED))

    return run


def entry_hashes(archives: DataFrame, root: str) -> DataFrame:
    """A row for each file in each zip archive (path, size), hashed in a stream; an archive that cannot be read to its end has a row with the error."""
    return trees.dealt(archives.select("path", "size"), "size").select("path").mapInArrow(_entries(root), HASHED)
