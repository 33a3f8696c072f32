"""Contents in columns: hashes with and without a known header, disk images, and what to scan again.

Files of any size, those of no bytes included, are listed and read in blocks by `trees`; `read` gives small ones whole, up
to the limit of 2 GB of Spark's binary reader, which leaves out those of no bytes: `empty` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _starts(content: Column, at: int, magic: bytes) -> Column:
    return F.substr(content, F.lit(at + 1), F.lit(len(magic))) == F.lit(magic)


# Start and bytes of the magic, least size, and header size of the known formats; and headers of copiers by name.
HEADERS = ((0, b"NES\x1a", 16, 16), (0, b"FDS\x1a", 16, 16), (1, b"ATARI7800", 128, 128), (0, b"LYNX", 64, 64))
COPIERS, COPIER_HEADER = (".smc", ".swc", ".fig"), 512


def header_bytes(content: Column, size: Column, path: Column) -> Column:
    """How many bytes a known header takes at the start of a content; 0 for none."""
    found = F.when(F.lit(False), 0)
    for at, magic, least, header in HEADERS:
        found = found.when((size >= least) & _starts(content, at, magic), header)
    named = F.lower(path).rlike("(" + "|".join(e.replace(".", "\\.") for e in COPIERS) + ")$")
    return found.when((size % 1024 == COPIER_HEADER) & named, COPIER_HEADER).otherwise(0)


def bare_offset(start: bytes, size: int, path: str) -> int:
    """The same from the first bytes of a file that is read in blocks."""
    for at, magic, least, header in HEADERS:
        if size >= least and start[at : at + len(magic)] == magic:
            return header
    return COPIER_HEADER if size % 1024 == COPIER_HEADER and path.lower().endswith(COPIERS) else 0


def hashes(files: DataFrame) -> DataFrame:
    """path and content to size, sha1, md5, crc32, and sha1_no_header where a header and more than it was found."""
    size = F.octet_length("content").cast("long")
    skip = header_bytes(F.col("content"), size, F.col("path"))
    bare = F.upper(F.sha1(F.substr(F.col("content"), skip + 1, F.greatest(size - skip, F.lit(0)).cast("int"))))
    return files.select(
        "path", size.alias("size"), F.upper(F.sha1("content")).alias("sha1"), F.upper(F.md5("content")).alias("md5"),
        F.lpad(F.hex(F.crc32("content")), 8, "0").alias("crc32"), F.when((skip > 0) & (size > skip), bare).alias("sha1_no_header"),
    )


def archive_kind(path: Column) -> Column:
    """zip or 7z by the name's ending; null for others."""
    return F.nullif(F.lower(F.regexp_extract(path, "\\.(?i:(zip|7z))$", 1)), F.lit(""))


def disk_image_sha1(content: Column) -> Column:
    """The SHA-1 that a disk image (version 5) states in its first 124 bytes; null if it is not one."""
    # Magic, version and place of the hash.
    known = (F.octet_length(content) >= 124) & _starts(content, 0, b"MComprHD") & _starts(content, 12, b"\x00\x00\x00\x05")
    return F.when(known, F.hex(F.substr(content, F.lit(85), F.lit(20))))


def to_scan(listed: DataFrame, known: DataFrame, last_scanned: str | None) -> DataFrame:
    """Of the listed files (path, modificationTime) those that are new, or changed since the last scan; all without a last scan."""
    met = listed.join(known.select("path", F.lit(True).alias("_known")).distinct(), "path", "left")
    stamp = F.lit(last_scanned).cast("timestamp")
    changed = F.col("_known").isNull() | stamp.isNull() | F.col("modificationTime").isNull() | (F.col("modificationTime") > stamp)
    return met.where(changed).drop("_known")


def read(spark: SparkSession, folder: str, empty: list[str] = ()) -> DataFrame:
    """path and content of all files under folder; `empty` names its files of no bytes, which the reader leaves out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    none = spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary")
    return found.union(none) if empty else found
