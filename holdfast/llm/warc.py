"""Web archives in seekable Zstandard bundles: records in independent frames, a seek table at the end, an index by record.

A bundle is a file `archives/<random>.warc.zst`: frames of whole WARC 1.1 records, FRAME bytes of them or one longer
record, then a skippable frame with the sizes of all frames before it (the Zstandard seekable format). Any Zstandard
reader gives the plain WARC file; one that knows the footer reads a single frame. `index` (Parquet) maps the identifier of
each record to its bundle, its frame and the offset and length within the decompressed frame. A task writes bundles under
names of its own, and only index rows of committed tasks name them: what a lost executor left behind is never read.

Of records with equal payloads of at least `least` bytes, that of the largest id is the response, and all others refer to
it without a payload. Payloads are equal if two hashes (SHA-1 and a 64-bit one) are. Null payloads are empty. A null id
is no largest one: such a record revisits, unless all ids of its payload are null, which makes each a response. Rows of
one id are records of one identifier, each of its own; where the largest id of a payload occurs twice, both are responses.
Only the three named columns are read, so others cannot clash.

Payloads are shuffled once, to meet what is said of their group; a group of more than 1/10,000 of all rows is told to them
by broadcast instead.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of records after which a frame ends, and compressed bytes after which a bundle does.
FRAME, BUNDLE = 1 << 20, 1 << 28
#: Decompressed bytes that a task reads.
READ = 1 << 26
# Magic numbers of a skippable frame and of the seekable format's footer, and the profile of revisits.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type and refers_to of each row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    own = own.withColumn("key", F.when(F.col("payload_bytes") >= least, F.concat("payload_digest", F.hex(F.xxhash64("payload")))))
    groups = own.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept")).where("n > 1")
    met = common.attach(own, common.table(groups, "payloads"), "key", "n", pages.select(id_col).count())
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return met.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to")
    )


def serialised(found: DataFrame, date: str) -> DataFrame:
    """record_id and record: the bytes of each WARC record. A revisit keeps the head of its response, with the full length.

    Control characters and blanks of an address are written in percent notation.
    """
    revisit = F.col("record_type") == "revisit"
    uri = F.col("url")
    for code in (*range(0x21), 0x7F):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", uri)).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("refers_to"))), _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Truncated", F.lit("length")))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", length.cast("string")), F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n"))
    return found.select(_urn(F.col("page_id")).alias("record_id"), record.alias("record"))


INDEX = pa.schema(
    [("record_id", pa.string()), ("file", pa.string()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
)
INDEX_DDL = "record_id string, file string, frame_at long, frame_bytes long, frame_size long, offset long, length long"


class _Bundle:
    """A bundle that is being written."""

    def __init__(self, folder: str, level: int):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{path}/archives", recursive=True)
        self.out = store.open_output_stream(f"{path}/archives/{self.name}", compression=None)
        self.squeeze, self.frames, self.at = zstandard.ZstdCompressor(level=level), [], 0

    def add(self, ids: list[str], parts: list[bytes]) -> pa.RecordBatch:
        """Writes the records as one frame; their index rows."""
        sizes = np.array([len(p) for p in parts], np.int64)
        frame, size = self.squeeze.compress(b"".join(parts)), int(sizes.sum())
        self.out.write(frame)
        same = lambda v: [v] * len(ids)
        rows = {"record_id": ids, "file": same(self.name), "frame_at": same(self.at), "frame_bytes": same(len(frame)), "frame_size": same(size), "offset": np.cumsum(sizes) - sizes, "length": sizes}
        self.frames.append((len(frame), size))
        self.at += len(frame)
        return common.batches(rows, INDEX)

    def close(self) -> None:
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def _bundles(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, ids, parts, held = None, [], [], 0
        for batch in batches:
            for name, record in zip(batch.column(0).to_pylist(), batch.column(1)):
                if parts and held + len(record.as_buffer()) > frame_bytes:
                    bundle = bundle or _Bundle(folder, level)
                    yield bundle.add(ids, parts)
                    ids, parts, held = [], [], 0
                    if bundle.at >= bundle_bytes:
                        bundle = bundle.close()
                ids.append(name)
                parts.append(record.as_py())
                held += len(parts[-1])
        if parts:
            bundle = bundle or _Bundle(folder, level)
            yield bundle.add(ids, parts)
        if bundle:
            bundle.close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, level: int = 3) -> None:
    """Write a record for each row to folder, a path or address that driver and executors share."""
    rows = serialised(records(pages, id_col, url_col, payload_col, least), date)
    rows.mapInArrow(_bundles(folder, frame_bytes, bundle_bytes, level), INDEX_DDL).write.option("compression", "zstd").parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(f"{folder}/index")


def seek_table(source) -> list[tuple[int, int, int]]:
    """Place, compressed and decompressed bytes of each frame of an open bundle, from its footer."""
    end = source.size()
    n, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if flags & 0x80 else 8
    start = end - 9 - n * entry
    if struct.unpack("<II", source.read_at(8, start - 8)) != (SKIPPABLE, n * entry + 9):
        raise ValueError("the seek table does not fit its frame")
    sizes = np.frombuffer(source.read_at(n * entry, start), "<u4").reshape(n, entry // 4)[:, :2].astype(np.int64)
    return list(zip((np.cumsum(sizes[:, 0]) - sizes[:, 0]).tolist(), sizes[:, 0].tolist(), sizes[:, 1].tolist()))


def _open(folder: str, name: str):
    store, path = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{path}/archives/{name}")


def _frames(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _open(folder, name) as source:
                    rows = seek_table(source)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["file", "frame_at", "frame_bytes", "frame_size"])

    return run


RECORD = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
RECORD_DDL = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse(data: bytes, at: int, payloads: bool) -> tuple[tuple, int]:
    """The record that begins at `at`, and where the next one does. A payload is held against its length and digest."""
    stop = data.index(b"\r\n\r\n", at)
    head = _fields(data[at:stop])
    first = stop + 4
    end = first + int(head["content-length"])
    body = data.index(b"\r\n\r\n", first, end) + 4
    payload, size = data[body:end], int(_fields(data[first : body - 4])["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    whole = head["warc-type"] == "response"
    if data[end : end + 4] != b"\r\n\r\n" or whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {head['warc-record-id']} is damaged")
    row = (head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), digest, size, payload if whole and payloads else None)
    return row, end + 4


def _read_frames(folder: str, payloads: bool, chosen: bool):
    """Records of frames (file, frame_at, frame_bytes, frame_size), all or only those at the given offsets; one frame is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, place, data = None, None, None, b""
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source:
                        source.close()
                    name, source = row["file"], _open(folder, row["file"])
                if (name, row["frame_at"]) != place:
                    place = name, row["frame_at"]
                    data = expand.decompress(source.read_at(row["frame_bytes"], row["frame_at"]), max_output_size=row["frame_size"])
                out, at = [], row["offset"] if chosen else 0
                while at < len(data):
                    record, at = parse(data, at, payloads)
                    out.append(record)
                    if chosen:
                        break
                yield common.batches(dict(zip(RECORD.names, zip(*out))), RECORD)
        if source:
            source.close()

    return run


def _known(found: DataFrame) -> DataFrame:
    number = lambda c: F.nullif(F.regexp_extract(c, f"^<{URN}(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "record_type", "target_uri", number("refers_to").alias("refers_to"), "payload_digest", "payload_bytes", "payload")


def _dealt(frames: DataFrame, total: int, *order: str) -> DataFrame:
    """Frames by hash of their place, about READ decompressed bytes to a task. Their rows are small, so Spark is told how many tasks."""
    n = max(frames.sparkSession.sparkContext.defaultParallelism, -(-total // READ))
    return frames.repartition(n, "file", "frame_at").sortWithinPartitions("file", "frame_at", *order)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of all bundles: page_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload.

    Frames are listed from the footers and dealt to tasks; payloads of responses are checked, and given if asked for.
    """
    frames = index(spark, folder).select("file").distinct().mapInArrow(_frames(folder), "file string, frame_at long, frame_bytes long, frame_size long")
    total = index(spark, folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _known(_dealt(frames, total).mapInArrow(_read_frames(folder, payloads, False), RECORD_DDL))


def lookup(spark: SparkSession, folder: str, ids: DataFrame, id_col: str = "page_id", payloads: bool = True) -> DataFrame:
    """The records of the given ids, from their frames alone; each id's records once, however often it is asked for."""
    wanted = ids.select(_urn(F.col(id_col)).alias("record_id")).distinct()
    found = common.table(index(spark, folder).join(wanted, "record_id", "left_semi").select("file", "frame_at", "frame_bytes", "frame_size", "offset"), "frames")
    total = found.select("file", "frame_at", "frame_size").distinct().agg(F.coalesce(F.sum("frame_size"), F.lit(0))).first()[0]
    return _known(_dealt(found, total, "offset").mapInArrow(_read_frames(folder, payloads, True), RECORD_DDL))


def new_folder(spark: SparkSession) -> str:
    return f"{common.shared_dir(spark)}/holdfast-warc-{uuid.uuid4().hex}"


ORACLE = """with p as (select page_id, coalesce(html,'') as h from pages), d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
m as (select *, case when payload_bytes>=1000 then max(page_id) over (partition by payload_digest) end as kept from d)
select page_id, payload_bytes, payload_digest, case when kept is not null and page_id is distinct from kept then 'revisit' else 'response' end as record_type, case when kept is not null and page_id is distinct from kept then kept end as refers_to from m"""
