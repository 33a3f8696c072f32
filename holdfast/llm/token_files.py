"""Token ids on disk: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart.

Format. A folder holds two Parquet tables.
`ranks` (rank, id, count): ids by falling frequency over the whole corpus, ties by id; the most frequent has rank 0.
`blocks` (shard, block, start, doc_ids, n_tokens, control, data): shards follow each other in ascending document id,
and so do the blocks of a shard. `control` has two bits for each rank (its length less one, first rank in the lowest
bits), `data` its one to four little-endian bytes. `start` counts the ids of the shard before the block.

Null texts are empty: such a document has the end id alone. Rows with equal ids stay apart, next to each other; null
ids come first. Each text is encoded once. The vocabulary bounds what the driver gathers, and the number of shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Ids that a block holds at least, but for a shard's last one; a block never splits a document.
BLOCK = 1 << 18
#: Shards for each shuffle partition.
SHARDS = 3

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(values)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(code.max(initial=0)) + 1
    data = values.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup of the lengths that a control byte stands for."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    width = int(lengths.max(initial=1))
    out = np.zeros((n, 4), np.uint8)
    put = np.zeros((n, width), np.uint8)
    put[np.arange(width) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    out[:, :width] = put
    return out.view("<u4").ravel()


def _bounds(docs: DataFrame, id_col: str, shards: int) -> list[int]:
    """Ids at which a new shard begins, from approximate quantiles over all rows."""
    steps = [i / shards for i in range(1, shards)]
    got = docs.agg(F.percentile_approx(id_col, steps, 100 * shards)).first()[0] if steps else None
    return sorted(set(got or []))


def _encode(path: str, end: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path)
        for batch in batches:
            ids, at = batch.column(0), 0
            shard = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edges, ids.fill_null(0).to_numpy(), "right") + 1, 0)
            for flat, sizes in own.encode(batch.column(1), end):
                stop, small = at + len(sizes), flat.astype("<u2") if flat.max(initial=0) < 1 << 16 else flat.astype("<u4")
                rows = [x.tobytes() for x in np.split(small, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(shard[at:stop], pa.int32()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "shard", "n", "ids"])
                at = stop

    return run


def _values(row: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row, "<u2" if len(row) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for row, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist()):
            more = np.bincount(_values(row, n), minlength=len(total))
            more[: len(total)] += total
            total = more
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


BLOCK_TYPE = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)


def _blocks(rank: np.ndarray):
    """From rows in order of shard and document to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, docs, sizes, held = None, 0, 0, [], [], []

        def flush():
            control, data = pack(rank[np.concatenate(held)])
            return common.batches({"shard": [shard], "block": [block], "start": [start], "doc_ids": [docs], "n_tokens": [sizes], "control": [control], "data": [data]}, BLOCK_TYPE)

        for batch in batches:
            for to, doc, n, row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids"))):
                if docs and (to != shard or sum(sizes) >= BLOCK):
                    yield flush()
                    block, start = (block + 1, start + sum(sizes)) if to == shard else (0, 0)
                    docs, sizes, held = [], [], []
                shard = to
                docs.append(doc)
                sizes.append(n)
                held.append(_values(row, n))
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0, shards: int | None = None) -> None:
    """Write the ids of all texts to folder, each text followed by `end`, in ascending id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = _bounds(narrow, "doc_id", shards or SHARDS * parts)
    encoded = common.table(narrow.mapInArrow(_encode(vocabulary or tokens.vocabulary_path(), end, bounds), "doc_id long, shard int, n long, ids binary"), "ids")
    counts = encoded.select("n", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("count")).toPandas()
    counts = counts.sort_values(["count", "id"], ascending=[False, True], ignore_index=True)
    rank = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.uint32)
    rank[counts["id"].to_numpy(np.int64)] = np.arange(len(counts), dtype=np.uint32)
    spark.createDataFrame(counts.assign(rank=range(len(counts)))[["rank", "id", "count"]], "rank long, id long, count long").coalesce(1).write.parquet(f"{folder}/ranks")
    ordered = encoded.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "n", "ids")
    ordered.mapInArrow(_blocks(rank), "shard int, block long, start long, doc_ids array<long>, n_tokens array<long>, control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/blocks")


READ_TYPE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bits)."""
    ranks = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    id_of = ranks["id"].to_numpy(np.uint32)
    blocks = spark.read.parquet(f"{folder}/blocks")
    per_shard = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    base, before = {}, 0
    for shard, n in per_shard:
        base[shard] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                ids = id_of[unpack(row["control"], row["data"], int(sizes.sum()))].astype("<u4")
                starts = base[row["shard"]] + row["start"] + np.cumsum(sizes) - sizes
                yield common.batches({"doc_id": row["doc_ids"], "start": starts, "n_tokens": sizes, "ids": [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]}, READ_TYPE)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{common.shared_dir(spark)}/holdfast-token-files-{uuid.uuid4().hex}"


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
