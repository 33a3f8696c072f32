"""Best-fit packing of documents into sequences of bounded length, planned on the histogram of lengths.

Texts are encoded once into pieces of at most `capacity` ids; a longer document is cut from its end, so that only its
first piece may be shorter. The planner sees how many pieces have each length, not the pieces: best-fit decreasing
places whole runs of equal lengths into runs of bins with equal room. Pieces then take the planned slots by their rank
within their length. What the driver holds is bounded by `capacity`, whatever the input.

A null or empty text is the end id alone. Repeated rows are packed one by one. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Rows of a plan up to which it is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000

PIECE_TYPE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())]
)


def _cut(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = tokens.encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs, at = batch.column(0), 0
            for flat, sizes in own.encode(batch.column(1), end):
                raw = memoryview(flat.astype("<u4")).cast("B")
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = sizes - (pieces - 1) * capacity  # the first piece
                length = np.where(piece == 0, short[doc], capacity)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                first = (np.cumsum(sizes) - sizes)[doc] + start
                order = np.argsort(length, kind="stable")
                runs = length[order]
                new = np.flatnonzero(np.diff(runs, prepend=-1))
                nth = np.empty(len(doc), np.int64)
                nth[order] = seen[runs] + np.arange(len(runs)) - np.repeat(new, np.diff(np.append(new, len(runs))))
                seen += np.bincount(length, minlength=capacity + 1)
                rows = [bytes(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                yield common.batches(
                    {"doc_id": docs.take(pa.array(doc + at)), "piece": piece, "start": start, "length": length, "ids": rows, "part": np.full(len(doc), part), "nth": nth}, PIECE_TYPE
                )
                at += len(sizes)

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of pieces: doc_id, piece, start, length, ids (little-endian unsigned 32 bits), and part and nth, its place among the pieces of its length in its part."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = narrow.mapInArrow(_cut(vocabulary or tokens.vocabulary_path(), end, capacity), "doc_id long, piece int, start long, length long, ids binary, part int, nth long")
    return common.table(cut, "pieces")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, rank after the last, pieces for each bin, first bin, offset in the bin)."""
    rooms: list[int] = []  # of open bins, sorted
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first bin, bins)
    out, bins = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if (i := bisect_left(rooms, length)) < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    rooms.pop(i)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length
            placed = min(left, each * n)
            full, rest = divmod(placed, each)
            out.append((length, rank, rank + placed, each, first, capacity - room))
            leave(room - each * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            leave(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return out


def place(cut: DataFrame, capacity: int = 2048, carry: dict[str, Column] | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. carry: what to take along of a piece, by name; its ids unless given."""
    spark = cut.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("part", "length", before.alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity)
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, each long, bin long, at long")
    slots = F.broadcast(slots) if len(rows) <= BROADCAST_ROWS else slots
    ranked = cut.select("doc_id", "piece", "start", "length", "part", "nth", *[c.alias(n) for n, c in carry.items()]).join(by_part, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    met = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["lo"]) & (ranked["rank"] < slots["hi"]))
    nth = F.col("rank") - F.col("lo")
    return met.select(
        "doc_id", "piece", "start", ranked["length"], *carry, (F.col("bin") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("each") * ranked["length"]).cast("long").alias("offset")
    )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each piece of all documents: doc_id, piece, start, length, ids (or what carry names), sequence_id, offset."""
    return place(pieces(docs, vocabulary, capacity, end), capacity, carry)
