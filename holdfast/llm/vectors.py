"""Codes of vectors: each of a vector's equal consecutive parts is replaced by the number of the nearest codebook entry.

All distances are of integers, floor(scale * x), so results are exact and the same however rows are dealt. Nearest entries
are found by a VA file: every coordinate of the entries lies in one of 2**BITS cells, of about as many entries each; for a
vector, a table by coordinate and cell gives the least and the largest squared difference, and sums of these over an
entry's cells bound its distance from both sides. Entries whose lower bound is beyond the least upper bound are left out,
the others' distances are computed in full; of equal ones the first entry is taken.

Codebooks begin as the parts of the vectors of the least ids and move to the floor of the mean of what was nearest to them
in each round; a round is one pass of all tasks, whose sums by entry are added up in Spark. The driver holds codebooks
only: parts * entries * width numbers.

Vectors that are null or hold null or non-finite components are dropped. Vectors of equal ids are rows of their own, and
come into the first codebooks by id and then by components; null ids come last. Fewer vectors than entries make smaller
codebooks, no vectors none and no rows. Kept vectors of different lengths, lengths that the parts do not divide, and
components beyond 2**28 / scale are errors. Only named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 4, 256, 4, 1024, 4
#: Vectors that are compared at once.
BLOCK = 512
LARGEST = 1 << 28


def _matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their integers."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = np.isfinite(x)
    bad = np.concatenate([[0], np.cumsum(~good)])
    ends = np.cumsum(sizes)
    keep = valid & (bad[ends] == bad[ends - sizes])
    if len(set(sizes[keep].tolist())) > 1:
        raise ValueError("vectors of different lengths")
    out = np.floor(x[np.repeat(keep, sizes)] * scale)
    if np.abs(out).max(initial=0) > LARGEST:
        raise ValueError("components are too large for exact distances")
    return keep, out.astype(np.int64).reshape(int(keep.sum()), -1)


class Cells:
    """Entries of one part with each coordinate in a cell; `lo` and `hi` are the least and largest coordinate in each cell."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        n, width = entries.shape
        self.entries, cells = entries, min(n, 1 << bits)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = np.ascontiguousarray((rank * cells // n).T)
        ordered, first = np.sort(entries, axis=0), -(-np.arange(cells + 1) * n // cells)
        self.lo, self.hi = np.ascontiguousarray(ordered[first[:-1]].T), np.ascontiguousarray(ordered[first[1:] - 1].T)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest entry, and its squared distance."""
        found = [self._nearest(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)] or [(np.zeros(0, np.int64),) * 2]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def candidates(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and entries that the bounds leave, row by row in order of entries."""
        width = rows.shape[1]
        span = int(max(self.hi.max(), rows.max())) - int(min(self.lo.min(), rows.min()))
        kind = np.int32 if span * span * width < 1 << 31 else np.int64
        lower, upper = np.zeros((len(self.entries), len(rows)), kind), np.zeros((len(self.entries), len(rows)), kind)
        took = np.empty_like(lower)
        for d in range(width):
            x, lo, hi = rows[:, d].astype(kind), self.lo[d, :, None].astype(kind), self.hi[d, :, None].astype(kind)
            below, above = lo - x, x - hi
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(hi - x, x - lo)
            lower += np.take(near * near, self.cell[d], axis=0, out=took)
            upper += np.take(far * far, self.cell[d], axis=0, out=took)
        return np.nonzero((lower <= upper.min(axis=0)).T)

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, entry = self.candidates(rows)
        gap = rows[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(row, np.arange(len(rows)))
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[row])
        return entry[hits[np.searchsorted(row[hits], np.arange(len(rows)))]], best


def _nearest(books: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nearest entries (rows by parts) and the sums of their squared distances."""
    width = books[0].shape[1]
    if len(rows) and rows.shape[1] != width * len(books):
        raise ValueError("vectors of different lengths")
    found = [Cells(book).nearest(rows[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return np.stack([code for code, _ in found], 1), sum(distance for _, distance in found)


def _sums(books: list[np.ndarray], scale: int):
    """By part and entry, the number of vectors of a task that are nearest to it and the sums of their components."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [np.zeros(book.shape, np.int64) for book in books], np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            _, rows = _matrix(batch.column(0), scale)
            if not len(rows):
                continue
            codes, _ = _nearest(books, rows)
            for p in range(len(books)):
                n[p] += np.bincount(codes[:, p], minlength=len(n[p]))
                np.add.at(total[p], codes[:, p], rows[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        sums = np.stack(total)[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *(pa.array(sums[:, d]) for d in range(width))], ["part", "entry", "n", *(f"s{d}" for d in range(width))])

    return run


def _first(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the vectors of the least ids."""
    fine = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    own = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = own.orderBy(F.col("id").isNull(), "id", "vector").limit(entries).toArrow()  # at most as many as there are entries
    if not rows.num_rows:
        return []
    _, found = _matrix(rows.column("vector").combine_chunks(), scale)
    if found.shape[1] == 0 or found.shape[1] % parts:
        raise ValueError(f"{parts} equal parts of {found.shape[1]} components")
    return np.split(found, parts, axis=1)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebook of each part, entries by width; no codebooks if no vector is kept."""
    books = _first(vectors, id_col, vector_col, parts, entries, scale)
    for _ in range(rounds if books else 0):
        names = [f"s{d}" for d in range(books[0].shape[1])]
        sums = vectors.select(vector_col).mapInArrow(_sums(books, scale), "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow()  # a row for each entry
        at, n = found.column("part").to_numpy(), found.column("n").to_numpy()
        means = np.stack([found.column(c).to_numpy() for c in names], 1) // n[:, None]
        books = [book.copy() for book in books]
        for p, book in enumerate(books):
            book[found.column("entry").to_numpy()[at == p]] = means[at == p]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


CODED = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])


def encode(vectors: DataFrame, books: list[np.ndarray], vector_col: str = "embedding", to: str = "coded", scale: int = SCALE) -> DataFrame:
    """vectors with a column `to` (replaced if there): code, a byte for each part, and error, the squared distance; dropped rows go."""

    @F.arrow_udf(CODED)
    def coded(column: pa.Array) -> pa.Array:
        keep, rows = _matrix(column, scale)
        codes, errors = _nearest(books, rows)
        place = pa.array(np.where(keep, np.cumsum(keep) - 1, 0), mask=~keep)
        found = pa.StructArray.from_arrays([pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(errors, pa.int64())], CODED.names)
        return found.take(place)

    if not books:
        return vectors.withColumn(to, F.lit(None).cast(CODED)).where("false")
    if len(books[0]) > 256:
        raise ValueError("a code has a byte for each part")
    # Called so, it runs once: a deterministic function would run again in the filter, below the projection.
    return vectors.withColumn(to, coded.asNondeterministic()(vector_col)).where(F.col(to).isNotNull())


def decode(code: bytes, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middles of its entries' integers."""
    return np.concatenate([(book[c] + 0.5) / scale for c, book in zip(code, books)])


def label_errors(coded: DataFrame) -> DataFrame:
    """vec_id, code, error and label_error of rows vec_id, label, code, error: errors summed over equal labels, nulls being one."""
    rows = common.table(coded.select("vec_id", "label", "code", "error"), "codes")
    per = common.table(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "label-errors")
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return common.attach(rows, per, "label", "n", total).select("vec_id", "code", "error", "label_error")


def _oracle() -> str:
    """Distances as products of doubles, which are exact below 2**53; mean by mean, round by round."""
    steps = ["""k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024*cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
q as materialized (select vec_id, p, list_slice(v, cast(p*(len(v)//4)+1 as bigint), cast((p+1)*(len(v)//4) as bigint)) as v from k, range(4) r(p)),
b0 as materialized (select p, e, v from q join (select vec_id, row_number() over (order by vec_id)-1 as e from k qualify e<256) using (vec_id))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as materialized (select vec_id, p, min(row(list_inner_product(q.v,q.v)-2*list_inner_product(q.v,b.v)+list_inner_product(b.v,b.v), e)) as m from q join b{i} b using (p) group by vec_id, p)""")
        if i < ROUNDS:
            steps.append(f"""s{i} as (select p, m[2] as e, pos, floor(sum(v[pos])/count(*)) as c from a{i} join q using (vec_id, p), lateral (select unnest(range(1, len(v)+1)) as pos) group by all),
b{i + 1} as materialized (select b.p, b.e, coalesce(n.v, b.v) as v from b{i} b left join (select p, e, list(c order by pos) as v from s{i} group by p, e) n on n.p=b.p and n.e=b.e)""")
    steps.append(f"""f as (select vec_id, string_agg(lower(lpad(to_hex(m[2]),2,'0')), '' order by p) as code, cast(sum(m[1]) as bigint) as error from a{ROUNDS} group by vec_id)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(array_to_string(list_transform(v, lambda x: cast(cast(x as bigint) as varchar)),','), ',' order by p, e)) from b{ROUNDS}) as codebooks_sha256
from f join k using (vec_id)"""


ORACLE = _oracle()
