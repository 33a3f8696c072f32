"""Line dedup: an exact set-similarity join of lines by prefix, length and positional filters; later matches are removed.

A line's set is made of its distinct lower-cased (A-Z) words, as 64-bit hashes; lines of fewer than `least` distinct words
are never removed (1 unless given: only blank lines are left out). A line is removed if an earlier line, in order of (id,
line number), has a Jaccard similarity of `UP`/`DOWN` or more, whether that one is itself removed or not; so the result
depends on no order of work.

1. Word counts in `BUCKETS` hash buckets, over all text, give the order of rarity.
2. Each task finds the sets of its lines; a set it has met is a later match at once. The others meet by the sum of their
   words' mixed hashes, their parity sketch and their size (over 128 bits together), where all but the earliest of equal
   sets are later matches too, and go to a table with their prefixes alone: the words from rarest to most frequent, as
   many as similar sets must share one of.
3. Sets meet where they share a word of their prefixes. There, pairs pass the length filter, the positional filter and
   a parity sketch of 64 bits (128 for sets of over `LARGE` words), each of which only drops pairs that cannot be
   similar. A set offers its `FIRST` earliest partners; only one that has more, and is not removed by those, is met again
   and then offers all. So thousands of near copies cost a few pairs each, and no pair that could decide is left out.
4. Offered pairs are verified on the whole sets, which are made again from the bytes of those lines only; so the words of
   all lines are never written.

Words that many prefixes share are split into blocks, and pairs of blocks are met apart, so no word's sets need to fit in
one task. Places of words travel as packed columns, a row for each part of the words and stretch of a task, and the
number of parts follows the number of places, so a part has about `PART_ROWS` of them.

Documents are told apart by id and text, and known by numbers in the order of (id, hash of the text), null ids last; so
different texts of one id are compared and lose lines like any others, and of repeated rows the same lines go. Null texts
have one empty line. Other columns, whatever their names, pass through `dedup_lines` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

#: Similarity as a fraction, and the least size that a set of another size can be similar to: four words are, to five.
UP, DOWN = 4, 5
JOINED = 4
BUCKETS, PART = 1 << 21, 1 << 15
#: Bytes of words that a task gathers before it writes them.
HELD = 48 << 20
FIRST = 2
#: Sets that meet at a word at most before the word is split.
BLOCK = 10_000
BROADCAST_ROWS = 2_000_000
#: Places of words in a part, about, and those that a task packs at once.
PART_ROWS, PACKED = 250_000, 1_000_000
SALTS = 16
#: Rows of a group up to which all of its pairs are looked at together.
SQUARE = 192
#: Sets that are sorted at once, so that their numbers fit in 18 bits.
STRETCH = 1 << 18
#: Words of a set up to which 64 bits of its sketch tell it from others well enough.
LARGE = 48
CODEC = pa.Codec("zstd", compression_level=1)


def _packed(values: np.ndarray) -> bytes:
    """Values with their first bytes together, then their second ones, and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return CODEC.compress(np.ascontiguousarray(planes), asbytes=True)


def _plain(blob: bytes, kind, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(CODEC.decompress(blob, n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(total), PART):
        if total[i : i + PART].any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(total[i : i + PART])])], ["at", "n"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for batch in batches:
        for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
            total[at] = total.get(at, 0) + _plain(n, np.int64, PART)
    for at, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_packed(n)])], ["at", "n"])


def _table(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' bucket counts, summed in two steps; BUCKETS bounds what the driver gets."""
    some = parts.withColumn("salt", F.spark_partition_id() % SALTS).repartition("at", "salt").mapInArrow(_add, "at int, n binary")
    total = np.zeros(BUCKETS, np.int64)
    for at, n in some.repartition("at").mapInArrow(_add, "at int, n binary").collect():
        total[at : at + PART] = _plain(n, np.int64, PART)
    return total


class _Buckets:
    """Counts by bucket, added to in large steps."""

    def __init__(self):
        self.total, self.held, self.n = np.zeros(BUCKETS, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append((values & np.uint64(BUCKETS - 1)).astype(np.int32))
        self.n += len(values)
        if self.n >= BUCKETS:
            self.total += np.bincount(np.concatenate(self.held), minlength=BUCKETS)
            self.held, self.n = [], 0

    def parts(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=BUCKETS)
        yield from _parts(self.total)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Buckets()
    for batch in batches:
        for _, h, _ in wordhash.words(batch.column(0), lower=True):
            total.add(h)
    yield from total.parts()


def line_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lines of all texts begin (and the end of the last), each line's text, and its number there."""
    breaks = np.flatnonzero(data == 10) + 1
    kind = np.concatenate([np.zeros(len(breaks), np.int8), np.ones(len(offsets) - 1, np.int8)])
    at = np.concatenate([breaks, offsets[:-1]])
    order = np.lexsort((kind, at))  # a line that begins where the next text does belongs to the text before
    text = np.cumsum(kind[order]) - 1
    first = np.flatnonzero(kind[order])
    return np.append(at[order], len(data)), text, np.arange(len(order)) - first[text]


def _ragged(flat: np.ndarray, size: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The stretches of flat that keep names, in that order."""
    start = (np.cumsum(size) - size)[keep]
    n = size[keep]
    return flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _written(flat: np.ndarray, size: np.ndarray, width: int) -> pa.Array:
    """The last `width` bytes of each value, set by set."""
    data = np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :])
    ends = np.concatenate([[0], np.cumsum(size)]) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def _read(words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if len(words) and offsets[-1] > offsets[0] else np.zeros((0, width), np.uint8)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :width] = data
    return out.view("<u8").ravel(), np.diff(offsets) // width


def _distinct(h: np.ndarray, n: np.ndarray, order_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For stretches of sets that hold n hashes each: the first set's number, the distinct words from rarest to most frequent, the sets' sizes."""
    ends = np.append(0, np.cumsum(n))
    for i in range(0, len(n), STRETCH):
        m = n[i : i + STRETCH]
        own = h[ends[i] : ends[i + len(m)]]
        if not len(own):
            continue
        key = np.repeat(np.arange(len(m), dtype=np.uint64), m) << np.uint64(46) | order_of[own & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(40) | own >> np.uint64(24)
        rank = np.argsort(key)
        key, word = key[rank], own[rank]
        same, new = key[1:] == key[:-1], np.append(True, word[1:] != word[:-1])
        if (same & new[1:]).any():  # two words of a set that differ in their last bits alone
            rank = np.lexsort((own, np.repeat(np.arange(len(m)), m) << 46 | order_of[own & np.uint64(BUCKETS - 1)].astype(np.int64) << 40 | (own >> np.uint64(24)).astype(np.int64)))
            key = key[np.argsort(key, kind="stable")]
            word = own[rank]
            new = np.append(True, word[1:] != word[:-1])
            same = key[1:] == key[:-1]
        new[1:] |= ~same
        key, word = key[new], word[new]
        yield i, word, np.bincount((key >> np.uint64(46)).astype(np.int64), minlength=len(m))


def _line_sets(batch: pa.RecordBatch, order_of: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunk by chunk: the words of all sets from rarest to most frequent, the sets' sizes, documents and line numbers."""
    docs = batch.column(0).to_numpy()
    data, offsets = wordhash.buffers(batch.column(1))
    for i, j in wordhash.chunks(offsets):
        own = data[offsets[i] : offsets[j]]
        edges, text, number = line_edges(own, offsets[i : j + 1] - offsets[i])
        h, n = wordhash.hashes(own, edges, True)
        if not len(h):
            continue
        for at, flat, size in _distinct(h, n, order_of):
            keep = np.flatnonzero(size >= least)
            if len(keep):
                yield _ragged(flat, size, keep), size[keep], docs[i + text[at + keep]], number[at + keep]


def set_ids(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Ids in the order of (document's number, line); numbers and lines have fewer than 32 bits, so no two meet."""
    return doc << 31 | line


SETS = "key long, id long, size long, sketch long, more long, head binary"


def _sketches(flat: np.ndarray, begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parities of the words by the last six bits, and for large sets those of the words whose seventh bit is set."""
    bit = np.uint64(1) << (flat & np.uint64(63))
    more = np.bitwise_xor.reduceat(np.where(flat & np.uint64(64), bit, np.uint64(0)), begins)
    return np.bitwise_xor.reduceat(bit, begins), np.where(size > LARGE, more, np.uint64(0))


def _sets(rarity, least: int):
    """Sets with their prefixes as `head`, which is null for later matches; equal sets have one key, sketch and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0

        def rows(at, sign, doc, line, size, sketch, more, head):
            ids = set_ids(doc[at], line[at])
            columns = [pa.array(sign[at].view(np.int64)), pa.array(ids), pa.array(size[at]), pa.array(sketch[at].view(np.int64)), pa.array(more[at].view(np.int64)), head]
            return pa.RecordBatch.from_arrays(columns, ["key", "id", "size", "sketch", "more", "head"])

        def flush():
            flat, p, *rest = (np.concatenate(x) for x in zip(*held))
            sign, doc, line, size, sketch, _ = rest
            rank = np.lexsort((line, doc, size, sketch, sign))
            new = np.ones(len(rank), bool)
            new[1:] = (np.diff(sign[rank]) != 0) | (np.diff(sketch[rank]) != 0) | (np.diff(size[rank]) != 0)
            earliest = rank[new][np.cumsum(new) - 1]
            later = rank[(doc[rank] != doc[earliest]) | (line[rank] != line[earliest])]  # a repeated row's line is the same line
            first = np.sort(rank[new])
            for i in range(0, len(first), 1 << 14):
                some = first[i : i + (1 << 14)]
                yield rows(some, *rest, _written(_ragged(flat, p, some), p[some], 5))
            if len(later):
                own = wordhash.mix(set_ids(doc, line).view(np.uint64))  # so later matches of one line are not dealt to one task
                yield rows(later, own, *rest[1:], pa.nulls(len(later), pa.binary()))

        for batch in batches:
            for flat, size, doc, line in _line_sets(batch, rarity.value, least):
                begins = np.cumsum(size) - size
                sign = np.add.reduceat(wordhash.mix(flat), begins)
                p = prefix(size)
                head = flat[np.repeat(begins - np.cumsum(p) + p, p) + np.arange(int(p.sum()))]
                held.append((head, p, sign, doc, line, size, *_sketches(flat, begins, size)))
                bytes_held += sum(x.nbytes for x in held[-1])
                if bytes_held >= HELD:
                    yield from flush()
                    held, bytes_held = [], 0
        if held:
            yield from flush()

    return run


def _mark_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in order of key, sketch, size and id; of equal ones, all but those of the least id lose their heads."""
    before, least = None, None
    for batch in batches:
        key, ids = [batch.column(c).to_numpy() for c in ("key", "sketch", "size")], batch.column("id").to_numpy()
        if not len(ids):
            continue
        new = np.ones(len(ids), bool)
        new[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in key])
        now = [c[0] for c in key]
        new[0] = before is None or now != before
        earliest = np.append(ids[:1] if new[0] else least, ids[np.flatnonzero(new[1:]) + 1])[np.cumsum(new) - new[0]]
        before, least = [c[-1] for c in key], earliest[-1:]
        later = pa.array(ids != earliest)
        head = pc.if_else(later, pa.scalar(None, batch.schema.field("head").type), batch.column("head"))
        yield batch.set_column(batch.schema.get_field_index("head"), "head", head)


def _whole_sets(flags):
    """The sets of flagged lines, with all their words; only the bytes of those lines are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            data, offsets = wordhash.buffers(batch.column(1))
            for i, j in wordhash.chunks(offsets):
                own = data[offsets[i] : offsets[j]]
                edges, text, number = line_edges(own, offsets[i : j + 1] - offsets[i])
                ids = set_ids(docs[i + text], number)
                some = np.flatnonzero(flags.value[_bucket(ids)])
                if not len(some):
                    continue
                length = np.diff(edges)
                h, n = wordhash.hashes(_ragged(own, length, some), np.append(0, np.cumsum(length[some])), True)
                which = np.repeat(np.arange(len(some)), n)
                rank = np.lexsort((h, which))
                h, which = h[rank], which[rank]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
                size = np.bincount(which[new], minlength=len(some))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), _written(h[new], size, 8)], ["id", "words"])

    return run


def prefix(n: np.ndarray) -> np.ndarray:
    """Words of a prefix; none for sets that only equal sets are similar to."""
    return np.where(n < JOINED, 0, n - -(-UP * n // DOWN) + 1)


def _bucket(ids: np.ndarray) -> np.ndarray:
    return wordhash.mix(ids.view(np.uint64)) & np.uint64(BUCKETS - 1)


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Buckets()
    for batch in batches:
        total.add(_bucket(batch.column(0).to_numpy()))
    yield from total.parts()


def _flags(ids: DataFrame):
    """Buckets of the ids: a superset of them, of fixed size. What it lets through in excess is sorted out later."""
    return ids.sparkSession.sparkContext.broadcast(_table(ids.select("id").mapInArrow(_id_counts, "at int, n binary")) > 0)


def _prefix_words(heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all prefixes, their sets and their places there."""
    flat, p = _read(heads, 5)
    row = np.repeat(np.arange(len(p)), p)
    return flat, row, np.arange(len(row)) - np.repeat(np.cumsum(p) - p, p)


def _prefix_counts(asked):
    """How many prefixes have a word, by bucket; of the asked sets, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Buckets()
        for batch in batches:
            if asked is not None:
                batch = batch.filter(pa.array(asked.value[_bucket(batch.column(0).to_numpy())]))
            total.add(_prefix_words(batch.column(1))[0])
        yield from total.parts()

    return run


PLACES = (("word", np.uint64), ("id", np.int64), ("sketch", np.uint64), ("more", np.uint64), ("size", np.int32), ("place", np.int32), ("pair", np.int32), ("own", np.int32), ("probe", np.bool_))


def _places(blocks, parts: int, asked=None, words=None):
    """Packed places of the words of all prefixes, once for each pair of blocks that the set is in there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush():
            rows = {c: np.concatenate([h[c] for h in held]) for c, _ in PLACES}
            part = (wordhash.mix(rows["word"] + rows["pair"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
            order = np.argsort(part << np.uint64(40) | rows["word"])
            part = part[order].astype(np.int64)
            rows = {c: v[order] for c, v in rows.items()}
            new = np.flatnonzero(np.diff(part, prepend=-1))
            stop = np.append(new[1:], len(part))
            packed = {c: pa.array([_packed(rows[c][i:j].astype(t)) for i, j in zip(new, stop)], pa.binary()) for c, t in PLACES}
            return pa.RecordBatch.from_arrays([pa.array(part[new], pa.int32()), pa.array(stop - new), *packed.values()], ["part", "n", *packed])

        for batch in batches:
            ids, size, sketch, more_bits = (batch.column(c).to_numpy() for c in ("id", "size", "sketch", "more"))
            word, row, place = _prefix_words(batch.column("head"))
            if words is not None:
                some = np.flatnonzero(words.value[word & np.uint64(BUCKETS - 1)])
                word, row, place = word[some], row[some], place[some]
            n = blocks.value[word & np.uint64(BUCKETS - 1)].astype(np.int64)
            own = np.zeros(len(row), np.int64)
            if n.max(initial=1) > 1:
                own = (wordhash.mix(ids[row].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
                more = np.repeat(np.arange(len(row)), n)
                other = np.arange(len(more)) - np.repeat(np.cumsum(n) - n, n)
                pair = np.minimum(own[more], other) << 15 | np.maximum(own[more], other)
                word, row, place, own = word[more], row[more], place[more], own[more]
            else:
                pair = own
            probe = np.zeros(len(row), bool) if asked is None else asked.value[_bucket(ids[row])]
            values = (word, ids[row], sketch[row], more_bits[row], size[row], place, pair, own, probe)
            held.append({c: v.astype(t, copy=False) for (c, t), v in zip(PLACES, values)})
            n_held += len(row)
            if n_held >= PACKED:
                yield flush()
                held, n_held = [], 0
        if n_held:
            yield flush()

    return run


def _prepared(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """rows with `need` and `left`: a pair has words enough after the shared one if each one's left is the other's need or more.

    Two sets of x and y words are similar if they share 4/9 (x + y); at places i and j of their first shared word, x - i and
    y - j words can be shared, so 5x - 9i >= 4y and 5y - 9j >= 4x, which has the length filter in it.
    """
    size = rows["size"].astype(np.int32)
    return rows | {"left": DOWN * size - (UP + DOWN) * rows["place"].astype(np.int32), "need": UP * size}


def _alike(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) have sketches that similar sets can have, and are of different blocks if a pair of blocks meets."""
    x, y = rows["size"][a], rows["size"][b]
    apart = x + y
    apart -= 2 * -(-UP * apart // (UP + DOWN))
    fold = rows["sketch"][a] ^ rows["sketch"][b]
    keep = np.bitwise_count(fold) <= apart
    large = np.flatnonzero(keep & (np.minimum(x, y) > LARGE))
    half = rows["more"][a[large]] ^ rows["more"][b[large]]
    keep[large] = np.bitwise_count(half) + np.bitwise_count(fold[large] ^ half) <= apart[large]
    keep = np.flatnonzero(keep)
    a, b = a[keep], b[keep]
    pair = rows["pair"][a]
    return keep[(((pair >> 15) == (pair & 32767)) | (rows["own"][a] != rows["own"][b])) & (rows["id"][a] != rows["id"][b])]


def _few(rows: dict[str, np.ndarray], start: np.ndarray, n: np.ndarray, first: int | None):
    """Pairs of groups of few rows, those of one size at once; like _many for each."""
    for k in np.unique(n):
        at = start[n == k]
        before, step = np.tri(k, k, -1, bool), max(1, (1 << 20) // int(k * k))
        for s in range(0, len(at), step):
            base = at[s : s + step]
            own = base[:, None] + np.arange(k)
            left, need = rows["left"][own], rows["need"][own]
            fit = left[:, :, None] >= need[:, None, :]
            fit &= need[:, :, None] <= left[:, None, :]
            fit &= before
            group, i, j = np.unravel_index(np.flatnonzero(fit), fit.shape)
            a, b = base[group] + i, base[group] + j
            if first is None:
                some = rows["probe"][a]
                a, b = a[some], b[some]
            keep = _alike(rows, a, b)
            a, b = a[keep], b[keep]
            more = np.zeros(len(a), bool)
            if first is not None and len(a):
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                more = np.isin(a, a[nth >= first])
                a, b, more = a[nth < first], b[nth < first], more[nth < first]
            yield a, b, more


def _many(rows: dict[str, np.ndarray], start: int, n: int, first: int | None):
    """Pairs of one large group, block by block; with first, only so many of the earliest for each row, and whether there are more."""
    left, need = rows["left"], rows["need"]
    for i in range(1, n, 256):
        at = start + np.arange(i, min(i + 256, n))
        if first is None:
            at = at[rows["probe"][at]]
        given, extra, got = np.zeros(len(at), np.int64), np.zeros(len(at), bool), []
        for j in range(start, int(at[-1]) if len(at) else start, 1024):
            open_rows, other = np.flatnonzero(~extra), np.arange(j, min(j + 1024, int(at[-1])))
            own = at[open_rows, None]
            fit = (left[own] >= need[other]) & (left[other] >= need[own])
            if len(other) and other[-1] >= own[0, 0]:
                fit &= other < own
            a, b = np.nonzero(fit)
            a, b = open_rows[a], other[b]
            keep = _alike(rows, at[a], b)
            a, b = a[keep], b[keep]
            if first is not None and len(a):
                nth = np.arange(len(a)) - np.searchsorted(a, a) + given[a]
                extra[a[nth >= first]] = True
                a, b = a[nth < first], b[nth < first]
                given += np.bincount(a, minlength=len(given))
            got.append((a, b))
            if extra.all():
                break
        if got:
            a, b = (np.concatenate(v) for v in zip(*got))
            yield at[a], b, extra[a]


def _meet(first: int | None, square: int):
    """Candidate pairs (id, other), other the earlier, of the packed places of each part."""

    def part(blobs, sizes):
        rows = {c: np.concatenate([_plain(blob[i], t, n) for blob, n in zip(blobs, sizes)]) for i, (c, t) in enumerate(PLACES)}
        order = np.lexsort((rows["id"], rows["pair"], rows["word"]))
        rows = _prepared({c: v[order] for c, v in rows.items()})
        new = np.flatnonzero((np.diff(rows["word"], prepend=rows["word"][0] + np.uint64(1)) != 0) | (np.diff(rows["pair"], prepend=-1) != 0))
        n = np.diff(np.append(new, len(order)))
        few = (n > 1) & (n <= square)
        found = list(_few(rows, new[few], n[few], first))
        for start, size in zip(new[n > square].tolist(), n[n > square].tolist()):
            found += _many(rows, start, size, first)
        if not found:
            return None
        a, b, more = (np.concatenate(v) for v in zip(*found))
        pairs = np.stack([rows["id"][a], rows["id"][b]], 1)
        order = np.lexsort((~more, pairs[:, 1], pairs[:, 0]))
        pairs, more = pairs[order], more[order]
        new = np.flatnonzero((np.diff(pairs, axis=0, prepend=pairs[:1] + 1) != 0).any(1)) if len(pairs) else []
        return pa.RecordBatch.from_arrays([pa.array(pairs[new, 0]), pa.array(pairs[new, 1]), pa.array(more[new])], ["id", "other", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, sizes = None, [], []
        for batch in batches:
            for number, n, *blob in zip(*(batch.column(c).to_pylist() for c in ("part", "n", *dict(PLACES)))):
                if number != now and blobs:
                    if (out := part(blobs, sizes)) is not None:
                        yield out
                    blobs, sizes = [], []
                now = number
                blobs.append(blob)
                sizes.append(n)
        if blobs and (out := part(blobs, sizes)) is not None:
            yield out

    return run


OFFERS = "id long, other long, more boolean"


def offers(sets: DataFrame, blocks, n_places: int, first: int | None, asked=None, words=None) -> DataFrame:
    """Distinct candidate pairs, with more if the id has others that were not offered."""
    least = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-n_places // PART_ROWS))
    schema = ", ".join(["part int", "n long", *(f"{c} binary" for c, _ in PLACES)])
    packed = sets.select("id", "size", "sketch", "more", "head").mapInArrow(_places(blocks, 4 * parts, asked, words), schema)
    met = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet(first, SQUARE), OFFERS)
    return common.table(met.groupBy("id", "other").agg(F.max("more").alias("more")), "offers")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, n = _read(batch.column("words"), 8)
        b, m = _read(batch.column("other_words"), 8)
        word = np.concatenate([a, b])
        pair = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
        rank = np.lexsort((word, pair))
        word, pair = word[rank], pair[rank]
        both = np.bincount(pair[1:][(word[1:] == word[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
        yield batch.filter(pa.array(DOWN * both >= UP * (n + m - both))).select(["id", "other"])


def similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are similar; id is the later set."""
    needed = common.cut(pairs.select("id").union(pairs.select("other")).distinct())
    own = rows.mapInArrow(_whole_sets(_flags(needed)), "id long, words binary")
    if needed.count() <= BROADCAST_ROWS:
        own = own.join(F.broadcast(needed), "id", "left_semi")
    own = common.table(own.dropDuplicates(["id"]), "offered")
    other = own.select(F.col("id").alias("other"), F.col("words").alias("other_words"))
    met = pairs.select("id", "other").join(own, "id").join(other, "other")
    return met.select("id", "other", "words", "other_words").mapInArrow(_verify, "id long, other long")


def _removed_ids(rows: DataFrame, least: int) -> DataFrame:
    """The ids of later matches among the lines of rows (number, text)."""
    shared = rows.sparkSession.sparkContext.broadcast
    counts = _table(rows.select("text").mapInArrow(_count, "at int, n binary"))
    rarity = shared(np.minimum(4 * np.log2(np.maximum(counts, 1)), 63).astype(np.uint8))
    made = rows.mapInArrow(_sets(rarity, least), SETS).repartition("key").sortWithinPartitions("key", "sketch", "size", "id")
    every = common.table(made.mapInArrow(_mark_later, SETS).drop("key"), "sets")
    sets = every.where(F.col("head").isNotNull() & (F.col("size") >= JOINED))  # those that sets of other words can be similar to
    at_prefix = _table(sets.select("id", "head").mapInArrow(_prefix_counts(None), "at int, n binary"))
    per_word = np.maximum(1, -(-at_prefix // BLOCK))
    blocks = shared(per_word.astype(np.int32))
    offered = offers(sets, blocks, int((at_prefix * per_word).sum()), FIRST)
    gone = common.cut(similar(offered, rows).select("id").distinct())
    left = common.cut(offered.where("more").select("id").distinct().join(gone, "id", "left_anti"))
    if left.count():
        asked = _flags(left)
        words = _table(sets.select("id", "head").mapInArrow(_prefix_counts(asked), "at int, n binary")) > 0
        more = offers(sets, blocks, int((at_prefix * per_word)[words].sum()), None, asked, shared(words))
        gone = gone.union(similar(more, rows).select("id"))
    return every.where("head is null").select("id").union(gone).distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """doc_id, text_hash and line (from 0) of every line that goes; lines of fewer than `least` distinct words stay."""
    rows, keys, _ = common.numbered(docs, doc_id, text)
    gone = _removed_ids(rows, least).select(F.shiftright("id", 31).alias("number"), F.expr("id & 2147483647L").alias("line"))
    return gone.join(keys, "number").select("doc_id", "text_hash", "line")


def _with_removed(rows: DataFrame, docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """rows, which have doc_id and text_hash, with `removed`: the sorted numbers of their lines that go."""
    gone = removed_lines(docs, doc_id, text, least).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    met = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]) & rows["text_hash"].eqNullSafe(gone["text_hash"]), "left")
    return met.select(*[rows[c] for c in rows.columns], F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """A row for each document: doc_id, n_lines, removed (sorted line numbers)."""
    own = F.coalesce(F.col(text), F.lit(""))
    n_lines = F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), n_lines.cast("long").alias("n_lines"))
    return _with_removed(rows, docs, doc_id, text, least).select("doc_id", "n_lines", "removed")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """docs without the removed lines; a text that loses all of them becomes empty. Columns stay as they are."""
    lines = F.split(F.col(text), "\n")
    others = [c for c in docs.columns if c != text]
    packed = [F.struct(*others).alias("row")] if others else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), lines.alias("lines"), *packed)
    met = _with_removed(rows, docs, doc_id, text, least)
    # lines is a column of the join's output, so the lambda reads it and does not split the text anew
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1), "removed")
    out = F.when(F.size("removed") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i.cast("int"))), "\n"))
    return met.select(*[out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
