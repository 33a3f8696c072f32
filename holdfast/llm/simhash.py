"""Near-duplicate documents by 64-bit SimHash: all pairs of distinct fingerprints, compared exactly in tiles.

A fingerprint is made from the XXH64 values of a text's word shingles; fingerprints that differ in `radius` bits or
fewer are linked, and linked documents form a component. Equal fingerprints are one node. Nodes are dealt into tiles by
their number of set bits; a pair of tiles whose counts differ by more than the radius holds no link and is never made.
Each other pair of tiles is one row, compared in blocks with exclusive-or and bit counts; inside, blocks are skipped by
the counts of their four quarter words. A tile pair gives no list of links but a forest: an edge at most for each node,
so a group of thousands of near copies costs no more than its size. The work is quadratic in distinct fingerprints by
the method's nature, in even pieces, and moves each tile to its partners only.

Null and empty texts, and texts of blanks alone, have fingerprint zero, linked like any other. A null id never becomes a
component's id unless it has no other; ties go to the least id. Repeated rows get a row each. Only the id and text columns
are read, so others may have any name.

`keep_one` removes near copies of a Jaccard similarity of `SIMILAR` or more over five-word shingles. 64 bits and a radius
of 4 are far too narrow for that, so it compares fingerprints of `WIDE` bits in the same way within `WIDE_RADIUS` bits (two
texts of similarity 0.8 differ in 19 bits on average, with a standard deviation of 4: 98 % of them lie within 28, and nearly
all of those above 0.85), and then tests the exact similarity of the pairs found. Tiles hold texts of like numbers of
shingles, so tiles of sizes that cannot be similar never meet. In each pair of tiles a text offers its `FIRST` nearest
partners; only texts that have more are compared again, and then with all of other components. So thousands of near
copies cost a few pairs each, and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .components import stars

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Fingerprints in a tile, about, and in a block.
TILE, BLOCK = 1 << 15, 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = start[shingle - 1 :] + size[shingle - 1 :]
    n, total, step = len(stop), np.zeros(64, np.int64), 1 << 15
    start, stop = start.tolist(), stop.tolist()
    for i in range(0, n, step):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(start[i : i + step], stop[i : i + step])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<u8")[0])


PRINT_TYPE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], schema=PRINT_TYPE)

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, to tell rows with one id apart) and fp, the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return common.cut(rows.mapInArrow(_fingerprints(shingle), "doc_id long, text_hash long, fp long"))


class Forest:
    """Labels of n nodes, merged by arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int16)


def _ordered(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints by the counts of their quarters, and each block's least and greatest counts."""
    q = quarters(prints)
    order = np.lexsort((q[:, 2], q[:, 1], q[:, 0]))
    edges = np.arange(0, len(prints), BLOCK)
    return prints[order], np.minimum.reduceat(q[order], edges), np.maximum.reduceat(q[order], edges)


def forest_of(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join what the links of left and right, or of left alone, join."""
    a, low_a, high_a = _ordered(left)
    b, low_b, high_b = (a, low_a, high_a) if right is None else _ordered(right)
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate([a, b])
    forest = Forest(len(nodes))
    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(1)
        x = a[i * BLOCK : (i + 1) * BLOCK, None]
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            near = np.bitwise_count(x ^ b[None, j * BLOCK : (j + 1) * BLOCK]) <= radius
            if near.any():
                m, n = np.nonzero(near)
                forest.link(m + i * BLOCK, n + j * BLOCK + shift)
    at = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[at], nodes[forest.label[at]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (np.array(batch.column(c)[k].values.to_numpy(), np.int64).view("<u8") for c in (0, 1))
                u, v = forest_of(left, None if batch.column(2)[k].as_py() else right, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """For distinct fingerprints (fp): edges (a, b) whose components are those of all links."""
    counted = prints.select("fp", F.bit_count("fp").alias("p"))
    chunks = {r["p"]: -(-r["n"] // tile) for r in counted.groupBy("p").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not chunks:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    n_chunks = F.create_map(*[F.lit(x) for pair in sorted(chunks.items()) for x in pair])
    tiles = counted.withColumn("c", F.pmod(F.xxhash64("fp"), n_chunks[F.col("p")]).cast("int")).groupBy("p", "c").agg(F.collect_list("fp").alias("fps"))
    tiles = common.cut(tiles)
    mine = tiles.select("p", "c", F.col("fps").alias("left"), F.explode(F.sequence(F.col("p"), F.col("p") + radius)).alias("p2"))
    mine = mine.withColumn("last", F.try_element_at(n_chunks, F.col("p2"))).where("last is not null")
    mine = mine.select("p", "c", "left", "p2", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("c2")).where("p2 > p or c2 >= c")
    met = mine.join(tiles.select(F.col("p").alias("p2"), F.col("c").alias("c2"), F.col("fps").alias("right")), ["p2", "c2"])
    return met.select("left", "right", ((F.col("p") == F.col("p2")) & (F.col("c") == F.col("c2"))).alias("same")).mapInArrow(_compare(radius), "a long, b long")


def components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """For rows with doc_id and fp: each distinct fp with root (the least fp of its component) and component_id (the least doc_id)."""
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = stars(links(by_print.select("fp"), radius, tile))
    rooted = by_print.join(edges, by_print["fp"] == edges["a"], "left").select("fp", F.coalesce("b", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: doc_id, text_hash, fp, root, component_id."""
    prints = fingerprints(docs, doc_id, text, shingle)
    return prints.join(components(prints, radius), "fp")


WIDE, WIDE_RADIUS, WIDE_SHINGLE, SIMILAR = 128, 28, 5, (4, 5)
FIRST = 2
#: Buckets of the flags that tell which texts' shingles are needed.
FLAGS = 1 << 22
_draws = np.random.default_rng(20240301).integers(0, 1 << 63, WIDE_SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of a byte, each in a byte of its own.
_spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunk by chunk: the first text's number, the sorted distinct hashes of the five-word shingles of each text, how many each has (1 at least)."""
    for i, h, n in wordhash.words(texts, lower=True):
        m = np.maximum(n - WIDE_SHINGLE + 1, 1)
        text = np.repeat(np.arange(len(m)), m)
        at = np.repeat(np.cumsum(n) - n - np.cumsum(m) + m, m) + np.arange(len(text))
        words = np.repeat(np.minimum(n, WIDE_SHINGLE), m)
        total = np.zeros(len(at), np.uint64)
        for k in range(WIDE_SHINGLE):
            some = np.flatnonzero(words > k)
            total[some] += wordhash.mix(h[at[some] + k] + _draws[k])
        value = wordhash.mix(total)
        rank = np.argsort(value)
        rank = rank[np.argsort(text[rank], kind="stable")]
        value, text = value[rank], text[rank]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        yield i, value[new], np.bincount(text[new], minlength=len(m))


def wide_prints(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of WIDE bits of sets of hashes, as two words each; a bit is 1 if set in over half the hashes."""
    more = wordhash.mix(value * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15))
    both = np.stack([wordhash.mix(value), more], 1).view(np.uint8)
    begins = np.cumsum(size) - size
    steps = -(-size // 255)  # sums of 255 rows fit in a byte
    edges = np.repeat(begins - 255 * (np.cumsum(steps) - steps), steps) + 255 * np.arange(int(steps.sum()))
    few = np.add.reduceat(_spread[both], edges, axis=0).view(np.uint8)
    total = np.add.reduceat(few.astype(np.int64), np.cumsum(steps) - steps, axis=0)
    return np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<u8")


NODES = "number long, key long, size int, lo long, hi long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, value, size in shingle_sets(batch.column(1)):
            key = np.add.reduceat(wordhash.mix(value), np.cumsum(size) - size)
            prints = wide_prints(value, size).view(np.int64)
            columns = [batch.column(0).slice(i, len(size)), pa.array(key.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(prints[:, 0]), pa.array(prints[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["number", "key", "size", "lo", "hi"])


def _offers(rows: dict, cols: dict, same: bool, radius: int, first: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (id, other) of two tiles, or of one with itself, that may be similar, and whether the id has more of them.

    With first, only that many of the nearest for each row; without, all of the probing rows with nodes of other labels.
    """
    up, down = SIMILAR
    ids, others, more = [], [], []
    for i in range(0, len(rows["id"]), BLOCK):
        at = np.arange(i, min(i + BLOCK, len(rows["id"])))
        at = at[rows["probe"][at]] if first is None else at
        if not len(at):
            continue
        kept = np.zeros((0, 3), np.int64)
        n = np.zeros(len(at), np.int64)
        low, high = rows["size"][at[0]] * up, rows["size"][at[-1]] * down
        for j in range(i if same and first else 0, len(cols["id"]), BLOCK):
            to = slice(j, min(j + BLOCK, len(cols["id"])))
            if cols["size"][to.stop - 1] * down < low or cols["size"][j] * up > high:  # tiles are in order of size
                continue
            far = np.bitwise_count(rows["lo"][at, None] ^ cols["lo"][None, to]) + np.bitwise_count(rows["hi"][at, None] ^ cols["hi"][None, to])
            a, b = np.nonzero(far <= radius)
            d, b = far[a, b], b + j
            x, y = rows["size"][at[a]], cols["size"][b]
            fit = (down * x >= up * y) & (down * y >= up * x)
            if same:
                fit &= b > at[a] if first else b != at[a]
            if first is None:
                fit &= rows["label"][at[a]] != cols["label"][b]
            a, b, d = a[fit], b[fit], d[fit].astype(np.int64)
            n += np.bincount(a, minlength=len(at))
            if len(a):
                kept = np.concatenate([kept, np.stack([a, d, b], 1)])
                if first:
                    kept = kept[np.lexsort(kept.T[::-1])]
                    kept = kept[np.arange(len(kept)) - np.searchsorted(kept[:, 0], kept[:, 0]) < first]
        if len(kept):
            ids.append(rows["id"][at[kept[:, 0]]])
            others.append(cols["id"][kept[:, 2]])
            more.append(n[kept[:, 0]] > (first or len(cols["id"])))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, np.int64), (others, np.int64), (more, bool)))


TILE_COLUMNS = ("id", "size", "lo", "hi", "label", "probe")


def _meet(radius: int, first: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for c in ("left", "right"):
                    nodes = batch.column(c)[k].values
                    side = {f: nodes.field(f).to_numpy(zero_copy_only=False) for f in TILE_COLUMNS}
                    side["lo"], side["hi"], side["size"] = side["lo"].view(np.uint64), side["hi"].view(np.uint64), side["size"].astype(np.int64)
                    order = np.lexsort((side["id"], side["size"]))
                    sides.append({f: v[order] for f, v in side.items()})
                found = _offers(*sides, batch.column("same")[k].as_py(), radius, first)
                yield pa.RecordBatch.from_arrays([*map(pa.array, found)], ["id", "other", "more"])

    return run


def offers(nodes: DataFrame, radius: int, first: int | None, tile: int = TILE) -> DataFrame:
    """Candidate pairs (id, other, more) of nodes (id, size, lo, hi, label, probe), met in pairs of tiles.

    A tile has one size class (sizes of a class and of the next but one are never similar) and a run of population counts; a
    class's counts are dealt into runs of about `tile` nodes, and one count's nodes, if more, by hash. The driver plans on
    the histogram of classes and counts, which is bounded by bits and classes.
    """
    grade = F.floor(F.log(F.col("size")) / F.log(F.lit(SIMILAR[1] / SIMILAR[0]))).cast("int")
    rows = nodes.withColumn("c", grade).withColumn("p", (F.bit_count("lo") + F.bit_count("hi")).cast("int"))
    runs, at = [], {}  # (class, least count, greatest count, first tile, tiles)
    for c, p, n in sorted(rows.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n")).collect()):
        last = runs[-1] if runs else None
        if last and last["c"] == c and last["n"] + n <= tile:
            last["n"], last["high"] = last["n"] + n, p
        else:
            runs.append({"c": c, "low": p, "high": p, "n": n})
        at[c, p] = len(runs) - 1
    if not runs:
        return nodes.select("id", F.col("id").alias("other"), F.col("probe").alias("more"))
    spark, total = nodes.sparkSession, 0
    for r in runs:
        r["first"], r["tiles"] = total, -(-r["n"] // tile)
        total += r["tiles"]
    cells = spark.createDataFrame([(c, p, runs[i]["first"], runs[i]["tiles"]) for (c, p), i in at.items()], "c int, p int, first int, tiles int")
    meets = [
        (r["first"] + i, s["first"] + j)
        for x, r in enumerate(runs)
        for s in runs[x:]
        if s["c"] - r["c"] <= 1 and max(r["low"], s["low"]) - min(r["high"], s["high"]) <= radius
        for i in range(r["tiles"])
        for j in range(s["tiles"])
        if s is not r or j >= i
    ]
    if first is None:
        meets += [(b, a) for a, b in meets if a != b]  # the probing rows are those of the left tile
    pairs = spark.createDataFrame(meets, "l int, r int")
    dealt = rows.join(F.broadcast(cells), ["c", "p"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    packed = common.cut(dealt.groupBy("tile").agg(F.collect_list(F.struct(*TILE_COLUMNS)).alias("nodes"), F.max("probe").alias("probing")))
    left = packed.select(F.col("tile").alias("l"), F.col("nodes").alias("left"), "probing")
    left = left if first else left.where("probing")
    right = packed.select(F.col("tile").alias("r"), F.col("nodes").alias("right"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(meets), 10_000))
    met = pairs.join(left, "l").join(right, "r").select("left", "right", (F.col("l") == F.col("r")).alias("same")).repartition(parts)
    return common.table(met.mapInArrow(_meet(radius, first), "id long, other long, more boolean"), "offers")


def _flagged(flags):
    """The shingles of the flagged numbers' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            some = np.flatnonzero(flags.value[number % FLAGS])
            for i, value, size in shingle_sets(batch.column(1).take(pa.array(some))):
                edges = np.concatenate([[0], np.cumsum(size)])
                lists = pa.LargeListArray.from_arrays(pa.array(edges), pa.array(value.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(number[some[i : i + len(size)]]), lists], ["id", "shingles"])

    return run


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts, rows (number, text), are similar. Shingles are made again for the texts in pairs only."""
    needed = common.cut(pairs.select("id").union(pairs.select("other")).distinct())
    flags = np.zeros(FLAGS, bool)
    for (at,) in needed.select((F.col("id") % FLAGS).cast("int").alias("at")).distinct().toLocalIterator():  # FLAGS rows at most
        flags[at] = True
    own = rows.mapInArrow(_flagged(rows.sparkSession.sparkContext.broadcast(flags)), "id long, shingles array<long>")
    own = common.table(own.join(needed, "id", "left_semi").dropDuplicates(["id"]), "shingles")
    other = own.select(F.col("id").alias("other"), F.col("shingles").alias("other_shingles"))
    met = pairs.select("id", "other").join(own, "id").join(other, "other").withColumn("both", F.size(F.array_intersect("shingles", "other_shingles")))
    up, down = SIMILAR
    close = F.col("both") * down >= (F.size("shingles") + F.size("other_shingles") - F.col("both")) * up
    return met.where(close).select(F.col("id").alias("a"), F.col("other").alias("b"))


def _later(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """The numbers of all texts, rows (number, text), that are not the least of their component."""
    made = common.table(rows.mapInArrow(_nodes, NODES), "prints")
    alike = ["key", "size", "lo", "hi"]  # equal sets
    nodes = common.table(made.groupBy(*alike).agg(F.min("number").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")
    several = nodes.where("copies > 1").select(*alike, "id")
    equal = made.join(several, alike).where("number <> id").select("number")
    plain = nodes.select("id", "size", "lo", "hi", F.col("id").alias("label"), F.lit(False).alias("probe"))
    offered = offers(plain, radius, FIRST, tile)
    edges = common.cut(verified(offered, rows))
    roots = stars(edges)
    left = common.cut(offered.where("more").select("id").distinct())
    if left.count():
        label = roots.select(F.col("a").alias("id"), F.col("b").alias("root"))
        labelled = plain.drop("label", "probe").join(label, "id", "left").join(left.withColumn("asked", F.lit(True)), "id", "left")
        labelled = labelled.select("id", "size", "lo", "hi", F.coalesce("root", "id").alias("label"), F.coalesce("asked", F.lit(False)).alias("probe"))
        again = offers(common.cut(labelled), radius, None, tile)
        roots = stars(roots.union(verified(again, rows)))
    return equal.union(roots.select("a")).distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """One row of docs for each component of similar texts, that of the least id; null ids are greatest, equal ids are told apart by their text's hash.

    Texts without words are equal. Of repeated rows one stays. The columns stay as they are.
    """
    rows, keys, single = common.numbered(docs, doc_id, text)
    gone = _later(rows, radius, tile).join(keys, "number").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(F.col(text)).alias("own_hash"))
    kept = packed.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti")
    kept = kept if single else kept.dropDuplicates(["own_id", "own_hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
