"""Language-model scores: a hashed maximum-entropy model with class-factored softmax, beside an add-one unigram base.

Tokens are lower-cased (A-Z) words and one end token for each text. Documents whose crc32(id as text) mod 7 is 2 are
held out; everything is learned from all others, over whole texts.

Model: log P(word | history) = log P(class | history) + log P(leaf | class, history) + log P(part | leaf, history) +
log P(word | part). The first three are softmaxes over hashed features of the history: the word before (n-gram), the word before that (skip), and the pair
of their classes. The `TOP` most frequent words have classes made from the words they follow (k-means over counts of
anchor words) and, within a class, leaves of equal mass, and parts of equal mass within a leaf: frequent words have one
for themselves, and only a leaf of several words needs its parts' softmax. Words of one part have shares by their counts.
All other words share the last leaf of the last class, with add-one shares and one place for unseen words. Weights are trained by gradient: every task runs mini-batch updates over
its own part of the corpus from common weights, and the changes are averaged by how often each weight was used; `rounds`
such passes are made. The weight tables and the words with leaves of their own grow with the square root of the corpus's
distinct words, as each task sends its changes of the whole tables: 64 MB of weights for 10**9 words.

Rare words' counts are joined, not broadcast: a row for each document and distinct rare word.

A null text is empty: its only token is the end. A null id is never held out. Repeated rows are scored one by one.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

#: Words that get classes and leaves of their own, at least, and for each unit of the square root of all distinct words; of them, words that are clustered by what they follow.
TOP, TOP_PER_ROOT, CLUSTERED = 1 << 18, 200, 1 << 14
CLASSES, LEAVES, PARTS, CLUSTERS, ANCHORS = 32, 32, 16, 8, 24
#: Rows of the first weight table, at least, and for each unit of that root (the next power of two); the others have twice as many; rows that are shuffled together.
ROWS, ROWS_PER_ROOT, ROW_BLOCK = 1 << 14, 12, 1 << 10
STEP, RATE = 1 << 14, 0.2
SOFTMAX_BLOCK = 1 << 12
NEVER = -1e9
END = np.uint64(0x0E4D0E4D0E4D0E4D)
BEGIN = np.uint64(0x0B0B0B0B0B0B0B0B)
SALTS = 16


@dataclass
class Model:
    known: np.ndarray  # hashes of the top words, sorted
    group: np.ndarray  # class of each, and of any other word at the end
    leaf: np.ndarray  # class * LEAVES + leaf within it
    part: np.ndarray
    many: np.ndarray  # whether a leaf has several parts
    log_share: np.ndarray  # log10 P(word | part), 0 for other words
    log_count: np.ndarray  # log10((c + 1) / (N + V + 1)), 0 for other words
    bias: np.ndarray
    bias_2: np.ndarray
    bias_3: np.ndarray
    weight: np.ndarray
    weight_2: np.ndarray
    weight_3: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.weight, self.weight_2, self.weight_3]

    def place(self, h: np.ndarray) -> np.ndarray:
        """Where a hash stands in `known`; its length for other words."""
        at = np.searchsorted(self.known, h)
        found = self.known[np.minimum(at, len(self.known) - 1)] == h if len(self.known) else np.zeros(len(h), bool)
        return np.where(found, at, len(self.known))


def _training(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) != 2


def _sequences(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, hashes with an end after each text, tokens of each text."""
    for first, h, n in wordhash.words(texts, lower=True):
        yield first, np.insert(h, np.cumsum(n), END), n + 1


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    values, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(which, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list = []
    for batch in rows:
        for _, h, _ in _sequences(batch.column(0)):
            parts.append(np.unique(h, return_counts=True))
            if len(parts) == 24:
                parts = [_merged(parts)]
    if parts:
        values, n = _merged(parts)
        for i in range(0, len(values), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(values[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["h", "n"])


def vocabulary(train: DataFrame) -> DataFrame:
    """h and c of all distinct training tokens."""
    return common.table(train.select("text").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "vocabulary")


def _follow(known, anchors: np.ndarray):
    order = np.argsort(anchors)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = known.value
        total = np.zeros((CLUSTERED + 1) * ANCHORS, np.int64)
        for batch in rows:
            for _, h, _ in _sequences(batch.column(0)):
                at = np.minimum(np.searchsorted(anchors, h, sorter=order), len(anchors) - 1)
                before = np.flatnonzero(anchors[order[at]][:-1] == h[:-1])
                word = h[before + 1]
                place = np.minimum(np.searchsorted(words, word), len(words) - 1)
                own = np.where(words[place] == word, names[place], CLUSTERED)
                total += np.bincount(own * ANCHORS + order[at[before]], minlength=len(total))
        cell = np.flatnonzero(total[: CLUSTERED * ANCHORS])
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell])], ["cell", "n"])

    return run


def _clusters(vectors: np.ndarray, n: int) -> np.ndarray:
    """k-means on the sphere, begun from vectors far from each other."""
    x = np.sqrt(vectors)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[:1]
    near = x @ centre[0]
    pool = min(len(x), 2000)
    for _ in range(n - 1):
        centre = np.vstack([centre, x[np.argmin(near[:pool])]])
        near = np.maximum(near, x @ centre[-1])
    for _ in range(12):
        label = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[label == k].mean(0) if (label == k).any() else centre[k] for k in range(n)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return label


def _equal_mass(counts: np.ndarray, n: int) -> np.ndarray:
    """Parts 0 to n - 1 of about equal mass, in the given order."""
    middle = np.cumsum(counts) - counts / 2
    return np.minimum((middle / max(counts.sum(), 1) * n).astype(np.int64), n - 1)


def _log_mass(mass: np.ndarray) -> np.ndarray:
    """Biases of outcomes; one without words has no probability."""
    return np.where(mass > 0, np.log(np.maximum(mass, 1)), NEVER)


def start(train: DataFrame, words: DataFrame) -> tuple[Model, int, int, float]:
    """The untrained model, N, V and the mass of the shared leaf."""
    spark = train.sparkSession
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_tokens, n_types = int(totals[0]), int(totals[1])
    sizes = words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toPandas() if n_types else None
    least = 2
    if n_types:
        upto = sizes["n"].cumsum()
        fit = sizes["c"][(upto <= max(TOP, TOP_PER_ROOT * isqrt(n_types))) & (sizes["c"] >= 2)]
        least = int(fit.min()) if len(fit) else int(sizes["c"].max()) + 1
    top = words.where(F.col("c") >= least).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    group, leaf = np.full(len(h), CLASSES - 1), np.zeros(len(h), np.int64)
    if (m := min(CLUSTERED, len(h))) > 1:
        order = np.argsort(h[:m])
        shared = spark.sparkContext.broadcast((h[:m][order], order))
        cells = train.select("text").mapInArrow(_follow(shared, h[: min(ANCHORS, m)]), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        follow = np.zeros(CLUSTERED * ANCHORS)
        follow[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
        label = _clusters(follow.reshape(CLUSTERED, ANCHORS)[:m], min(CLUSTERS, m))
        by_label = np.lexsort((np.arange(m), label))
        group[by_label] = _equal_mass(c[:m][by_label], CLASSES - 1)
    for g in range(CLASSES):
        own = np.flatnonzero(group == g)
        leaf[own] = _equal_mass(c[own], LEAVES - (g == CLASSES - 1))
    other = n_tokens - int(c.sum())
    whole = group * LEAVES + leaf
    by_leaf = np.argsort(whole, kind="stable")
    below = np.cumsum(c[by_leaf]) - c[by_leaf] / 2
    first = np.searchsorted(whole[by_leaf], np.arange(CLASSES * LEAVES + 1))
    edge = np.append(0, np.cumsum(c[by_leaf]))[first]
    part = np.zeros(len(h), np.int64)
    part[by_leaf] = np.minimum((below - edge[whole[by_leaf]]) / np.maximum(np.diff(edge), 1)[whole[by_leaf]] * PARTS, PARTS - 1).astype(np.int64)
    fine = np.zeros((CLASSES * LEAVES, PARTS))
    np.add.at(fine, (whole, part), c)
    share = np.log10(c / fine[whole, part]) if len(h) else np.zeros(0)
    mass = fine.sum(1).reshape(CLASSES, LEAVES)
    mass[-1, -1] = other + 1
    many = (fine > 0).sum(1) > 1
    bias_3 = _log_mass(fine)
    bias_2 = _log_mass(mass) - np.log(np.maximum(mass.sum(1, keepdims=True), 1))
    order = np.argsort(h)
    n_rows = max(ROWS, 1 << (ROWS_PER_ROOT * isqrt(n_types)).bit_length())
    model = Model(
        h[order],
        np.append(group[order], CLASSES - 1),
        np.append(whole[order], CLASSES * LEAVES - 1),
        np.append(part[order], 0),
        many,
        np.append(share[order], 0.0),
        np.append(np.log10((c[order] + 1) / (n_tokens + n_types + 1)), 0.0),
        _log_mass(mass.sum(1)).astype(np.float32),
        bias_2.astype(np.float32),
        bias_3.astype(np.float32),
        np.zeros((n_rows, CLASSES), np.float32),
        np.zeros((2 * n_rows, LEAVES), np.float32),
        np.zeros((2 * n_rows, PARTS), np.float32),
    )
    return model, n_tokens, n_types, float(other + n_types - len(h) + 1)


def _features(model: Model, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashed features of the history of all tokens."""
    at = model.place(h)
    begin = np.cumsum(n) - n
    one, two = np.roll(h, 1), np.roll(h, 2)
    one[begin] = two[begin] = BEGIN
    second = begin[n > 1] + 1
    two[second] = BEGIN
    c = model.group[at].astype(np.uint64)
    c1, c2 = np.roll(c, 1), np.roll(c, 2)
    c1[begin] = c2[begin] = CLASSES
    c2[second] = CLASSES
    raw = np.stack([one, two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), c1 * np.uint64(64) + c2 + np.uint64(7 << 40)], 1)
    return at, raw


def _levels(model: Model, at: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For each softmax: its number, the tokens it is for, their biases, rows of its weights and outcomes."""
    leaf = model.leaf[at]
    group = model.group[at]

    def rows(raw: np.ndarray, given: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return (wordhash.mix(raw + given[:, None].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) & np.uint64(len(weight) - 1)).astype(np.int64)

    yield 0, slice(None), model.bias, (wordhash.mix(raw) & np.uint64(len(model.weight) - 1)).astype(np.int64), group
    yield 1, slice(None), model.bias_2[group], rows(raw, group, model.weight_2), leaf % LEAVES
    some = np.flatnonzero(model.many[leaf])
    if len(some):
        yield 2, some, model.bias_3[leaf[some]], rows(raw[some], leaf[some] + CLASSES, model.weight_3), model.part[at[some]]


def _softmax(base: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of base (one for all, or one for each token) and the rows' weights; a block at a time, which stays in the processor's cache."""
    out, one = np.empty((len(rows), weight.shape[1]), weight.dtype), np.ones(weight.shape[1], weight.dtype)
    for i in range(0, len(rows), SOFTMAX_BLOCK):
        x, own = out[i : i + SOFTMAX_BLOCK], rows[i : i + SOFTMAX_BLOCK]
        x[:] = base if base.ndim == 1 else base[i : i + SOFTMAX_BLOCK]
        for j in range(rows.shape[1]):
            x += np.take(weight, own[:, j], axis=0)
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= (x @ one)[:, None]
    return out


def _update(weight: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, p: np.ndarray, truth: np.ndarray) -> None:
    """One step of gradient descent, with rates that fall as a weight's gradients add up."""
    p[np.arange(len(p)), truth] -= 1
    for j in range(rows.shape[1]):
        key = rows[:, j].astype(np.uint16 if len(weight) <= 1 << 16 else np.int32)  # short keys are sorted by radix
        order = np.argsort(key, kind="stable")
        own = np.take(key, order)
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        at = own[new].astype(np.int64)
        g = np.add.reduceat(np.take(p, order, axis=0), new, axis=0)
        total = np.take(squares, at, axis=0)
        total += g * g
        squares[at] = total
        total += np.float32(1e-6)
        g *= np.float32(RATE)
        g /= np.sqrt(total, out=total)
        weight[at] -= g
        used[at] += np.diff(np.append(new, len(own)))


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        own = [w.copy() for w in model.weights()]
        squares = [np.ones_like(w) for w in own]
        used = [np.zeros(len(w), np.int64) for w in own]
        for batch in batches:
            for _, h, n in _sequences(batch.column(0)):
                at, raw = _features(model, h, n)
                for i in range(0, len(h), STEP):
                    for t, _, bias, rows, truth in _levels(model, at[i : i + STEP], raw[i : i + STEP]):
                        _update(own[t], squares[t], used[t], rows, _softmax(bias, own[t], rows), truth)
        first = 0
        for w, old, n in zip(own, model.weights(), used):
            change = ((w - old) * n[:, None]).astype(np.float32)
            for b in range(0, len(w), ROW_BLOCK):
                if n[b : b + ROW_BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([first + b], pa.int32()), pa.array([change[b : b + ROW_BLOCK].tobytes()]), pa.array([n[b : b + ROW_BLOCK].tobytes()])], ["block", "change", "used"])
            first += len(w)

    return run


CHANGE = "block int, change binary, used binary"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for batch in batches:
        for row in batch.select(["block", "change", "used"]).to_pylist():
            new = np.frombuffer(row["change"], np.float32)
            change, used = total.setdefault(row["block"], (np.zeros(len(new), np.float32), np.zeros(ROW_BLOCK, np.int64)))
            change += new
            used += np.frombuffer(row["used"], np.int64)
    for block, (change, used) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([change.tobytes()]), pa.array([used.tobytes()])], ["block", "change", "used"])


def train_model(model: Model, train: DataFrame, rounds: int = 1) -> Model:
    spark = train.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        parts = train.select("text").mapInArrow(_train(shared), CHANGE).withColumn("salt", F.spark_partition_id() % SALTS)
        some = parts.repartition("block", "salt").mapInArrow(_add, CHANGE)
        for row in some.repartition("block").mapInArrow(_add, CHANGE).collect():  # a row for each block of weights
            at = row["block"]
            for weight in model.weights():
                if at < len(weight):
                    break
                at -= len(weight)
            used = np.frombuffer(row["used"], np.int64)[:, None]
            weight[at : at + ROW_BLOCK] += np.frombuffer(row["change"], np.float32).reshape(ROW_BLOCK, -1) / np.maximum(used, 1)
    return model


SCORED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_top", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weights = model.weights()
        for batch in batches:
            for first, h, n in _sequences(batch.column("text")):
                at, raw = _features(model, h, n)
                log = np.zeros(len(h))
                for i in range(0, len(h), STEP):
                    for t, which, bias, rows, truth in _levels(model, at[i : i + STEP], raw[i : i + STEP]):
                        p = _softmax(bias, weights[t], rows)[np.arange(len(rows)), truth]
                        log[i : i + STEP][which] += np.log10(p.astype(np.float64) + 1e-30)
                edges = np.cumsum(n) - n
                top = at < len(model.known)
                other = np.flatnonzero(~top)
                doc = np.repeat(np.arange(len(n)), n)[other]
                order = np.lexsort((h[other], doc))
                doc, word = doc[order], h[other][order]
                new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(word, prepend=np.uint64(0)) != 0)) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(doc)))
                split = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(split), pa.array(x)) for x in (word[new].view(np.int64), times)]
                here = batch.slice(first, len(n))
                sums = [np.add.reduceat(x, edges) for x in (top.astype(np.int64), model.log_count[at], log + model.log_share[at])]
                yield pa.RecordBatch.from_arrays([here.column("row"), here.column("doc_id"), here.column("held_out"), pa.array(n, pa.int64()), *map(pa.array, sums), *lists], schema=SCORED)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    train = rows.where(_training(F.col("doc_id")))
    words = vocabulary(train)
    model, n_tokens, n_types, other_mass = start(train, words)
    shared = spark.sparkContext.broadcast(train_model(model, train, rounds))
    named = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~_training(F.col("doc_id"))).alias("held_out"), "text")
    types = "row long, doc_id long, held_out boolean, n_tokens long, n_top long, base double, score double, rare array<long>, times array<long>"
    scored = common.table(named.mapInArrow(_score(shared), types), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    met = rare.join(words, "h", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    added = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("log"), F.sum("times").alias("n"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known")
    )
    log, n = F.coalesce("log", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return scored.select("row", "doc_id", "held_out", "n_tokens", "n_top", "base", "score").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - n * F.log10(F.lit(float(n_tokens + n_types + 1)))).alias("base_score"),
        (F.col("score") + log - n * F.log10(F.lit(other_mass))).alias("score"),
    )
