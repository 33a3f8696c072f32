"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Words are lower-cased (A-Z) runs of characters other than ASCII punctuation, blanks and controls. Of the k-gram hashes
of a text, the smallest of each run of `WINDOW - K + 1` is kept: it stands for the window of `WINDOW` words that the run
covers, so two texts that share such a window share its kept hash. Documents and items are joined on kept hashes; of the
documents' windows only those whose kept hash is shared are written out and joined with the items' windows, which tells
true hits and extends them to all words of the shared passage. An item shorter than a window is one window, and stands for
itself by the hash of all its words. All sizes of windows are looked up in one pass over the documents.

Work and rows are in proportion to words and hits, however often they repeat in document and item: each window goes out with
its place, once. A document's words are
never shuffled where items are few: then one row for each document is. Item hashes and windows are broadcast only while
they are small (`BROADCAST_BYTES`, checked); beyond, documents are cut to the hashes they share by a shuffled semi-join, and
the words of those that share any are joined back once. A hash or window that very many documents share makes a skewed
join, which adaptive execution splits on the documents' side.

Null texts have no words. Repeated document rows each get a row; documents of one id are told apart by their texts. Repeated
items count once by item_id, a null item_id as an empty string. Only ids and texts are read, so other columns may have any
names, and `drop_contaminated` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

K, WINDOW = 5, 10
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bytes of item windows, about, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def gram_hashes(words: Column, k: int) -> Column:
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, every).otherwise(F.array().cast("array<bigint>"))


def window_hashes(words: Column, grams: Column) -> Column:
    """For each window of WINDOW words the smallest of the hashes of its K-grams."""
    n = F.size(words)
    least = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(*[F.get(grams, i + j) for j in range(WINDOW - K + 1)]))
    return F.when(n >= WINDOW, least).otherwise(F.array().cast("array<bigint>"))


def _with_hashes(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows, which have words, with h<size>: for each window of that size its hash."""
    if WINDOW in sizes:
        rows = rows.withColumn("grams", gram_hashes(F.col("words"), K)).withColumn(f"h{WINDOW}", window_hashes(F.col("words"), F.col("grams"))).drop("grams")
    return rows.withColumns({f"h{s}": gram_hashes(F.col("words"), s) for s in sizes if s != WINDOW})


def _window(at: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", at + 1, size), " ")


def _item_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """size, value, window (its words) and the sorted ids of the items that have it, for each window of the items."""
    parts = []
    for s in sizes:
        own = _with_hashes(items.where(F.size("words") >= WINDOW if s == WINDOW else F.size("words") == s), [s])
        each = own.select("item_id", "words", F.posexplode_outer(f"h{s}").alias("at", "value"))
        parts.append(each.select(F.lit(s).alias("size"), "value", _window(F.col("at"), F.lit(s)).alias("window"), "item_id"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("size", "value", "window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


KEY = ["doc_id", "text_hash", "n_words"]


def _exploded(made: DataFrame, sizes: list[int], *more: str) -> DataFrame:
    """KEY, more, nth, size, value and at of each window of the documents, and before these a row for each document, nth 0.

    The hashes of all sizes go out as one array of numbers, and their sizes and places follow from the position in it.
    """
    none = F.array(F.lit(None).cast("bigint"))
    counted = made.select(*KEY, *more, *[F.size(f"h{s}").alias(f"n{s}") for s in sizes], F.concat(none, *[f"h{s}" for s in sizes]).alias("all"))
    # outer: an inner explode has the optimizer test its array in a filter, where it is made anew for each of its elements
    each = counted.select(*KEY, *more, *[f"n{s}" for s in sizes], F.posexplode_outer("all").alias("nth", "value"))
    start, size, at = F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int")
    for s in sizes:
        here = F.col("nth") >= start
        size, at = F.when(here, s).otherwise(size), F.when(here, F.col("nth") - start).otherwise(at)
        start = start + F.col(f"n{s}")
    return each.select(*KEY, *more, "nth", size.alias("size"), "value", at.alias("at"))


def _hits(docs: DataFrame, windows: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """KEY, at, size and item_ids of each window of the documents that an item has, and a row for each document with marks 1."""
    values = windows.select("size", "value").distinct()
    made = _with_hashes(docs, sizes)
    if few:
        each = _exploded(made, sizes, "words").withColumn("marks", (F.col("nth") == 0).cast("int")).drop("nth")
        met = each.join(F.broadcast(values.withColumn("shared", F.lit(True))), ["size", "value"], "left").where("shared or marks = 1")
    else:
        each = _exploded(made, sizes).where("nth > 0").drop("nth")
        shared = each.join(values, ["size", "value"], "left_semi").groupBy(*KEY).agg(F.collect_set(F.struct("size", "value", "at")).alias("shared"))
        same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in KEY]
        both = docs.alias("m").join(shared.alias("s"), same[0] & same[1] & same[2])
        met = both.select(*[F.col(f"m.{c}").alias(c) for c in [*KEY, "words"]], F.explode("s.shared").alias("v"))
        met = met.select(*KEY, "words", F.lit(0).alias("marks"), "v.size", "v.value", "v.at")
    at = met.select(*KEY, "marks", "size", "value", "at", F.when(F.col("at").isNotNull(), _window(F.col("at"), F.col("size"))).alias("window"))
    if few:
        return at.join(F.broadcast(windows), ["size", "value", "window"], "left").where("item_ids is not null or marks = 1")
    found = at.join(windows, ["size", "value", "window"])
    return found.unionByName(docs.select(*KEY, F.lit(1).alias("marks")), allowMissingColumns=True)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids), runs (start and stop of each run of hit words), contaminated."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), word_list(F.col(item_text)).alias("words"))
    items = items.where(F.size("words") > 0)
    weight = F.sum(WINDOW * F.octet_length(F.array_join("words", " ")).cast("long") + 40)
    about = items.agg(F.sort_array(F.collect_set(F.least(F.size("words"), F.lit(WINDOW)))).alias("sizes"), weight.alias("bytes")).first()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), word_list(F.col(text)).alias("words"))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    if about["sizes"]:
        found = _hits(base, _item_windows(items, about["sizes"]), about["sizes"], about["bytes"] <= BROADCAST_BYTES)
    else:
        none = {"at": F.lit(None).cast("int"), "size": F.lit(None).cast("int"), "item_ids": F.lit(None).cast("array<string>")}
        found = base.select(*KEY, F.lit(1).alias("marks"), *[c.alias(n) for n, c in none.items()])
    here = F.col("item_ids").isNotNull()
    per_doc = found.groupBy(*KEY).agg(
        F.sum("marks").cast("int").alias("copies"), F.collect_set(F.when(here, F.struct("at", "size"))).alias("windows"), F.collect_set("item_ids").alias("item_ids")
    )
    words = F.flatten(F.transform("windows", lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1)))
    per_doc = per_doc.withColumns({"hit": F.array_sort(F.array_distinct(words)), "items": F.array_sort(F.array_distinct(F.flatten("item_ids")))})
    first = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) != x - 1))
    last = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) != x + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))
    out = per_doc.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    n_hit = F.size("hit").cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", runs.alias("runs"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without a hit, with the columns they came with."""
    bad = contamination(docs, benchmark, doc_id, text).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(F.col(text)).alias("own_hash"))
    kept = packed.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, sz, array_to_string(ws[i:i+sz-1], ' ') AS s FROM (SELECT item_id, ws, least(10, len(ws)) AS sz, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, sz, i, array_to_string(ws[i:i+sz-1], ' ') AS s FROM (SELECT rid, ws, sz, unnest(range(1, len(ws) - sz + 2)) AS i FROM d, (SELECT DISTINCT sz FROM iw) z WHERE len(ws) >= sz)),
m AS (SELECT rid, i, dw.sz, item_id FROM dw JOIN iw ON iw.s = dw.s AND iw.sz = dw.sz),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + sz)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN t ON t.rid = d.rid
"""
