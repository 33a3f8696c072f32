"""Torrents: fixed pieces over the joined bytes of many files, their metadata as bencoded bytes, and checks against a tree.

Files are rows (torrent, path, length) of any number of torrents. Their places within a torrent's bytes are running sums
over all files in order of path; each file's range is cut at the bounds of pieces, and the parts of a piece meet by its
number, so a piece is as large as a group ever gets. A torrent whose only path is empty is that of a single file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..snapshots import running_total
from ..sources import trees

LEAST_PIECE = 1 << 14


def piece_length(given: int | None, total: Column) -> Column:
    """The wanted length of pieces, which must be a power of two from 16 KiB on, else one that fits the torrent's size."""
    if given is None:
        return scalars.piece_size(total)
    if given < LEAST_PIECE or given & (given - 1):
        raise ValueError(f"a piece has a power of two of bytes, {LEAST_PIECE} or more, not {given}")
    return F.lit(given).cast("long")


def placed(files: DataFrame, piece: int | None = None) -> DataFrame:
    """files with start (bytes of the torrent's files before it), total and piece_length of the torrent."""
    own = files.withColumn("length", F.col("length").cast("long"))
    rows = running_total(own, ["torrent", "path"], "length", "start")
    per = rows.groupBy("torrent").agg(F.min("start").alias("first"), F.sum("length").alias("total"))
    met = rows.join(F.broadcast(per.withColumn("piece_length", piece_length(piece, F.col("total")))), "torrent")  # a row for each torrent; files stay where they are
    return met.withColumn("start", F.col("start") - F.col("first")).drop("first")


def _parts(own: DataFrame, **more: Column) -> DataFrame:
    """torrent, piece and part of each file that lies in it: at (its place in the piece), offset (in the file), length, and more."""
    size, end = F.col("piece_length"), F.col("start") + F.col("length")
    whole = lambda c: F.floor(c / size).cast("long")
    numbers = F.when(F.col("length") > 0, F.sequence(whole(F.col("start")), whole(end - 1)))

    def part(k: Column) -> Column:
        first = F.greatest(F.col("start"), k * size)
        offset, length = first - F.col("start"), F.least(end, (k + 1) * size) - first
        return F.struct(k.alias("piece"), F.struct((first - k * size).alias("at"), offset.alias("offset"), length.alias("length"), *(c(offset, length).alias(n) for n, c in more.items())).alias("part"))

    return own.select("torrent", F.explode(F.transform(numbers, part)).alias("p")).select("torrent", "p.piece", "p.part")


def pieces_of_contents(own: DataFrame) -> DataFrame:
    """torrent, piece, sha1 (lower case) of placed files that carry their content as a column."""
    cut = _parts(own, bytes=lambda offset, length: F.substr(F.col("content"), (offset + 1).cast("int"), length.cast("int")))
    met = cut.groupBy("torrent", "piece").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
    return met.select("torrent", "piece", F.sha1(joined).alias("sha1"))


def pieces_of_files(own: DataFrame, root: str, share: int = trees.SHARE) -> DataFrame:
    """torrent, piece, sha1, error of placed files below root, read in ranges by the tasks."""
    cut = _parts(own, path=lambda offset, length: F.col("path"))
    met = cut.groupBy("torrent", "piece").agg(F.array_sort(F.collect_list("part")).alias("segments"), F.sum("part.length").alias("bytes"))
    return trees.hash_segments(trees.dealt(met, "bytes", share).drop("bytes"), root)


def _text(c: Column) -> Column:
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def _number(c: Column) -> Column:
    return F.concat(F.lit("i"), c.cast("string"), F.lit("e"))


def _entry(key: str) -> Column:
    return F.lit(f"{len(key.encode())}:{key}")


def metadata(own: DataFrame, pieces: DataFrame, trackers: tuple[str, ...] = (), comment: str | None = None, private: bool = False, made_by: str = "holdfast") -> DataFrame:
    """torrent, n_files, total, piece_length, n_pieces, info_hash, content: a torrent file for each torrent.

    The first tracker is announced, and several are listed. A torrent file holds the names of all its files and the hashes
    of all its pieces as one value, as its format asks for.
    """
    steps = F.concat(F.lit("l"), F.array_join(F.transform(F.split("path", "/"), _text), ""), F.lit("e"))
    row = F.struct("path", F.concat(F.lit("d"), _entry("length"), _number(F.col("length")), _entry("path"), steps, F.lit("e")).alias("text"))
    names = own.groupBy("torrent", "total", "piece_length").agg(F.array_sort(F.collect_list(row)).alias("files"), F.count(F.lit(1)).alias("n_files"), F.max(F.col("path") == "").alias("has_bare"))
    sums = pieces.groupBy("torrent").agg(F.array_sort(F.collect_list(F.struct("piece", "sha1"))).alias("sums"))
    met = names.join(sums, "torrent", "left").withColumn("sums", F.coalesce("sums", F.array().cast("array<struct<piece:bigint,sha1:string>>")))
    single = (F.col("n_files") == 1) & F.col("has_bare")
    first = F.when(single, F.concat(_entry("length"), _number(F.col("total")))).otherwise(F.concat(_entry("files"), F.lit("l"), F.array_join(F.transform("files", lambda f: f["text"]), ""), F.lit("e")))
    head = F.concat(F.lit("d"), first, _entry("name"), _text(F.col("torrent")), _entry("piece length"), _number(F.col("piece_length")), _entry("pieces"))
    raw = F.unhex(F.array_join(F.transform("sums", lambda s: s["sha1"]), ""))
    info = F.concat(head.cast("binary"), F.concat(F.octet_length(raw).cast("string"), F.lit(":")).cast("binary"), raw, F.lit(("7:privatei1e" if private else "") + "e").cast("binary"))
    plain = lambda s: f"{len(s.encode())}:{s}"
    before = "d" + (plain("announce") + plain(trackers[0]) if trackers else "") + (plain("announce-list") + "l" + "".join(f"l{plain(t)}e" for t in trackers) + "e" if len(trackers) > 1 else "")
    before += (plain("comment") + plain(comment) if comment is not None else "") + plain("created by") + plain(made_by) + plain("info")
    made = met.withColumn("info", info)
    content = F.concat(F.lit(before).cast("binary"), F.col("info"), F.lit("e").cast("binary"))
    return made.select("torrent", "n_files", "total", "piece_length", F.size("sums").cast("long").alias("n_pieces"), F.sha1("info").alias("info_hash"), content.alias("content"))


def _value(data: bytes, at: int):
    """The bencoded value at a place, and where it ends."""
    kind = data[at : at + 1]
    if kind == b"i":
        end = data.index(b"e", at)
        return int(data[at + 1 : end]), end + 1
    if kind in (b"l", b"d"):
        found, at = [], at + 1
        while data[at : at + 1] != b"e":
            if kind == b"d":
                key, at = _value(data, at)
                start = at
            value, at = _value(data, at)
            found.append((key, value, data[start:at]) if kind == b"d" else value)
        return ({k: (v, raw) for k, v, raw in found} if kind == b"d" else found), at + 1
    colon = data.index(b":", at)
    end = colon + 1 + int(data[at:colon])
    if end > len(data):
        raise ValueError("a string ends early")
    return data[colon + 1 : end], end


PARSED = "source string, name string, info_raw binary, piece_length long, private boolean, pieces binary, files array<struct<path:string,length:bigint>>, error string"
_PARSED = pa.schema(
    [("source", pa.string()), ("name", pa.string()), ("info_raw", pa.binary()), ("piece_length", pa.int64()), ("private", pa.bool_()), ("pieces", pa.binary()), ("files", pa.list_(pa.struct([("path", pa.string()), ("length", pa.int64())]))), ("error", pa.string())]
)


def _parse(source: str, content: bytes) -> dict:
    try:
        info, raw = _value(content, 0)[0][b"info"]
        get = lambda d, k: d[k][0] if k in d else None
        single = get(info, b"files") is None
        files = [{"path": "", "length": get(info, b"length")}] if single else [{"path": "/".join(s.decode() for s in get(f, b"path")), "length": get(f, b"length")} for f in get(info, b"files")]
        return {"source": source, "name": get(info, b"name").decode(), "info_raw": raw, "piece_length": get(info, b"piece length"), "private": get(info, b"private") == 1, "pieces": get(info, b"pieces"), "files": files}
    except (ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError) as e:
        return {"source": source, "error": f"no torrent: {e}"}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_pylist([_parse(source, content)], _PARSED)


def read(torrents: DataFrame) -> DataFrame:
    """Torrent files (path, content) as source, name, info_hash, piece_length, private, pieces, files (path, length) and error."""
    found = torrents.select("path", "content").mapInArrow(_parsed, PARSED)
    return found.select("source", "name", F.sha1("info_raw").alias("info_hash"), "piece_length", "private", "pieces", "files", "error")


def entries(parsed: DataFrame) -> DataFrame:
    """source, path (below the folder that holds the torrent's own) and length of each file."""
    each = parsed.where("error is null").select("source", "name", F.explode("files").alias("f"))
    return each.select("source", F.when(F.col("f.path") == "", F.col("name")).otherwise(F.concat_ws("/", "name", "f.path")).alias("path"), F.col("f.length").alias("length"))


def stated_pieces(parsed: DataFrame) -> DataFrame:
    """source, piece and the SHA-1 that the torrent states for it."""
    n = F.floor(F.octet_length("pieces") / 20).cast("int")
    each = parsed.where("error is null").where(n > 0).select("source", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lower(F.hex(F.substr("pieces", k * 20 + 1, F.lit(20)))))).alias("piece", "sha1"))
    return each.select("source", F.col("piece").cast("long").alias("piece"), "sha1")


def check(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """source, path, state (found, missing, wrong size), expected and actual bytes, by name and size alone."""
    met = wanted.join(listing.select("path", F.col("size").alias("actual")), "path", "left")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("length"), "found").otherwise("wrong size")
    return met.select("source", "path", state.alias("state"), F.col("length").alias("expected"), "actual")


def report(checked: DataFrame) -> DataFrame:
    """A row for each torrent: files, found, missing, wrong_size and percent (whole, rounded down)."""
    count = lambda state: F.count_if(F.col("state") == state)
    per = checked.groupBy("source").agg(F.count(F.lit(1)).alias("files"), count("found").alias("found"), count("missing").alias("missing"), count("wrong size").alias("wrong_size"))
    return per.withColumn("percent", F.floor(F.col("found") * 100 / F.col("files")).cast("long"))


def bad_pieces(stated: DataFrame, actual: DataFrame) -> DataFrame:
    """source and piece of those whose bytes are missing or not what the torrent states."""
    own = actual.select(F.col("torrent").alias("source"), "piece", F.col("sha1").alias("own"))
    return stated.join(own, ["source", "piece"], "left").where(~F.col("sha1").eqNullSafe(F.col("own"))).select("source", "piece")
