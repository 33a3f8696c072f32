"""File trees, torrents and zip directories on temporary folders, against hashlib and plain Python."""

from __future__ import annotations

import hashlib
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from holdfast.operators import torrents
from holdfast.sources import files, trees


def _put(root, path, content):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(content)


def _hashes(content):
    return len(content), hashlib.sha1(content).hexdigest().upper(), hashlib.md5(content).hexdigest().upper(), f"{zlib.crc32(content):08X}"


BODY = bytes(random.Random(1).randrange(256) for _ in range(3_000_000))
TREE = {
    "empty": b"", "a/one.bin": b"one", "a/b/c/deep.nes": b"NES\x1a" + bytes(12) + BODY[:5000], "a/b/short.nes": b"NES\x1a" + bytes(12), "a/b/x.7": bytes(1) + b"ATARI7800" + bytes(118) + b"rest",
    "z/game.SMC": BODY[: 2048 + 512], "z/large.bin": BODY, "z/é ü.bin": b"x" * 70_000,
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        _put(at, path, content)
    (at / "a" / "loop").symlink_to(at)
    (at / "linked").symlink_to(at / "z")
    return at


def test_listing_and_hashes(spark, root):
    want = TREE | {f"linked/{p[2:]}": c for p, c in TREE.items() if p.startswith("z/")}
    for folders in (1, 3, 256):
        listing = trees.listed(spark, str(root), folders=folders)
        assert {r.path: r.size for r in listing.collect()} == {p: len(c) for p, c in want.items()}
    got = {r.path: r for r in trees.hash_files(listing, str(root)).collect()}
    assert {p: (r.size, r.sha1, r.md5, r.crc32) for p, r in got.items()} == {p: _hashes(c) for p, c in want.items()}
    bare = {"a/b/c/deep.nes": 16, "a/b/x.7": 128, "z/game.SMC": 512, "linked/game.SMC": 512}
    assert {p: r.sha1_no_header for p, r in got.items() if r.sha1_no_header} == {p: _hashes(want[p][n:])[1] for p, n in bare.items()}
    whole = {r.path: r for r in files.hashes(spark.createDataFrame([(p, bytearray(c)) for p, c in want.items()], "path string, content binary")).collect()}
    assert all(whole[p].sha1_no_header == r.sha1_no_header and whole[p].crc32 == r.crc32 for p, r in got.items())


def test_a_folder_of_the_tree_and_faults(spark, root):
    assert {r.path for r in trees.listed(spark, str(root), "a/b").collect()} == {"a/b/c/deep.nes", "a/b/short.nes", "a/b/x.7"}
    gone = trees.hash_files(spark.createDataFrame([("no/such", 5), ("empty", 0)], "path string, size long"), str(root)).collect()
    assert {r.path: (r.sha1 is None, r.error is None) for r in gone} == {"no/such": (True, False), "empty": (False, True)}
    with pytest.raises(Exception, match="is no folder"):
        trees.listed(spark, str(root / "nowhere")).collect()


def test_a_file_beyond_two_gigabytes_is_streamed(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as out:
        out.truncate(3 << 30)
    size, block, want = 3 << 30, bytes(1 << 24), hashlib.sha1()
    for _ in range(size >> 24):
        want.update(block)
    row = trees.hash_files(trees.listed(spark, str(tmp_path)), str(tmp_path)).first()
    assert (row.size, row.sha1, row.error) == (size, want.hexdigest().upper(), None)


def test_written_files_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([("x/a", bytearray(b"1")), ("x/y/b.zst", bytearray(b"22")), ("c", None)], "path string, content binary")
    assert {(r.path, r.size) for r in trees.write_files(rows, str(tmp_path)).collect()} == {("x/a", 1), ("x/y/b.zst", 2), ("c", 0)}
    assert (tmp_path / "x/y/b.zst").read_bytes() == b"22" and sorted(os.listdir(tmp_path / "x")) == ["a", "y"]


def test_zip_directories_and_stamps(spark, tmp_path):
    for name, times in {"fixed.zip": [(1996, 12, 24, 23, 32, 0)] * 3, "mixed.zip": [(1996, 12, 24, 23, 32, 0), (2001, 2, 3, 4, 5, 6)], "none.zip": []}.items():
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as out:
            for i, t in enumerate(times):
                out.writestr(zipfile.ZipInfo(f"d/e{i}.bin", t), b"abc" * i)
    _put(tmp_path, "broken.zip", b"PK nothing")
    archives = trees.listed(spark, str(tmp_path)).select("path")
    entries = trees.zip_directory(archives, str(tmp_path))
    assert {(r.path, r.entry, r.size, r.crc32, r.modified) for r in entries.where("path = 'mixed.zip'").collect()} == {
        ("mixed.zip", "d/e0.bin", 0, "00000000", "1996-12-24 23:32:00"), ("mixed.zip", "d/e1.bin", 3, f"{zlib.crc32(b'abc'):08X}", "2001-02-03 04:05:06")
    }
    assert {tuple(r) for r in trees.stamped(archives, entries).collect()} == {("fixed.zip", True), ("mixed.zip", False), ("none.zip", True), ("broken.zip", None)}


PIECE = 1 << 14


SIZES = {"t0": [0, 10, 0, PIECE - 10, 3, PIECE * 2, 1, 1, 0], "t1": [PIECE], "t2": [1] * 300, "t3": [PIECE * 3 + 7, 5], "t4": [0]}


def test_pieces_are_those_of_the_joined_bytes(spark, tmp_path):
    contents = {(t, f"{i:03}/f"): BODY[i * 100 : i * 100 + n] for t, sizes in SIZES.items() for i, n in enumerate(sizes)} | {("u", ""): b"abc"}
    for (t, path), content in contents.items():
        _put(tmp_path, f"{t}/{path}".rstrip("/"), content)
    whole = {t: b"".join(contents[k] for k in sorted(contents) if k[0] == t) for t in (*SIZES, "u")}
    want = {(t, i // PIECE): hashlib.sha1(w[i : i + PIECE]).hexdigest() for t, w in whole.items() for i in range(0, len(w), PIECE)}
    rows = [(t, p, len(c), bytearray(c)) for (t, p), c in contents.items()]
    own = torrents.placed(spark.createDataFrame(rows, "torrent string, path string, length long, content binary").repartition(4))
    held = torrents.pieces_of_contents(own)
    as_dict = lambda df, key="torrent": {(r[key], r.piece): r.sha1 for r in df.collect()}
    assert as_dict(held) == want
    on_disk = own.drop("content").withColumn("path", F.rtrim(F.concat_ws("/", "torrent", "path"), F.lit("/")))
    assert as_dict(torrents.pieces_of_files(on_disk, str(tmp_path), share=PIECE)) == want
    made = torrents.metadata(own.drop("content"), held, ("udp://a", "udp://é"), "note", private=True).withColumnRenamed("torrent", "path")
    parsed = {r.source: r for r in torrents.read(made).collect()}
    assert {s: (r.name, r.info_hash, r.private, r.error) for s, r in parsed.items()} == {r.path: (r.path, r.info_hash, True, None) for r in made.collect()}
    assert {s: [(f.path, f.length) for f in r.files] for s, r in parsed.items()} == {t: [(p, len(contents[k, p])) for k, p in sorted(contents) if k == t] for t in whole}
    stated = torrents.stated_pieces(torrents.read(made))
    assert as_dict(stated, "source") == want and torrents.bad_pieces(stated, held).count() == 0
    with open(tmp_path / "t3" / "000/f", "r+b") as out:
        out.seek(PIECE + 1)
        out.write(bytes([contents["t3", "000/f"][PIECE + 1] ^ 1]))
    (tmp_path / "t1" / "000/f").unlink()
    assert {tuple(r) for r in torrents.bad_pieces(stated, torrents.pieces_of_files(on_disk, str(tmp_path))).collect()} == {("t3", 1), ("t1", 0)}


def test_metadata_as_bytes(spark):
    own = torrents.placed(spark.createDataFrame([("n", "a/é", 2, bytearray(b"hi")), ("s", "", 1, bytearray(b"x"))], "torrent string, path string, length long, content binary"))
    made = {r.torrent: r for r in torrents.metadata(own, torrents.pieces_of_contents(own), ("udp://t",), made_by="me").collect()}
    raw = lambda b: hashlib.sha1(b).digest()
    info = b"d5:filesld6:lengthi2e4:pathl1:a2:" + "é".encode() + b"eee4:name1:n12:piece lengthi16384e6:pieces20:" + raw(b"hi") + b"e"
    assert bytes(made["n"].content) == b"d8:announce7:udp://t10:created by2:me4:info" + info + b"e" and made["n"].info_hash == hashlib.sha1(info).hexdigest()
    assert b"4:infod6:lengthi1e4:name1:s12:piece lengthi16384e6:pieces20:" + raw(b"x") + b"ee" in bytes(made["s"].content)


def test_what_is_no_torrent_is_told_and_sizes_are_checked(spark):
    bad = [("a", bytearray(b"")), ("b", bytearray(b"d4:infoi1ee")), ("c", bytearray(b"d4:infod4:name9:x")), ("d", bytearray(b"l" * 5000)), ("e", None)]
    rows = torrents.read(spark.createDataFrame(bad, "path string, content binary")).collect()
    assert len(rows) == 5 and all(r.error.startswith("no torrent") for r in rows)
    wanted = spark.createDataFrame([("t", "x", 1), ("t", "y", 2), ("t", "z", 3), ("t", "w", 0)], "source string, path string, length long")
    checked = torrents.check(wanted, spark.createDataFrame([("x", 1), ("y", 9), ("w", 0)], "path string, size long"))
    assert {r.path: r.state for r in checked.collect()} == {"x": "found", "y": "wrong size", "z": "missing", "w": "found"}
    assert tuple(torrents.report(checked).first()) == ("t", 4, 2, 1, 1, 50)
    for piece in (1000, 3 << 14):
        with pytest.raises(ValueError, match="power of two"):
            torrents.placed(wanted.withColumnRenamed("source", "torrent"), piece)
