"""Manifests and files of a temporary folder."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from holdfast.operators import archives, imports
from holdfast.sources import files, manifests, trees

XML = """<?xml version="1.0"?>
<!DOCTYPE datafile SYSTEM "x.dtd">
<datafile><header><name>Sys &amp; Co</name><description> D </description><version>20231215</version><author>No-Intro</author><category> Games </category></header>
<game name="A" isbios="yes"><description>Game A</description><rom name="a.bin" size="16" crc="deadbeef" md5="aa" sha1="bb" status="nodump"/><disk name="d" sha1="cc"/></game>
<machine name="B" cloneof="A" romof="base"><description>B</description><rom name="b.bin" size="many" merge="a.bin"></rom><device_ref name="z"/></machine>
</datafile>"""
BLOCK = """clrmamepro ( name "Old ( Set )" version 7 url here )
# a note ( not a block
game ( name "G \\"1\\"" description "G" rom ( name g.bin size 4 crc32 0a0b0c0d flags baddump ) disk ( name no ) )
resource ( name R rom ( size 5 ) rom ( name r.bin sha1 ab ) )
game ( description nameless rom ( name x ) )"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.xml").write_text(XML)
    (tmp_path / "sub" / "two.DAT").write_text(BLOCK)
    (tmp_path / "sub" / "broken.dat").write_text("game ( name X rom ( name y )")
    (tmp_path / "sub" / "other.txt").write_text(BLOCK)
    return tmp_path


def test_entries_of_both_formats(spark, folder):
    got = {(r.game, r.rom): r for r in manifests.entries(spark, str(folder)).collect()}
    assert set(got) == {("A", "a.bin"), ("A", "d"), ("B", "b.bin"), ('G "1"', "g.bin"), ("R", "r.bin")}
    a, d, b, g = got["A", "a.bin"], got["A", "d"], got["B", "b.bin"], got['G "1"', "g.bin"]
    assert (a.size, a.crc32, a.md5, a.sha1, a.status, a.is_bios, a.is_disk) == (16, "DEADBEEF", "AA", "BB", "nodump", True, False)
    assert (d.size, d.sha1, d.crc32, d.is_disk) == (0, "CC", None, True)
    assert (b.rom_of, a.rom_of) == ("base", None)
    assert (b.size, b.parent_name, b.merge_tag, b.status) == (0, "A", "a.bin", "good")
    assert (g.size, g.crc32, g.status) == (4, "0A0B0C0D", "baddump")


def test_headers_and_faults(spark, folder):
    found = manifests.headers(spark, str(folder))
    rows = found.withColumns({"under": manifests.hierarchy(F.col("path"), str(folder)), "kind": manifests.source_type(F.col("name"), F.col("author"), F.col("homepage"))}).collect()
    got = {r.path.rsplit("/", 1)[1]: r for r in rows}
    assert (got["one.xml"].name, got["one.xml"].description, got["one.xml"].version, got["one.xml"].under, got["one.xml"].kind) == ("Sys & Co", "D", "20231215", None, "nointro")
    assert (got["one.xml"].category, got["two.DAT"].category) == ("Games", None)
    assert (got["two.DAT"].name, got["two.DAT"].homepage, got["two.DAT"].under, got["two.DAT"].kind) == ("Old ( Set )", "here", "sub", "custom")
    assert got["broken.dat"].error == "a block does not end"


TWICE = {
    "x.xml": """<datafile><header><name>X</name></header><game name="G"><description>first</description><rom name="a.bin" sha1="z1"/></game><game name="none"><description>alone</description></game>
<game name="G" cloneof="P"><description>a second</description><rom name="b.bin" sha1="y"/><rom name="a.bin" sha1="a2"/><rom name="b.bin" sha1="b2"/></game></datafile>""",
    "y.dat": """clrmamepro ( name Y )
game ( name G description first rom ( name a.bin sha1 z1 ) ) game ( name none description alone )
game ( name G cloneof P description "a second" rom ( name b.bin sha1 y ) rom ( name a.bin sha1 a2 ) rom ( name b.bin sha1 b2 ) )""",
}


def test_listings_again_keep_the_first_by_position(spark, tmp_path):
    for name, text in TWICE.items():
        (tmp_path / name).write_text(text)
    frame = spark.createDataFrame
    heads = manifests.headers(spark, str(tmp_path)).withColumn("under", F.lit(None).cast("string"))
    collections, versions = frame([], "coll string, name string, node_path string"), frame([], "coll string, version string, is_active boolean, imported_seq long")
    games = frame([], "coll string, version string, game string, parent_name string, is_bios boolean, is_device boolean, is_mechanical boolean")
    roms = frame([], "coll string, version string, game string, rom string, size long, sha1 string, md5 string, crc32 string, status string, merge_tag string, is_disk boolean")
    judged = imports.judge(heads, collections, versions, "1")
    _, _, g, r = imports.apply(judged, collections, versions, games, roms, manifests.entries(spark, str(tmp_path)))
    for coll in ("X", "Y"):
        assert {(x.game, x.description, x.parent_name) for x in g.collect() if x.coll == coll} == {("G", "first", None), ("none", "alone", None)}
        assert {(x.game, x.rom, x.sha1) for x in r.collect() if x.coll == coll} == {("G", "a.bin", "Z1"), ("G", "b.bin", "Y")}


def test_position_holds_in_large_files(spark, tmp_path):
    for n in range(3):
        each = "".join(f'<game name="G{i % 50}"><description>told {i}</description><rom name="r.bin" size="{i}"/></game>\n' for i in range(n, 5_000))
        (tmp_path / f"big{n}.xml").write_text(f"<datafile><header><name>B</name></header>{each}</datafile>")
    first = manifests.entries(spark, str(tmp_path)).groupBy("path", "game").agg(F.min_by("size", "ordinal").alias("size"))
    assert {(r.path[-5], r.game, r.size) for r in first.collect()} == {(str(n), f"G{i % 50}", i) for n in range(3) for i in range(n, n + 50)}


def test_dump_of_many_statements(spark, tmp_path):
    md5 = "0123456789abcdef0123456789abcdef"
    text = "".join(f"INSERT INTO `downloads` (`a`, `b`) VALUES {','.join(f'({i},NULL,3,{chr(39)}/d/f{i}-{j}.zip{chr(39)}, 4 ,{j},{chr(39)}{md5}{chr(39)})' for j in range(20))};\n" for i in range(300))
    (tmp_path / "d.sql").write_text("-- (a note)\nCREATE TABLE `downloads` (x int);\n" + text + f"INSERT INTO `downloads` VALUES (1,2,3,'{'s' * 100_000}x',4,,'{md5}');\n")
    got = manifests.dump_entries(spark, str(tmp_path / "d.sql")).orderBy("ordinal").collect()
    assert len(got) == 6001 and [r.rom for r in got[:21]] == [f"f0-{j}.zip" for j in range(20)] + ["f1-0.zip"] and got[5].size == 5
    assert len(got[-1].rom) == 100_001 and got[-1].size == 0


def test_dump(spark, tmp_path):
    md5 = "0123456789abcdef0123456789abcdef"
    (tmp_path / "d.sql").write_text(f"INSERT INTO `other` VALUES (1,2);\nINSERT INTO `downloads` VALUES (1,2,3,'/pub/it''s (a),b.zip',4,77,'{md5}'),\n(1,2,3,'/x/',4,5,'{md5}'),(1,2,3,'/y/z',4,NULL,'none'),\n(1,2,3,'q\\'r',4,NULL,'{md5}',8);\n")
    got = {tuple(r)[1:-1] for r in manifests.dump_entries(spark, str(tmp_path / "d.sql")).collect()}
    assert got == {("pub/it's (a),b.zip", "it's (a),b.zip", 77, md5.upper()), ("q'r", "q'r", 0, md5.upper())}


def test_hashes_headers_and_archives(spark, tmp_path):
    body = bytes(range(256)) * 2
    cases = {"a.nes": (b"NES\x1a" + bytes(12), 16), "b.a78": (b"\x01ATARI7800" + bytes(118), 128), "c.lnx": (b"LYNX" + bytes(60), 64), "plain.bin": (b"", 0)}
    for name, (head, _) in cases.items():
        (tmp_path / name).write_bytes(head + body)
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("in/e.bin", body)
        z.mkdir("folder")
    (tmp_path / "p.ZIP").write_bytes(made.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    read = files.read(spark, str(tmp_path), empty=["/none"])
    got = {r.path.rsplit("/", 1)[1]: r for r in files.hashes(read).collect()}
    sha = lambda b: hashlib.sha1(b).hexdigest().upper()
    for name, (head, skip) in cases.items():
        assert (got[name].sha1, got[name].crc32) == (sha(head + body), f"{zlib.crc32(head + body):08X}")
        assert got[name].sha1_no_header == (sha(body) if skip else None)
    assert (got["none"].size, got["none"].sha1, got["none"].md5, got["none"].crc32) == (0, "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "D41D8CD98F00B204E9800998ECF8427E", "00000000")
    listing = trees.listed(spark, str(tmp_path)).where(files.archive_kind(F.col("path")) == "zip")
    entries = {r.path: r for r in archives.entry_hashes(listing, str(tmp_path)).collect()}
    assert (entries["p.ZIP"].archive_path, entries["p.ZIP"].size, entries["p.ZIP"].sha1) == ("in/e.bin", 512, sha(body))
    assert entries["bad.zip"].sha1 is None and entries["bad.zip"].error


def test_disk_image_and_incremental(spark):
    image = b"MComprHD" + bytes(4) + b"\x00\x00\x00\x05" + bytes(68) + bytes(range(20)) + bytes(20)
    rows = spark.createDataFrame([(bytearray(image),), (bytearray(image[:100]),), (bytearray(b"X" + image[1:]),)], "content binary")
    assert [r.s for r in rows.select(files.disk_image_sha1(F.col("content")).alias("s")).collect()] == [bytes(range(20)).hex().upper(), None, None]
    listed = spark.sql("select * from values ('new', timestamp'2020-01-01'), ('same', timestamp'2020-01-01'), ('later', timestamp'2024-01-01'), ('unknown', null) t(path, modificationTime)")
    known = spark.createDataFrame([("same",), ("later",), ("unknown",)], "path string")
    assert {r.path for r in files.to_scan(listed, known, "2022-01-01").collect()} == {"new", "later", "unknown"}
    assert files.to_scan(listed, known, None).count() == 4
