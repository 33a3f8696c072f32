"""Archives built from a plan's repacks, stored relations, listings and small expressions."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from holdfast.functions import scalars
from holdfast.operators import archives, merges, reports, versions
from holdfast.sources import files, trees

SHA = lambda b: hashlib.sha1(b).hexdigest().upper()
LARGE = os.urandom(3 << 20)


def test_repacks_are_carried_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/loose.bin").write_bytes(LARGE)
    with zipfile.ZipFile(tmp_path / "in/old.zip", "w") as out:
        out.writestr("x/one", b"one")
        out.writestr("two", b"")
    sources = [(0, "/in/loose.bin", None, SHA(LARGE), "B.bin"), (0, "/in/old.zip", "x/one", SHA(b"one"), "a.rom"), (0, "/in/old.zip", "two", SHA(b""), None), (0, "/in/gone", None, SHA(b"one"), "a.rom"),
               (1, "/in/old.zip", "x/one", SHA(b"other"), "a"), (2, "/in/old.zip", "none", SHA(b""), "a"), (3, "/in/loose.bin", None, SHA(LARGE), "a"), (4, "/in/loose.bin", None, SHA(LARGE), "q"), (4, "/in/old.zip", "two", SHA(b""), "q"), (5, "/in/old.zip", "two", SHA(b""), "z")]
    sources[3] = (0, "/in/old2.zip", "x/one", SHA(b"one"), "a.rom")  # a second place of the same content is not needed
    ops = [(i, "repack", f"/out/{i}.zip", form, 10) for i, form in enumerate(("torrentzip", "zip", "zip", "7z", "zip", "zip"))] + [(9, "copy", "/out/c", None, 1)]
    made = archives.build(spark.createDataFrame(ops, "op_id long, kind string, dest string, format string, size long"), spark.createDataFrame(sources, "op_id long, path string, archive_path string, sha1 string, entry_name string"), str(tmp_path))
    got = {r.op_id: r for r in made.collect()}
    assert {i: r.entries for i, r in got.items()} == {0: 3, 1: None, 2: None, 3: None, 4: None, 5: 1}
    assert got[1].error == "/in/old.zip is not what the plan states" and got[3].error == "no writer for 7z" and got[4].error == "two contents for the entry q"
    assert sorted(os.listdir(tmp_path / "out")) == ["0.zip", "5.zip"]
    listing = trees.listed(spark, str(tmp_path), "out")
    hashed = {(r.path, r.archive_path, r.size, r.sha1) for r in archives.entry_hashes(listing, str(tmp_path)).collect()}
    assert hashed == {("out/0.zip", "B.bin", len(LARGE), SHA(LARGE)), ("out/0.zip", "a.rom", 3, SHA(b"one")), ("out/0.zip", "two", 0, SHA(b"")), ("out/5.zip", "z", 0, SHA(b""))}
    assert zipfile.ZipFile(tmp_path / "out/0.zip").namelist() == ["a.rom", "B.bin", "two"] and zipfile.ZipFile(tmp_path / "out/0.zip").testzip() is None
    assert {tuple(r) for r in trees.stamped(listing, trees.zip_directory(listing, str(tmp_path))).collect()} == {("out/0.zip", True), ("out/5.zip", False)}


def test_heads_tell_disk_images(spark, tmp_path):
    image = b"MComprHD" + bytes(4) + b"\x00\x00\x00\x05" + bytes(68) + bytes(range(20)) + bytes(1 << 20)
    (tmp_path / "d.chd").write_bytes(image)
    (tmp_path / "e.chd").write_bytes(b"short")
    found = trees.heads(trees.listed(spark, str(tmp_path)), str(tmp_path)).select("path", files.disk_image_sha1(F.col("head")).alias("sha1"), F.octet_length("head").alias("n"))
    assert {tuple(r) for r in found.collect()} == {("d.chd", bytes(range(20)).hex().upper(), 124), ("e.chd", None, 5)}


def test_stored_upserts_leave_other_parts_alone(spark, tmp_path):
    at, schema = str(tmp_path / "files"), "sha1 string, sha1_no_header string, md5 string, crc32 string, size long"
    merges.stored(spark.createDataFrame([(f"s{i}", None, None, None, i) for i in range(200)], schema), at, ["sha1"], 16)
    before = {p: p.stat().st_ino for p in (tmp_path / "files").rglob("*.parquet")}
    new = spark.createDataFrame([("s7", "h", "m", None, 99, 1), ("s7", None, "m2", None, 98, 2), ("fresh", None, None, "c", 5, 3)], schema + ", seq long")
    n = merges.upsert_stored(spark, at, new, ["sha1"], lambda old, more: merges.upsert_files(old, more, "seq"), 16)
    after = {p: p.stat().st_ino for p in (tmp_path / "files").rglob("*.parquet")}
    assert n in (1, 2) and len(set(before.items()) - set(after.items())) == n
    got = {r.sha1: r for r in merges.read_stored(spark, at).collect()}
    assert len(got) == 201 and (got["s7"].sha1_no_header, got["s7"].md5, got["s7"].size) == ("h", "m2", 7) and got["fresh"].crc32 == "c"
    assert merges.upsert_stored(spark, at, new.where("false"), ["sha1"], None, 16) == 0


def test_removal_of_versions(spark):
    collections = spark.createDataFrame([("a", "A"), ("b", "B")], "coll string, name string")
    own = spark.createDataFrame([("a", "v1", False, 1), ("a", "v:2", True, 2), ("a", "v3", False, 3), ("b", "v1", True, 1)], "coll string, version string, is_active boolean, imported_seq long")

    def left(what, **options):
        c, v = versions.removed(collections, own, what, **options)
        return {r.coll for r in c.collect()}, {(r.coll, r.version): r.is_active for r in v.collect()}

    assert left("A") == ({"a", "b"}, {("a", "v1"): False, ("a", "v3"): True, ("b", "v1"): True})
    assert left("A:v1") == ({"a", "b"}, {("a", "v:2"): True, ("a", "v3"): False, ("b", "v1"): True})
    assert left("A:v:2") == ({"a", "b"}, {("a", "v1"): False, ("a", "v3"): True, ("b", "v1"): True})
    assert left("A", all_versions=True) == ({"b"}, {("b", "v1"): True}) and left("B")[0] == {"a"} and left("C")[0] == {"a", "b"}


def test_modes_kinds_and_heads(spark):
    modes = spark.createDataFrame([("NonMerged",), ("split",), (None,)], "m string").select(scalars.asked_mode(F.col("m")).alias("m"))
    assert [r.m for r in modes.collect()] == ["non-merged", "split", "non-merged"]
    with pytest.raises(Exception, match="not both"):
        spark.createDataFrame([("both",)], "m string").select(scalars.asked_mode(F.col("m"))).collect()
    assert [reports.export_kind(*a) for a in ((None, "x.CSV"), (None, "x.json"), (None, "x.dat"), (None, "x"), ("txt", "x.csv"))] == ["csv", "json", "txt", "txt", "txt"]
    rows, more = reports.head(spark.range(50), ["id"])
    assert [r.id for r in rows.collect()] == list(range(20)) and more == 30 and reports.head(spark.range(3), ["id"])[1] == 0
    with pytest.raises(ValueError, match="have or missing"):
        reports.exported(spark.range(1), "some")
