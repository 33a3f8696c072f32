"""The planner and imports on small inputs: what becomes of duplicates, staged archives, shared files and disks."""

from __future__ import annotations

import pytest

from holdfast.operators import imports, planner

HELD = "coll string, game string, rom string, is_disk boolean, sha1 string, size long, root string, disposition string, path string, archive_path string"
LIB = "/lib"


@pytest.fixture(scope="module")
def plan(spark):
    """Operations (kind, source, dest) and games by name, of rows (game, rom, is_disk, sha1, root, disposition, path, archive_path)."""

    def make(form, rows, shared=(), at=()):
        held = spark.createDataFrame([("c", g, r, d, s, 10, *place) for g, r, d, s, *place in rows], HELD)
        goals = spark.createDataFrame([("c", "C", "Set/C", "/lib/Set/C", form)], "coll string, name string, node_path string, dest_root string, format string")
        wanted = planner.wanted(held, goals, spark.createDataFrame([(s,) for s in shared], "sha1 string"))
        files, _ = planner.plan_files(wanted, LIB)
        shared_at = spark.createDataFrame([(a,) for a in at], "at string")
        games = planner.games(wanted, shared_at)
        ops = files.unionByName(planner.plan_archives(wanted, games, shared_at, LIB))
        drains = {r.container: [e.container_entry for e in r.entries] for r in planner.drains(wanted, games, goals).collect()}
        return {(r.kind, r.source, r.dest) for r in ops.collect()}, {r.game: r for r in games.collect()}, drains

    return make


LIBRARY, STAGE = ("/lib/Set", "preserve"), ("/stage", "consume")


def test_loose_duplicate_goes_and_the_right_copy_stays(plan):
    ops, _, _ = plan("loose", [("G", "g.bin", False, "a", *LIBRARY, "C/g.bin", None), ("G", "g.bin", False, "a", *STAGE, "x.bin", None), ("G", "g.bin", False, "a", *STAGE, "y.zip", "g")])
    assert ops == {("delete", "/stage/x.bin", "/lib/Set/C/g.bin")}


def test_loose_files_move_only_if_they_may(plan):
    one = lambda disposition, root, shared=(): plan("loose", [("G", "a", False, "s", root, disposition, "p", None), ("G", "b", False, "t", root, disposition, "q", None)], shared)[0]
    assert one("consume", "/stage") == {("move", "/stage/p", "/lib/Set/C/G/a"), ("move", "/stage/q", "/lib/Set/C/G/b")}
    assert one("preserve", "/other") == {("copy", "/other/p", "/lib/Set/C/G/a"), ("copy", "/other/q", "/lib/Set/C/G/b")}
    assert one("preserve", "/lib") == {("move", "/lib/p", "/lib/Set/C/G/a"), ("move", "/lib/q", "/lib/Set/C/G/b")}
    assert ("copy", "/stage/p", "/lib/Set/C/G/a") in one("consume", "/stage", ["s"])


STAGED = [("G", "a", False, "s", *STAGE, "old.zip", "a1"), ("G", "b", False, "t", *STAGE, "old.zip", "b1")]


def test_complete_staged_archive_is_relocated(plan):
    ops, games, _ = plan("zip", [*STAGED, ("G", "a", False, "s", *STAGE, "part.zip", "a")])
    assert ops == {("relocate", "/stage/old.zip", "/lib/Set/C/G.zip"), ("delete", "/stage/part.zip", "/lib/Set/C/G.zip")}
    assert games["G"].size == 20


def test_torrentzip_and_foreign_formats_are_packed_again(plan):
    for form in ("torrentzip", "7z"):
        ops, games, drains = plan(form, STAGED)
        assert {k for k, _, _ in ops} == {"repack"} and games["G"].move_sources
        assert drains == {"/stage/old.zip": ["a1", "b1"]}


def test_shared_container_is_packed_for_each_game(plan):
    rows = [*STAGED, ("H", "h", False, "u", *STAGE, "old.zip", "h1")]
    ops, games, drains = plan("zip", rows, at=["/stage/old.zip"])
    assert ops == {("repack", "/stage/old.zip", "/lib/Set/C/G.zip"), ("repack", "/stage/old.zip", "/lib/Set/C/H.zip")}
    assert drains == {"/stage/old.zip": ["a1", "b1", "h1"]}


def test_right_archive_stays_and_shared_content_is_never_taken(plan):
    home = [("G", "a", False, "s", *LIBRARY, "C/G.zip", "a"), ("G", "b", False, "t", *LIBRARY, "C/G.zip", "b")]
    ops, games, _ = plan("zip", [*home, *STAGED])
    assert ops == {("delete", "/stage/old.zip", "/lib/Set/C/G.zip")} and games["G"].action == "correct"
    assert plan("zip", [*home, *STAGED], shared=["s"])[0] == set()
    ops, games, drains = plan("zip", STAGED, shared=["s"])
    assert ops == {("repack", "/stage/old.zip", "/lib/Set/C/G.zip")} and not games["G"].move_sources


def test_scattered_entries_are_gathered(plan):
    ops, games, drains = plan("zip", [("G", "a", False, "s", *STAGE, "1.zip", "a"), ("G", "b", False, "t", *STAGE, "b.bin", None)])
    assert ("repack", None, "/lib/Set/C/G.zip") in ops and games["G"].build_from is None and games["G"].n_sources == 2 and drains == {}


def test_disks_are_loose_in_the_folder_of_their_game(plan):
    ops, games, _ = plan("zip", [("G", "d", True, "s", *STAGE, "d.chd", None)])
    assert ops == {("move", "/stage/d.chd", "/lib/Set/C/G/d.chd")} and games == {}


def test_import_adds_versions_and_entries_once(spark):
    frame = spark.createDataFrame
    heads = frame([("1.dat", "Old", "v2", None, None), ("2.dat", "New", None, "Folder", None), ("3.dat", "Old", "v1", None, None), ("4.dat", None, None, None, "broken"), ("5.dat", "New", None, None, None)], "path string, name string, version string, under string, error string")
    collections = frame([("c", "Old", "Old")], "coll string, name string, node_path string")
    versions = frame([("c", "v1", True, 3)], "coll string, version string, is_active boolean, imported_seq long")
    games = frame([("c", "v1", "g", None, False, False, False)], "coll string, version string, game string, parent_name string, is_bios boolean, is_device boolean, is_mechanical boolean")
    roms = frame([("c", "v1", "g", "r", 1, "a", None, None, "good", None, False)], "coll string, version string, game string, rom string, size long, sha1 string, md5 string, crc32 string, status string, merge_tag string, is_disk boolean")
    entry = lambda at, path, game, rom, parent=None, sha1="s": (path, game, f"told at {at}", parent, False, False, False, rom, 1, None, None, sha1, "good", None, False, (0, at, 0))
    listed = [entry(3, "1.dat", "g", "r", "par1"), entry(5, "1.dat", "g", "r", "a parent", "other"), entry(9, "1.dat", "g", "q", "par3"), entry(1, "2.dat", "n", "r"), entry(0, "2.dat", "alone", None), entry(1, "3.dat", "no", "no")]
    entries = frame(listed[::-1], "path string, game string, description string, parent_name string, is_bios boolean, is_device boolean, is_mechanical boolean, rom string, size long, crc32 string, md5 string, sha1 string, status string, merge_tag string, is_disk boolean, ordinal struct<block:bigint,row:bigint,part:int>")
    judged = imports.judge(heads, collections, versions, "20260101")
    assert {r.path: r.state for r in judged.collect()} == {"1.dat": "added", "2.dat": "added", "3.dat": "skipped", "4.dat": "failed", "5.dat": "skipped"}
    c, v, g, r = imports.apply(judged, collections, versions, games, roms, entries)
    assert {tuple(x) for x in c.collect()} == {("c", "Old", "Old"), ("New", "New", "Folder")}
    assert {tuple(x)[:3] for x in v.collect()} == {("c", "v1", False), ("c", "v2", True), ("New", "20260101", True)}
    assert sorted((x.coll, x.version, x.game) for x in g.collect()) == [("New", "20260101", "alone"), ("New", "20260101", "n"), ("c", "v1", "g"), ("c", "v2", "g")]
    assert [(x.description, x.parent_name) for x in g.collect() if x.version == "v2"] == [("told at 3", "par1")]
    assert {(x.rom, x.sha1) for x in r.collect() if x.version == "v2"} == {("r", "s"), ("q", "s")}
    assert sorted((x.version, x.rom) for x in r.collect()) == [("20260101", "r"), ("v1", "r"), ("v2", "q"), ("v2", "r")]
    upgrade = imports.judge(heads, collections, versions, "20260101", upgrade=True)
    assert {r.path: r.error for r in upgrade.collect()} == {"1.dat": None, "2.dat": "no such collection", "3.dat": None, "4.dat": "broken", "5.dat": "no such collection"}


def test_folders_outside_the_source_are_refused(spark):
    places = spark.createDataFrame([("a/b",), ("ab",)], "path string")
    assert [r.path for r in imports.below(places, "a").collect()] == ["a/b"]
    for bad in ("/a", "a/../b"):
        with pytest.raises(ValueError, match="inside the source"):
            imports.below(places, bad)


def test_entries_and_places_of_one_content_stay_apart(spark):
    """F1-F8, F13-F20: 3,000 games that ask for one content, in 3,000 places, are planned without their 9,000,000 pairs."""
    entries = spark.range(3000).selectExpr("'c' as coll", "concat('G', id) as game", "'r' as rom", "false as is_disk", "'s' as sha1", "10L as size")
    places = spark.range(3000).selectExpr("'s' as sha1", "'/stage' as root", "'consume' as disposition", "concat('p', lpad(id, 4, '0'), '.zip') as path", "'e' as archive_path")
    goals = spark.createDataFrame([("c", "C", "Set/C", "/lib/Set/C", "zip")], "coll string, name string, node_path string, dest_root string, format string")
    held = planner.held_at(entries, places)
    rows = planner.wanted(held, goals, spark.createDataFrame([("s",)], "sha1 string"))
    shared = planner.shared_containers(held)
    assert shared.count() == 3000
    games = planner.games(rows, shared)
    assert games.where("build_from = '/stage/p0000.zip' and action = 'repack' and n_sources = 1 and shared").count() == 3000
    assert planner.plan_archives(rows, games, shared, LIB).count() == 3000
