"""Every registered catalogue query against its SQL on DuckDB, and operators without SQL on small inputs."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from holdfast import projection, snapshots
from holdfast.functions import names, scalars
from holdfast.operators import merges, reports, versions
from holdfast.plans import queries
from holdfast.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    own = duckdb.connect()
    for t in ("documents", "labels", "lineitem"):
        own.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return own


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), Counter(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    want = oracle.execute(ORACLES[name])
    assert _rows(got.columns, map(tuple, got.collect())) == _rows([c[0] for c in want.description], want.fetchall())


NAMES = {
    "Tetris (USA, Europe)": ("Tetris", ["USA", "Europe"], None, False, False, True),
    "Game Name (1990)(Publisher)(US-EU)": ("Game Name", ["USA", "Europe"], None, False, False, True),
    "Mario (Japan) (Rev A) [cr Razor]": ("Mario", ["Japan"], "Rev A", False, False, False),
    "Zelda (Europe) (Beta) [!]": ("Zelda", ["Europe"], None, True, True, True),
    "Plain": ("Plain", [], None, False, False, True),
}


def test_names(spark):
    got = names.with_parsed_name(spark.createDataFrame([(n,) for n in NAMES], "name string"), "name")
    assert {r.name: (r.title, r.regions, r.revision, r.is_prerelease, r.verified, r.is_original) for r in got.collect()} == NAMES


@pytest.mark.parametrize(
    ("given", "best"),
    [(["A (Europe)", "A (USA)", "A (Japan)"], "A (USA)"), (["A (USA) [cr]", "A (Europe)"], "A (Europe)"), (["A (USA)", "A (Japan) [!]"], "A (Japan) [!]"), (["A (USA) (Beta)"], None), (["A (USA) (Rev A)", "A (USA)"], "A (USA)")],
)
def test_preferred_variant(spark, given, best):
    rows = names.prefer(spark.createDataFrame([("c", n) for n in given], "coll string, name string"), ["coll"], "name").collect()
    assert [r.name for r in rows] == ([best] if best else [])


def test_upserts(spark):
    old = spark.createDataFrame([("a", None, "m1", None, 5)], "sha1 string, sha1_no_header string, md5 string, crc32 string, size long")
    new = spark.createDataFrame([("a", "h", None, None, 9, 1), ("a", None, "m2", "c", 9, 2), ("b", None, None, None, 3, 3)], "sha1 string, sha1_no_header string, md5 string, crc32 string, size long, seq long")
    assert {tuple(r) for r in merges.upsert_files(old, new, "seq").collect()} == {("a", "h", "m2", "c", 5), ("b", None, None, None, 3)}
    places = spark.createDataFrame([("s", "p", None, "x", 1)], "source string, path string, archive_path string, sha1 string, last_seen long")
    seen = spark.createDataFrame([("s", "p", None, "y", 2, 1), ("s", "p", "e", "z", 2, 2)], "source string, path string, archive_path string, sha1 string, last_seen long, seq long")
    assert {tuple(r) for r in merges.upsert_locations(places, seen, "seq").collect()} == {("s", "p", None, "y", 2), ("s", "p", "e", "z", 2)}


def test_relink_and_repair(spark):
    found = spark.createDataFrame([("/a/x.dat",), ("/b/y.dat",), ("/c/y.dat",)], "path string")
    got = versions.relink(spark.createDataFrame([("x.dat",), ("y.dat",), ("z.dat",)], "file string"), found)
    assert {tuple(r) for r in got.collect()} == {("x.dat", "relinked", "/a/x.dat"), ("y.dat", "ambiguous", None), ("z.dat", "missing", None)}


def test_prunable_folders(spark):
    kept = spark.createDataFrame([("a/b/file.bin",), ("c/.DS_Store",)], "path string")
    dirs = spark.createDataFrame([("a",), ("a/b",), ("c",), ("d",)], "dir string")
    assert {r.dir for r in reports.prunable_dirs(kept, dirs).collect()} == {"c", "d"}


def test_doctor_counts_faults(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = reports.doctor(
        frame([("c", "n", "p"), ("d", "m", "p")], "coll string, name string, node_path string"),
        frame([("c", "v1", True), ("c", "v2", True), ("d", "v1", False)], "coll string, version string, is_active boolean"),
        frame([("c", "v1", "g"), ("x", "v1", "g")], "coll string, version string, game string"),
        frame([("c", "v1", "none", "r")], "coll string, version string, game string, rom string"),
        frame([("s1",)], "sha1 string"),
        frame([("s1", "here"), ("s2", "gone")], "sha1 string, source string"),
        frame([("here",)], "source string"),
    )
    assert {r["check"]: r.faults for r in got.collect()} == dict(no_active_version=1, several_active_versions=1, games_without_version=1, roms_without_game=1, places_without_content=1, places_without_source=1, shared_destinations=1)


def test_small_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(scalars.dest_path(F.lit("/roms/nes/"), F.lit("Mario"), F.lit("mario.nes"), F.lit(False))) == "/roms/nes/mario.nes"
    assert value(scalars.dest_path(F.lit("/roms/nes"), F.lit("Multi"), F.lit("d1.img"), F.lit(True))) == "/roms/nes/Multi/d1.img"
    assert value(scalars.under(F.lit("/lib/ROMs/x"), F.lit("/lib/ROMs/"))) and not value(scalars.under(F.lit("/lib/ROMsX"), F.lit("/lib/ROMs")))
    assert value(scalars.le_bytes(F.lit(258).cast("long"))) == (258).to_bytes(8, "little")
    assert value(scalars.shortened(F.lit("abcdefghij"), 6)) == "...hij"
    sizes = {1152: "1.12 KB", 1664: "1.62 KB", 1157: "1.13 KB", 1023: "1023 bytes", 5 << 19: "2.50 MB", (1 << 30) + (1 << 23): "1.01 GB"}
    assert {n: value(scalars.bytes_text(F.lit(n).cast("long"))) for n in sizes} == sizes
    assert value(scalars.bar(F.lit(5), F.lit(10), 4)) == "##--"


def _sent_unasked(monkeypatch, spark, name):
    """Joins of a query, and of the tables it writes on the way, that Spark makes by broadcasting although the code asks for none."""
    plans, write = [], snapshots.snapshot

    def seen(df):
        run = df._jdf.queryExecution()
        said = run.optimizedPlan().toString().count("strategy=broadcast")
        plans.append(run.executedPlan().toString().count("BroadcastHashJoin") - said)
        return df

    for module in (snapshots, projection, queries):
        monkeypatch.setattr(module, "snapshot", lambda df: write(seen(df)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        seen(QUERIES[name](spark, DATA.replace("0.01", "0.001")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plans


@pytest.mark.parametrize("name", ["l10_desired_paths", "l11_superseded", "l5_plan_archives", "l6_repack_sizes", "l7_duplicate_archives", "l8_drains"])
def test_no_relation_that_grows_is_broadcast_for_its_small_file(monkeypatch, spark, name):
    """F2-F7: files of sf0.001 look small, as compressed ones of a large catalogue do; only rows by collection and source may be sent to all."""
    assert max(_sent_unasked(monkeypatch, spark, name)) <= 0


@pytest.mark.parametrize("name", ["a10_pending_by_set", "a12_operations_by_kind", "l14_operation_ids", "l1_plan_per_collection", "a11_pending_work"])
def test_no_table_on_the_way_has_the_pairs_of_entries_and_places(monkeypatch, spark, tmp_path, name):
    """F15-F19: 400 documents of one text are entries and places of one content, each a few hundred."""
    spark.range(400).selectExpr("id as doc_id", "'the same text in all of them' as text", "if(id % 8 < 4, 'de', 'en') as lang", "concat('src', id % 3) as source", "29L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    write, rows = snapshots.snapshot, []

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    for module in (snapshots, projection, queries):
        monkeypatch.setattr(module, "snapshot", counted)
    QUERIES[name](spark, str(tmp_path)).collect()
    assert rows and max(rows) < 2000


def test_of_rows_with_one_line_number_the_first_listed_stays(spark, tmp_path):
    """Spark reads the larger, second file first; the SQL on one thread takes rows in the order of files and places. A null line number is the last."""
    folder, own = tmp_path / "lineitem.parquet", duckdb.connect()
    folder.mkdir()
    own.execute("set threads = 1")
    row = "select {key} as l_orderkey, {key} as l_suppkey, ({line})::int as l_linenumber, {quantity} as l_quantity from range({n}) t(i)"
    small = row.format(key="i", line="if(i % 2 = 0, 1, null)", quantity="i::double", n=6)
    large = row.format(key="i % 1000", line="1 + i % 3", quantity="(1000 + i)::double", n=20000)
    for k, rows in enumerate((small, large)):
        own.execute(f"copy ({rows}) to '{folder}/part-{k}.parquet' (format parquet)")
    own.execute(f"create view lineitem as select * from '{folder}/*.parquet'")
    got, want = QUERIES["w1_keep_first"](spark, str(tmp_path)), own.execute(ORACLES["w1_keep_first"])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    assert {0: 0.0, 1: 3001.0, 2: 2.0}.items() <= {r[0]: r[3] for r in rows}.items()
    assert got.columns == columns and Counter(map(tuple, got.collect())) == Counter(rows)
