from __future__ import annotations

import hashlib
import io
from collections import Counter
from pathlib import Path

import pytest
import zstandard

from holdfast.llm import queries, warc

SCHEMA = "page_id long, url string, html string, key string, n long, payload string, kept string, file string"
BIG, OTHER = "<p>é</p>" * 200, "x" * 1000
ROWS = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (None, "http://a/n", BIG), (2, "http://a b\r\nX: y/2", "short"), (4, "u", "short"), (6, "u", None), (7, None, None), (8, "u", ""),
    (9, "u", OTHER), (9, "u", OTHER), (10, "u", OTHER[:-1]), (11, "u", OTHER[:-1]), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (12, "u", "HTTP\r\n\r\nWARC/1.1\r\n\r\n" * 90), (-4, "u", "\x00\x7f" * 700), (13, "u", "long " * 400_000),
]


def plainly(rows, least=1000):
    """page_id, bytes, digest, type and the id referred to of each row."""
    best: dict[bytes, int] = {}
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, p in data:
        if len(p) >= least and i is not None:
            best[p] = max(i, best.get(p, i))
    kept = lambda i, p: best[p] if p in best and best[p] != i else None
    return Counter((i, len(p), hashlib.sha1(p).hexdigest(), "response" if kept(i, p) is None else "revisit", kept(i, p)) for i, p in data)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame([(*r, "k", 7, "p", "q", "f") for r in ROWS], SCHEMA).repartition(3)
    warc.write(pages, folder, frame_bytes=3000, bundle_bytes=5000)
    return folder


def test_records_read_back(spark, archive):
    got = warc.read(spark, archive).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plainly(ROWS)
    first = Counter((i, (h or "").encode()) for i, _, h in ROWS if h != BIG or i == 5)
    assert Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response") == first
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.target_uri for r in got if r.page_id == 2} == {"http://a%20b%0D%0AX:%20y/2"} and {r.target_uri for r in got if r.page_id == 7} == {None}


def test_bundles_are_plain_archives_in_independent_frames(spark, archive):
    names, n = [r.file for r in warc.index(spark, archive).select("file").distinct().collect()], 0
    assert len(names) > 3 and {p.name for p in Path(archive, "archives").iterdir()} == set(names)
    for name in names:
        raw = Path(archive, "archives", name).read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        with warc._open(archive, name) as source:
            frames = warc.seek_table(source)
        assert b"".join(zstandard.ZstdDecompressor().decompress(raw[at : at + size]) for at, size, _ in frames) == whole
        assert [len(zstandard.ZstdDecompressor().decompress(raw[at : at + size])) for at, size, _ in frames] == [plain for _, _, plain in frames]
        at = 0
        while at < len(whole):
            head = whole[at : whole.index(b"\r\n\r\n", at)]
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            at += len(head) + 8 + int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length")).split(b":")[1])
            n += 1
        assert at == len(whole)
    assert n == len(ROWS)


def test_index_leads_to_records(spark, archive):
    wanted = spark.createDataFrame([(5,), (3,), (9,), (9,), (99,), (13,)], "page_id long")
    got = Counter((r.page_id, r.record_type, None if r.payload is None else len(r.payload)) for r in warc.lookup(spark, archive, wanted).collect())
    assert got == {(5, "response", len(BIG.encode())): 1, (3, "revisit", None): 1, (9, "response", 1000): 2, (13, "response", 2_000_000): 1}


def test_damage_is_told(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "a" * 50)], "page_id long, url string, html string"), str(tmp_path))
    at = next(Path(tmp_path, "archives").iterdir())
    good = zstandard.ZstdDecompressor().decompress(at.read_bytes())
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(good.replace(b"aaaa\r\n", b"aaab\r\n"), 0, True)
    assert warc.parse(good, 0, True)[1] == len(good)
    at.write_bytes(at.read_bytes()[:-1] + b"\x00")
    with pytest.raises(ValueError, match="no seek table"), warc._open(str(tmp_path), at.name) as source:
        warc.seek_table(source)


def test_empty_table_and_a_hot_payload(spark, tmp_path):
    none = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], SCHEMA), none)
    assert warc.read(spark, none).collect() == [] and warc.lookup(spark, none, spark.range(3), "id").collect() == []
    rows = [(i, "u", BIG if i % 3 else f"{i} " * 600) for i in range(3000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "hot"))
    got = warc.read(spark, str(tmp_path / "hot"), payloads=False).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plainly(rows)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.01"
    own = duckdb.connect()
    own.execute(f"create view pages as select * from '{at}/pages.parquet'")
    got = queries.op12_web_archives(spark, at)
    want = own.execute(queries.ORACLES["op12_web_archives"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
