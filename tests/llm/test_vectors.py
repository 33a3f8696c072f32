from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from holdfast.llm import queries, vectors


def plainly(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codebooks, codes and errors of rows (id, vector) by all distances, in Python's integers."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    best = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))
    assign = lambda: [[best(q, book) for q, book in zip(cut(v), books)] for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            near = {}
            for (_, v), f in zip(kept, found):
                near.setdefault(f[p][1], []).append(cut(v)[p])
            for e, own in near.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return books, sorted((str(i), bytes(e for _, e in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, assign()))


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_bounds_lose_no_nearest_entry(data):
    width, n = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 40))
    values = st.integers(-4, 4) if data.draw(st.booleans()) else st.integers(-(1 << 28), 1 << 28)
    entries, rows = data.draw(hnp.arrays(np.int64, (n, width), elements=values)), data.draw(hnp.arrays(np.int64, (7, width), elements=values))
    code, distance = vectors.Cells(entries, data.draw(st.integers(0, 4))).nearest(rows)
    full = ((rows[:, None].astype(object) - entries.astype(object)) ** 2).sum(2)
    assert distance.tolist() == full.min(1).tolist() and code.tolist() == [row.tolist().index(min(row)) for row in full]


def test_bounds_leave_few_entries():
    draw = np.random.default_rng(3)
    entries, rows = draw.normal(0, 128, (256, 16)).astype(np.int64), draw.normal(0, 128, (500, 16)).astype(np.int64)
    assert len(vectors.Cells(entries).candidates(rows)[0]) < 0.5 * 500 * 256


def test_codes_against_all_distances(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(0, 1, 8) + 3 * (i % 5)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(7, rows[3][1]), (7, rows[4][1]), (200, None), (201, [None] * 8), (202, [1.0] * 7 + [math.nan]), (203, [math.inf] + [0.0] * 7), (204, [-math.inf] * 8), (None, [0.5] * 8), (None, [0.5] * 8), (-5, [-0.25] * 8)]
    df = spark.createDataFrame([(i, v, i % 3 if i is not None else None, "c", 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, code string, error int, n string").repartition(4)
    for entries in (16, 256):
        books = vectors.fit(df, entries=entries, rounds=3)
        want, codes = plainly(rows, entries=entries, rounds=3)
        assert [b.tolist() for b in books] == want
        got = vectors.encode(df, books).select("vec_id", "coded.*", "label").collect()
        assert sorted((str(r.vec_id), bytes(r.code), r.error) for r in got) == codes
        total = {}
        for r in got:
            total[r.label] = total.get(r.label, 0) + r.error
        coded = vectors.encode(df, books).selectExpr("vec_id", "label", "coded.code", "coded.error")
        assert sorted((str(r.vec_id), r.label_error) for r in vectors.label_errors(coded).collect()) == sorted((str(r.vec_id), total[r.label]) for r in got)
        near = {r.vec_id: np.abs(vectors.decode(bytes(r.code), books) - np.array(v)).mean() for r in got for i, v in rows if i == r.vec_id and i not in (None, 7)}
        assert np.mean(list(near.values())) < (0.6 if entries == 16 else 0.001)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, None)], [(1, [math.nan] * 4, 2)]):
        df = spark.createDataFrame(rows, schema)
        books = vectors.fit(df)
        assert books == [] and vectors.encode(df, books).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vectors.fit(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))
    with pytest.raises(ValueError, match="different lengths"):
        vectors.fit(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], schema))
    one = spark.createDataFrame([(1, [0.3, 0.1, -0.2, 0.0], None)], schema)
    assert vectors.encode(one, vectors.fit(one)).select("coded.*").collect() == [(bytes(4), 0)]


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.01"
    own = duckdb.connect()
    own.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    got = queries.op13_vector_codes(spark, at)
    want = own.execute(queries.ORACLES["op13_vector_codes"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
