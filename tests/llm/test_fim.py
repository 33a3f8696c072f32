from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import fim, queries

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(doc_id, text, percent=50, spm=80):
    """n, form, prefix and middle length, and output, by the pattern."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x85 aé\U0001f600<PS>M", max_size=60), st.sampled_from([1, 2, 3, 1 << 16]))
def test_units_are_those_of_the_pattern(text, stride):
    units, found = UNIT.findall(text), fim.Units(text, stride)
    ends = [0]
    for u in units:
        ends.append(ends[-1] + len(u))
    assert found.n == len(units) and [found.end_of(k) for k in range(found.n + 1)] == ends
    assert found.has_sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))


TEXTS = ["a <P> b", "x<S>", "<M>", "a<", "P> <S", " lead", "trail \n", "<<S>S>", "é \U0001f600 z  end", "a  b\tc\nd e f g h", "one two three " * 50_000, " " * 300_000 + "x" + " " * 200_000]


def test_odd_texts_against_the_pattern(spark, table, odd):
    rows = [*odd, *((100 + i + 1000 * k, t) for k in range(6) for i, t in enumerate(TEXTS)), (100, TEXTS[0])]
    docs = table(rows)
    got = fim.transform(docs, to="keep").withColumn("again", fim.restore(F.col("keep.output"), F.col("keep.form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1]))
    assert sorted(((r.doc_id, r.text, *r.keep) for r in got), key=key) == sorted(((i, t, *plainly(i, t)) for i, t in rows), key=key)
    assert all(r.again == (r.text or "") and r.words == "words" for r in got)


@pytest.mark.parametrize(("percent", "spm", "forms"), [(0, 80, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_shares(spark, prose, percent, spm, forms):
    docs = spark.createDataFrame(list(enumerate(prose(40))), "doc_id long, text string")
    assert {r.form for r in fim.transform(docs, percent=percent, spm_percent=spm).select("fim.form").collect()} == forms


def test_empty_table(table):
    assert fim.transform(table([])).collect() == []


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.01"
    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{at}/documents.parquet'")
    got = queries.op11_fill_in_middle(spark, at)
    want = own.execute(queries.ORACLES["op11_fill_in_middle"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
