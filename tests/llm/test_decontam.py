from __future__ import annotations

import re
import time
from collections import Counter

import pytest

from holdfast.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item or "")
    out = Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out[d, len(w), len(hit), tuple(sorted(found)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_hits_against_brute_force(spark, table, odd, prose, broadcast, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", broadcast)
    texts = prose(24)
    items = [(f"i{i}", t) for i, t in enumerate(texts[:10])] + [("short", "four words stand here"), ("one", "zyzzyva"), ("i1", texts[1]), (None, texts[2]), ("none", None), ("empty", "..."), ("x", "X " * 1000), ("xy", "x y " * 40), ("twice", "again and again and again and again and again and again and again")]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    rows = odd + [(100 + i, t) for i, t in enumerate(texts[8:])]
    rows += [(300 + n, "before " + part(texts[n % 10], 3, 3 + n) + " after") for n in range(7, 16)]
    rows += [(400, "so FOUR words; stand-here ok"), (401, "a zyzzyva, a zyzzyva"), (402, "again and " * 30), (404, "y x " * 50 + "z " + "x " * 12 + "w " + "x " * 9), (403, part(texts[0], 0, 12) + " x " + part(texts[0], 5, 20)), (None, texts[3]), (400, "so FOUR words; stand-here ok")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")
    got = decontam.contamination(table(rows), benchmark)
    got = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == plain(rows, items)
    for r in got:
        ends = [-1, *(x for run in r.runs for x in (run["start"], run["stop"]))]
        assert ends == sorted(set(ends)) and r.n_hit == sum(b - a for a, b in r.runs)


def test_clean_documents_stay(spark, table, prose):
    texts = prose(6)
    docs = table([(i, t) for i, t in enumerate(texts)] + [(7, None), (None, texts[0])])
    benchmark = spark.createDataFrame([("a", " ".join(texts[0].split()[:15]))], "item_id string, text string")
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.dtypes == docs.dtypes
    assert all(r[c] == c for r in kept.collect() for c in docs.columns[3:])
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7]


def test_empty_tables(spark, table, prose):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontam.contamination(table([]), none).collect() == []
    assert [(r.n_hit, r.contaminated) for r in decontam.contamination(table([(1, prose(1)[0])]), none).collect()] == [(0, False)]


def test_repetition_costs_no_more_than_its_length(spark, table):
    docs = table([(1, "x " * 30_000), (2, "x " * 9), (3, "y x " * 15_000)])
    benchmark = spark.createDataFrame([("a", "x " * 30_000), ("b", "x y " * 20_000)], "item_id string, text string")
    begun = time.monotonic()
    got = {r.doc_id: (r.n_hit, r["items"], [tuple(x) for x in r.runs]) for r in decontam.contamination(docs, benchmark).collect()}
    assert got == {1: (30_000, ["a"], [(0, 30_000)]), 2: (0, [], []), 3: (30_000, ["b"], [(0, 30_000)])}
    assert time.monotonic() - begun < 60


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_a_long_text_full_of_hits_takes_time_in_proportion(spark, table, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", broadcast)
    text = " ".join(f"w{i}x" for i in range(60_000))
    begun = time.monotonic()
    got = decontam.contamination(table([(1, text), (2, "w1x w2x")]), spark.createDataFrame([("a", text)], "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_hit, len(r.runs)) for r in got} == {1: (60_000, 1), 2: (0, 0)} and time.monotonic() - begun < 60
