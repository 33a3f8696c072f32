from __future__ import annotations

import random
import re

import pytest

from holdfast.llm import lines


def plain_removed(rows, least=1):
    sets = []
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            words = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", line)}
            if len(words) >= least:
                sets.append(((d is None, d or 0, n), words, d, n))
    gone = set()
    for place, words, d, n in sets:
        if any(other < place and 5 * len(words & more) >= 4 * len(words | more) for other, more, _, _ in sets):
            gone.add((d, n))
    return gone


def varied(prose, n=60):
    draw, texts = random.Random(5), prose(n)
    rows = list(enumerate(texts))
    for i in range(n):
        words = draw.choice(draw.choice(texts).split("\n")).split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(["other", "changed", "new"])
        rows.append((1000 + i, "fresh start here\n" + " ".join(words).upper() + "\n" + " ".join(reversed(words))))
    return rows


@pytest.mark.parametrize("block, least", [(10_000, 1), (3, 1), (10_000, 5)])
def test_whole_texts_against_brute_force(table, prose, odd, block, least, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", block)
    rows = odd + [(100 + d, t) for d, t in varied(prose)]
    got = {(r.doc_id, r.line) for r in lines.removed_lines(table(rows), least=least).collect()}
    assert got == plain_removed(rows, least)


@pytest.mark.parametrize("square", [192, 8])
def test_many_near_copies_of_one_line(table, square, monkeypatch):
    monkeypatch.setattr(lines, "SQUARE", square)
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(base[:-1] + [f"w{i}"])) for i in range(80)] + [(500 + i, " ".join([f"a{i}", f"b{i}", f"c{i}", *base[3:]])) for i in range(40)]
    long = [f"v{i}" for i in range(90)]
    rows += [(700 + i, " ".join(long[i % 25 :] + [f"u{i % 3}_{j}" for j in range(i % 12)])) for i in range(60)]
    got = {(r.doc_id, r.line) for r in lines.removed_lines(table(rows)).collect()}
    assert got == plain_removed(rows)


def test_other_lines_and_columns_stay(table):
    copied = "this line of eight words is found twice"
    docs = table([(1, f"{copied}\nshort"), (2, f"first\n{copied}\n\nshort"), (3, copied), (4, None)])
    got = lines.dedup_lines(docs)
    assert got.dtypes == docs.dtypes
    got = got.collect()
    assert {r.doc_id: r.text for r in got} == {1: f"{copied}\nshort", 2: "first\n", 3: "", 4: None}
    assert all(r[c] == c for r in got for c in docs.columns[3:])


def test_words_of_any_length_are_told_apart(table):
    draw = random.Random(6)
    long = ["".join(draw.choices("abcdef", k=k)) for k in (127, 128, 129, 256, 257, 10_000)]
    words = [*long, *(w[1:] + w[0] for w in long), "a" * 128 + "b", "b" + "a" * 128]
    rows = [(i, f"k l m n {w}") for i, w in enumerate(words)] + [(100 + i, f"n m {w.upper()} l k") for i, w in enumerate(words)]
    got = {(r.doc_id, r.line) for r in lines.removed_lines(table(rows)).collect()}
    assert got == plain_removed(rows) == {(100 + i, 0) for i in range(len(words))}


def test_report_and_empty_table(table):
    assert lines.removed_lines(table([])).collect() == []
    assert lines.dedup_lines(table([])).collect() == []
    got = {r.doc_id: (r.n_lines, r.removed) for r in lines.line_report(table([(1, "a\nb"), (2, None), (3, "\n")])).collect()}
    assert got == {1: (2, []), 2: (1, []), 3: (2, [])}


def test_lines_beyond_a_stretch_of_one_text(table):
    first, second = "this line is at the start", "another line far behind it"
    rows = [(1, first), (2, "\n".join([second] + [""] * ((1 << 18) - 1) + [first])), (3, second + " now")]
    got = {(r.doc_id, r.line) for r in lines.removed_lines(table(rows)).collect()}
    assert got == {(2, 1 << 18), (3, 0)} == plain_removed(rows)


def test_short_lines_go_in_the_query_and_the_pipeline(table, tmp_path):
    from holdfast.llm import queries

    rows = [(1, "Read more\none two three four\na b c\n\nmenu"), (2, "read MORE\n\n  \none two three four five\na b c d"), (3, "four three two one\nmenu\na b\nmenu"), (4, "v w x y z"), (5, "z w v x")]
    docs = table(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: [], 2: [0, 3], 3: [0, 1, 3], 4: [], 5: [0]}
    assert {r.doc_id: r.removed for r in queries.op3_line_dedup(docs.sparkSession, str(tmp_path)).collect()} == want
    pipeline = pytest.importorskip("corpus_pipeline")
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}
    assert {r.doc_id: r.text for r in pipeline.line_dedup(docs.sparkSession, docs, str(tmp_path)).collect()} == left


@pytest.mark.parametrize("ids", [[1 << 43, (1 << 43) + 5, 7], [-(1 << 62), -3, (1 << 62) + 1], [1 << 42, None, 3]])
def test_far_ids_keep_their_order(table, ids):
    base = "one two three four five six seven eight nine"
    rows = [(d, f"own line of number {i} here\n{base} {w}") for i, (d, w) in enumerate(zip(ids, ("ten", "eleven", "twelve")))]
    got = {(r.doc_id, r.line) for r in lines.removed_lines(table(rows)).collect()}
    assert got == plain_removed(rows) and len(got) == 2


def test_lines_beyond_a_million_are_compared(table):
    near = "\n".join(["one two three four five six seven eight nine", "one two three four five six seven eight nine ten"])
    rows = [(1, "\n" * (1 << 20) + near)]
    assert {(r.doc_id, r.line) for r in lines.removed_lines(table(rows)).collect()} == {(1, (1 << 20) + 1)}


def test_texts_of_one_id_lose_their_own_lines_only(table):
    copied = "this line of eight words is found twice"
    texts = [f"first\nsecond\n{copied}", f"a\nb\n{copied}", "c\nd\nthis one is unlike all the others here", f"e\n{copied}"]
    for same in (None, 9):
        docs = table([(1, copied), *[(same, t) for t in texts]])
        want = [(1, copied), *[(same, t.removesuffix("\n" + copied)) for t in texts]]
        assert sorted(((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()), key=str) == sorted(want, key=str)
        want = sorted([0] + [1 if copied in t else 0 for t in texts])
        assert sorted(len(r.removed) for r in lines.line_report(docs).collect()) == want
    docs = table([(None, f"x\n{copied}"), (None, f"y\n{copied}")])
    assert sorted(r.text for r in lines.dedup_lines(docs).collect()) in (["x", f"y\n{copied}"], [f"x\n{copied}", "y"])
