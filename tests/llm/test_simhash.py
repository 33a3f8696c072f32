from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from holdfast.llm import simhash


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [least[find(i)] for i in range(len(ids))]


def test_whole_texts_against_brute_force(table, prose, odd):
    texts = prose(60, least=100, most=200)
    near = [t.replace(t.split()[50], "changed", 1) for t in texts[:15]] + [t.upper() for t in texts[15:20]]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts + near + texts[:5])]
    prints = [plain_print(t) for _, t in rows]
    want = sorted(zip(((d if d is not None else -1) for d, _ in rows), prints, plain_components(prints, [d for d, _ in rows], 4)), key=str)
    got = sorted((((r.doc_id if r.doc_id is not None else -1), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(table(rows)).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("tile", [7, 1 << 15])
def test_tiles_find_every_link(spark, tile):
    draw = random.Random(3)
    prints = []
    for _ in range(120):
        at = draw.getrandbits(64)
        for _ in range(draw.randint(1, 4)):
            prints.append(at)
            for b in draw.sample(range(64), draw.randint(1, 5)):
                at ^= 1 << b
    ids = list(range(len(prints)))
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    got = simhash.components(spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long"), 4, tile)
    of = {r.fp: r.component_id for r in got.collect()}
    assert [of[s] for s in signed] == plain_components(prints, ids, 4)


def sets_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_wide(text):
    [(_, value, size)] = simhash.shingle_sets(pa.array([text], pa.string()))
    assert len(value) == size[0] == len(sets_of(text))
    more = simhash.wordhash.mix(value * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15))
    rows = [int(x) | int(y) << 64 for x, y in zip(simhash.wordhash.mix(value), more)]
    return sum(1 << b for b in range(simhash.WIDE) if 2 * sum(x >> b & 1 for x in rows) > len(rows))


def plain_kept(rows, radius):
    """The rows that stay, if texts of a similarity of 0.8 or more, and within the radius, are linked."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, prints = [sets_of(t) for _, t in rows], [plain_wide(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            close = (prints[i] ^ prints[j]).bit_count() <= radius and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if close and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return sorted((rows[i] for i in set(root)), key=str)


def changed(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.random()}"
    return " ".join(words)


def kept(docs, **how):
    return sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs, **how).collect()), key=str)


@pytest.mark.parametrize("tile, radius", [(1 << 15, 28), (6, 28), (6, 64)])
def test_one_of_similar_texts_stays(table, prose, odd, tile, radius):
    draw, texts = random.Random(7), prose(40, least=60, most=200)
    rows = [(d, t) for d, t in odd if d is not None] + [(draw.randrange(10**6), t) for t in texts]
    rows += [(draw.randrange(10**6), changed(draw, draw.choice(texts), draw.randint(0, 8))) for _ in range(100)]
    assert kept(table(rows), radius=radius, tile=tile) == plain_kept(rows, radius)


def test_large_group_with_links_of_later_ones(table, prose):
    draw, base = random.Random(8), prose(1, least=200, most=200)[0]
    rows = [(i, changed(draw, base, draw.randint(2, 6))) for i in range(150)] + [(900, base), (901, base.upper())]
    for tile in (1 << 15, 20):
        assert kept(table(rows), tile=tile) == plain_kept(rows, 28)


def test_most_similar_texts_are_within_the_radius(table, prose):
    draw, texts = random.Random(9), prose(150, least=150, most=300)
    rows = [*enumerate(texts), *((1000 + i, changed(draw, t, draw.randint(1, 5))) for i, t in enumerate(texts))]
    similar = [i for i, t in enumerate(texts) if 5 * len(sets_of(t) & sets_of(rows[150 + i][1])) >= 4 * len(sets_of(t) | sets_of(rows[150 + i][1]))]
    found = {1000 + i for i in range(150)} - {d for d, _ in kept(table(rows))}
    assert found <= {1000 + i for i in similar} and len(found) >= 0.98 * len(similar) > 100


def test_one_of_each_group_stays(table, prose):
    texts = prose(8, least=100, most=120)
    docs = table([(10 * k + i, t) for i, t in enumerate(texts) for k in range(4)] + [(0, texts[0]), (None, texts[1]), (None, "alone"), (7, "two of one id")])
    got = simhash.keep_one(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([*enumerate(texts), (None, "alone"), (7, "two of one id")], key=str)
    assert all(r[c] == c for r in got.collect() for c in docs.columns[3:])


def test_stage_keeps_clean_texts_and_finds_near_copies(spark, table, prose):
    corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
    draw, texts = random.Random(9), prose(30, least=200, most=300)
    docs = table([*enumerate(texts), *((100 + i, changed(draw, t, 3)) for i, t in enumerate(texts))])
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [*range(30)]


def test_empty_table(table):
    assert simhash.near_duplicates(table([])).collect() == []
    assert simhash.keep_one(table([])).collect() == []
