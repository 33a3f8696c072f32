from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from holdfast.llm import lm


def tokens(t):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def test_base_scores_against_brute_force(table, odd, prose, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 200)  # most words are rare ones
    rows = odd + [(100 + i, t) for i, t in enumerate(prose(120))]
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for d, t in rows for w in [tokens(t)])
    got = lm.score(table(rows)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores_of_all_next_words_against_brute_force(spark, table, prose):
    """Every word's probability after a history, by plain sums; those of all words and of the unseen place add up to one."""
    texts = prose(60)
    rows = table(list(enumerate(texts))).select("text")
    words = lm.vocabulary(rows)
    model, _, _, other_mass = lm.start(rows, words)
    assert model.many.any() and (model.part > 0).any()
    draw = np.random.default_rng(1)
    for w in model.weights():
        w += draw.normal(size=w.shape).astype(np.float32)
    known = np.append(model.known, np.uint64(12345))  # and one word that is not known
    log = np.zeros(len(known))
    for k, h in enumerate(known):
        at, raw = lm._features(model, np.array([known[3], known[7], h]), np.array([3]))
        for t, which, bias, r, truth in lm._levels(model, at, raw):
            i = 2 if isinstance(which, slice) else int(np.flatnonzero(which == 2)[0]) if (which == 2).any() else None
            if i is not None:
                x = [float((bias if bias.ndim == 1 else bias[i])[o]) + sum(float(model.weights()[t][r[i, j], o]) for j in range(3)) for o in range(model.weights()[t].shape[1])]
                want = math.exp(x[truth[i]] - max(x)) / sum(math.exp(y - max(x)) for y in x)
                assert abs(lm._softmax(bias, model.weights()[t], r)[i, truth[i]] - want) < 1e-5
                log[k] += math.log10(want)
    n_rare = sum(1 for r in words.collect() if np.int64(r.h).view(np.uint64) not in set(model.known.tolist()))
    rare = sum(r.c + 1 for r in words.collect() if np.int64(r.h).view(np.uint64) not in set(model.known.tolist()))
    p = 10 ** (log + model.log_share)
    assert rare + 1 == other_mass and n_rare + len(model.known) == words.count()
    assert abs(p.sum() - 1) < 1e-5


def test_order_of_words_is_learned(table):
    draw = np.random.default_rng(2)
    follow = {i: draw.integers(0, 40, 3) for i in range(40)}

    def text():
        at, out = 0, []
        for _ in range(80):
            at = int(draw.choice(follow[at]))
            out.append(f"word{at}")
        return " ".join(out)

    got = lm.score(table([(i, text()) for i in range(300)])).where("held_out").collect()
    assert len(got) > 20
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)  # both below zero: nearer to it is better


def test_empty_table(table):
    assert lm.score(table([])).collect() == []
    assert [r.held_out for r in lm.score(table([(None, None)])).collect()] == [False]
