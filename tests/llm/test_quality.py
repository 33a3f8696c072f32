from __future__ import annotations

import re
from collections import Counter

from holdfast.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed


def test_measures_against_brute_force(table, odd, prose):
    texts = prose(20)
    phrase = "one two three four five six seven eight nine ten"
    rows = odd + [(100 + i, t) for i, t in enumerate(texts + [t + "\n" + t for t in texts[:3]] + [f"{phrase} x {phrase} y {phrase[8:]}", "a|b # c\n" * 30, "#$% <x>\u0085y z"])]
    got = quality.quality(table(rows))
    want = Counter((d, *plain(t)) for d, t in rows)
    found = got.collect()
    own = [c for c in table([]).columns[2:] if c not in (*quality.MEASURES, "kept")]
    assert len(own) > 30 and all(r[c] == (c if c != "lang" else None) for r in found for c in own)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    assert not any(r.kept for r in found if r.base_failed)


def test_thresholds_decide(table, prose):
    fine = " ".join(prose(1)[0].split())
    rows = {1: fine, 2: "# " * 20 + fine, 3: "the and of " * 2, 4: "\n".join([fine[:60]] * 8), 5: "zzz xxx " * 2 + " ".join(f"q{i}vv" for i in range(60))}
    got = {r.doc_id: r.broken_rules for r in quality.quality(table(list(rows.items()))).collect()}
    assert got[1] == []
    assert "symbols" in got[2] and "too_few_words" in got[3] and "duplicate_lines" in got[4] and got[5] == ["few_stop_words"]


def test_clean_rows_stay_as_they_are(table, prose):
    docs = table([(i, t) for i, t in enumerate(prose(5))] + [(9, "junk"), (10, None), (None, prose(1)[0])])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in docs.collect() if r.doc_id not in (9, 10))
    assert quality.keep_good(table([])).collect() == []
