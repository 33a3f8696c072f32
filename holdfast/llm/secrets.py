"""Secrets in text: fixed patterns, and random-looking strings told from identifiers by two character Markov models.

Patterns (leftmost, non-overlapping for each kind; a match that is too short is dropped, not retried): `assign`, a
credential word with a value; `access`, access key ids; `hex`, long runs of hexadecimal digits. Kind `random` is any
other run of 16 or more key characters with a letter whose log-likelihood under a model of random strings exceeds that
under a model of ordinary identifiers by `MARGIN`, and by `EACH` for each character, and which no pattern span overlaps.
Runs of digits alone are not asked about: the models know nothing that tells a secret from a card, phone or serial number;
nor are UUIDs, which name things openly, and runs of fewer than `DISTINCT` different characters. The models are trained
from labelled samples: random strings of four alphabets from a seeded generator and the values that the patterns find,
against the words and identifiers of the text around them and identifiers, constants, paths and slugs that a seeded
generator makes of usual words; the text sample is `SAMPLE_ROWS` documents at most, chosen by hash of the id, and only a
95 x 95 table of counts leaves a task.

A null text is empty and has no spans; repeated rows are scanned one by one; only the id and text columns are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Credential words, in either case.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
SAMPLE_ROWS = 20_000
MARGIN = 6.0
EACH, DISTINCT = 0.7, 6
#: Words that names in code and addresses are made of.
USUAL = (
    "get set user account settings from database http url connection factory bean max min retry count per host load save read write file name path list map index key value type class "
    "object string number array buffer stream client server request response handler manager service controller model view config option default local remote cache queue thread process "
    "event message error result status state create update delete insert select find search filter sort order group parse format convert validate check test build make start stop "
    "open close begin end first last next previous current total size length width height time date year month day version source target input output data table column row field "
    "page article post image video category library package module function method parameter argument return import export public private static final abstract interface"
).split()
#: How many pairs the plain frequency of a character counts as.
BACK_OFF = 8.0
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")

_either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile("(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
KEYLIKE = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}+")
#: Stands between words and is neither's character; its place in the table is that of the ends.
END = chr(31)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' spans, in order."""
    found = []
    small = text.lower()
    if any(w in small for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def steps(word: str) -> np.ndarray:
    """The cells of a word's character pairs in a 96 x 96 table; row and column 0 are the word's ends."""
    at = np.frombuffer(word.encode("ascii", "replace"), np.uint8).astype(np.int64) - 31
    return np.concatenate([[0], at]) * 96 + np.concatenate([at, [0]])


def _seeded(n: int = 4000) -> np.ndarray:
    """Counts of character pairs of random strings."""
    draw, total = random.Random(11), np.zeros(96 * 96)
    for i in range(n):
        word = "".join(draw.choices(ALPHABETS[i % len(ALPHABETS)], k=draw.randint(16, 48)))
        np.add.at(total, steps(word), 1)
    return total


def _usual(n: int = 6000) -> np.ndarray:
    """Counts of character pairs of names as code and addresses have them."""
    draw, total = random.Random(12), np.zeros(96 * 96)
    joined = (
        lambda w: w[0] + "".join(map(str.capitalize, w[1:])), lambda w: "".join(map(str.capitalize, w)), lambda w: "_".join(w), lambda w: "_".join(w).upper(), lambda w: "-".join(w),
        lambda w: "/" + "/".join(w), lambda w: "/".join([w[0], str(draw.randint(1990, 2030)), "-".join(w[1:])]), lambda w: "".join(map(str.capitalize, w[:-1])) + w[-1].upper(), lambda w: "_".join(w) + str(draw.randint(1, 99)),
    )
    for i in range(n):
        np.add.at(total, steps(joined[i % len(joined)](draw.choices(USUAL, k=draw.randint(2, 6)))), 1)
    return total


def _unlabelled(m: re.Match) -> str:
    """Nothing in place of a candidate, which may be of either kind."""
    return " " if m[0].isalpha() or DIGIT.search(m[0]) and LETTER.search(m[0]) else m[0]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 96 * 96), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            rest, at = [], 0
            for start, _, end in spans:
                rest.append((text or "")[at:start])
                for word in KEYLIKE.findall(text[start:end]):
                    np.add.at(total[1], steps(word), 1)
                at = max(at, end)
            rest.append((text or "")[at:])
            words = [w for part in rest for w in IDENTIFIER.findall(KEYLIKE.sub(_unlabelled, part))]
            if words:
                total[0] += np.bincount(steps(END.join(words)), minlength=96 * 96)
    kind, cell = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[kind, cell])], ["kind", "cell", "n"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random over ordinary."""
    every = max(1, -(-docs.count() // rows))
    sample = docs.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(every)) == 0).select(F.col(text).alias("text"))
    counts = sample.mapInArrow(_sample, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((2, 96 * 96))
    for kind, cell, n in counts:
        total[kind, cell] = n
    total[0] += _usual()
    total[1] += _seeded()
    table = total.reshape(2, 96, 96)
    alone = (table.sum(1, keepdims=True) + 0.5) / (table.sum((1, 2), keepdims=True) + 48)  # how frequent a character is whatever stands before it
    log = np.log((table + BACK_OFF * alone) / (table.sum(2, keepdims=True) + BACK_OFF))
    return (log[1] - log[0]).ravel()


def looks_random(run: str, ratio: np.ndarray) -> bool:
    return ratio[steps(run)].sum() > max(MARGIN, EACH * len(run)) and len(set(run)) >= DISTINCT and not UUID.fullmatch(run)


def spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order of start, then kind."""
    found = base_spans(text)
    more, at, reach = [], 0, 0
    for m in KEYLIKE.finditer(text):
        while at < len(found) and found[at][0] < m.end():
            reach = max(reach, found[at][2])
            at += 1
        if reach <= m.start() and LETTER.search(m[0]) and looks_random(m[0], ratio):
            more.append((m.start(), 3, m.end()))
    return sorted(found + more)


def written(found: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row for each document: doc_id, kinds, starts, ends (arrays, in order; code points, end exclusive)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, rows=sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t or "", shared.value) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[KINDS[s[1]] for s in f] for f in found], pa.list_(pa.string()))]
            lists += [pa.array([[s[i] for s in f] for f in found], pa.list_(pa.int32())) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "kinds", "starts", "ends"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, kinds array<string>, starts array<int>, ends array<int>")
