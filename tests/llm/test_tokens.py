from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from holdfast.llm import packing, token_files, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda t: [*own.encode(t or "", add_special_tokens=False).ids, 0]


SPACES = [f"one{chr(c)}two {chr(c)}" for c in range(0x3001) if chr(c).isspace()]
MIXED = [*SPACES, "café, naïve. Ünder! e\u0301a, x\u2019s don't, (it)'s \n\n a", "Tabs\tand  two blanks ", " leading\n\n  lines\r\nend", "it's we'll I'D d'accord l'été", "x1y2 3.14 -- !?...", "<|endoftext|> as text", "in<|endoftext|>side\n <|endoftext|>", "<|endoftext|", "日本語 テキスト emoji 😀😀 é", "a b c\u0085d", "ALL CAPS Überraschung straße"]


def test_pieces_make_the_ids_of_whole_texts(plain, prose):
    draw = random.Random(2)
    texts = MIXED + prose(20) + ["".join(draw.choice("ab Zé'1\n\t.,ß日") for _ in range(60)) for _ in range(200)] + [None, ""]
    ids, sizes = map(np.concatenate, zip(*tokens.PieceEncoder(tokens.vocabulary_path()).encode(pa.array(texts), 0)))
    want = [plain(t) for t in texts]
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], list(range(0, 70_000, 7))])
def test_codes_come_back(values):
    values = np.array(values, np.uint32)
    assert np.array_equal(token_files.unpack(*token_files.pack(values), len(values)), values)


def test_files_come_back(spark, table, odd, prose, plain):
    rows = odd + [(1000 - i, t) for i, t in enumerate(MIXED + prose(30))]
    folder = token_files.new_folder(spark)
    token_files.write(table(rows), folder)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((d, np.array(plain(t), "<u4").tobytes()) for d, t in rows)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["count"] for r in ranks] == sorted((r["count"] for r in ranks), reverse=True)


def test_special_strings_are_those_of_the_library(plain):
    assert plain("a<|endoftext|>b") == [64, 50256, 65, 0]


def test_packing_is_gapless_and_whole(table, odd, prose, plain):
    rows = [(i, t) for i, t in odd if i is not None] + [(1000 + i, t) for i, t in enumerate(prose(150, most=400) + MIXED)]
    bins, capacity = {}, 256
    pieces = packing.pack(table(rows), capacity=capacity).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in bins.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0, *(n for _, n in held[:-1])]).tolist()
        assert sum(n for _, n in held) <= capacity
    for d, t in rows:
        ids = plain(t)
        copies = sum(x == d for x, _ in rows)
        own = sorted(by_doc[d], key=lambda p: p.piece)[::copies]
        assert [p.piece for p in own] == list(range(-(-len(ids) // capacity)))
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own[:-1])]).tolist()
        assert all(p.length == capacity for p in own[1:])
        assert b"".join(bytes(p.ids) for p in own) == np.array(ids, "<u4").tobytes()
    assert len(bins) <= 1.05 * sum(p.length for p in pieces) / capacity + 1


@pytest.mark.parametrize("seed", range(5))
def test_counts_are_placed_as_documents_would_be(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 50) for _ in range(400)]
    rooms = []
    for n in sorted(lengths, reverse=True):  # best fit, one by one
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(50 - n)
    rows = packing.plan(Counter(lengths), 50)
    assert sum(hi - lo for _, lo, hi, *_ in rows) == len(lengths)
    assert max(first + -(-(hi - lo) // each) for _, lo, hi, each, first, _ in rows) <= len(rooms) + 1


def test_empty_table(spark, table):
    assert packing.pack(table([])).collect() == []
    folder = token_files.new_folder(spark)
    token_files.write(table([]), folder)
    assert token_files.read(spark, folder).collect() == []
    assert zlib.crc32(b"") == token_files.checksum(b"")
