"""Byte-level BPE ids for Arrow batches of text, by the `tokenizers` library.

A text is cut into pieces at places where the vocabulary's own pre-tokenizer
always cuts (before a run of blanks or newlines, and after the ASCII letters
that a run of other characters begins with, if an ASCII character follows), so
the ids of a text are the ids of its pieces. Pieces are cut and hashed on whole
buffers (64 bits); each worker encodes a piece it has not met yet and keeps the
ids of up to `PIECES` pieces. A text that holds any other white space, or the
string of a special token, is encoded whole. Special tokens' strings get the
ids that the library gives them by default. A null is an empty text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import wordhash

#: Pieces that a worker remembers at most, and slots of its table; when it is full it starts anew.
PIECES, SLOTS = 1_500_000, 1 << 22
#: Pieces that are encoded as one text.
JOINED = 400

_known: dict[str, PieceEncoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; it lives as long as the worker, over all its tasks."""
    if path not in _known:
        _known[path] = PieceEncoder(path)
    return _known[path]


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space other than blanks and newlines in UTF-8 bytes."""
    control = np.flatnonzero((data < 32) & (data != 10))
    control = control[np.isin(data[control], [9, 11, 12, 13, 28, 29, 30, 31])]
    at = np.flatnonzero((data == 0xC2) | (data - np.uint8(0xE1) < 3))
    padded = np.append(data, np.zeros(2, np.uint8))
    x, y, z = padded[at], padded[at + 1], padded[at + 2]
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))  # U+0085, U+00A0
    three = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)  # U+1680, U+3000
    general = (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (x == 0xE2) & (y == 0x81) & (z == 0x9F)
    return np.concatenate([control, at[two | three | general]])


def piece_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts that begin at edges (the last is the end) begin."""
    blank = (data == 32) | (data == 10)
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[edges[:-1][edges[:-1] < len(data)]] = True
    runs = np.flatnonzero(first)
    solid = np.append(np.flatnonzero(~blank), len(data))
    begin = solid[np.searchsorted(solid, runs)]
    other = np.append(np.flatnonzero((data | np.uint8(32)) - np.uint8(97) > 25), len(data))
    stop = other[np.searchsorted(other, begin)]
    inside = np.flatnonzero((stop > begin) & (stop < np.append(runs[1:], len(data))))
    cut = stop[inside]
    first[cut[data[cut] < 128]] = True
    return np.flatnonzero(first)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.n_bytes = np.array([len(x) for x in names], np.int64)  # a byte-level name has a character for each byte
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of known hashes, -1 for others."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.numbers[slot]
        out[self.hashes[slot] != h] = -2
        out[self.numbers[slot] < 0] = -1
        open_ones = np.flatnonzero(out == -2)
        while len(open_ones):
            slot[open_ones] = (slot[open_ones] + 1) & (SLOTS - 1)
            at = slot[open_ones]
            free, same = self.numbers[at] < 0, self.hashes[at] == h[open_ones]
            out[open_ones] = np.where(free, -1, np.where(same, self.numbers[at], -2))
            open_ones = open_ones[~free & ~same]
        return out

    def add(self, h: np.ndarray) -> None:
        """Gives distinct new hashes the next numbers."""
        number = len(self.size) - len(h) + np.arange(len(h), dtype=np.int32)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.numbers[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)  # of those that want one slot, one gets it
            won = free[one]
            self.numbers[slot[won]], self.hashes[slot[won]] = number[won], h[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def learn(self, h: np.ndarray, pieces: list[str]) -> None:
        blank = np.array([p[0] in " \n" for p in pieces])
        joins = blank & np.array([p[-1] not in " \n" for p in pieces])  # next to another piece the others could merge with it
        order = np.argsort(joins, kind="stable")
        apart = [pieces[i] for i in order[: len(pieces) - int(joins.sum())]]
        joined = [pieces[i] for i in order[len(apart) :]]
        got = self.whole(apart)
        size = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        if joined:
            texts = ["".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)]
            more = np.array(list(chain.from_iterable(self.whole(texts))), np.uint32)
            ends = np.cumsum([len(p.encode()) for p in joined])
            upto = np.cumsum(self.n_bytes[more])
            stop = np.searchsorted(upto, ends) + 1
            if not np.array_equal(upto[stop - 1], ends):
                raise ValueError("the vocabulary does not cut before white space; it is not a byte-level one of the expected kind")
            size, ids = np.concatenate([size, np.diff(stop, prepend=0)]), np.concatenate([ids, more])
        first = len(self.ids) + np.cumsum(size) - size
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        self.add(h[order])

    def numbered(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = wordhash._of_runs(data, starts, size)
        number = self.find(h)
        if (number < 0).any():
            new, at = np.unique(h[number < 0], return_index=True)
            if len(self.size) + len(new) > PIECES:
                self.forget()
                new, at = np.unique(h, return_index=True)
            else:
                at = np.flatnonzero(number < 0)[at]
            raw = data.tobytes()
            self.learn(new, [raw[i : i + n].decode() for i, n in zip(starts[at].tolist(), size[at].tolist())])
            number = self.find(h)
        return number

    def some(self, data: np.ndarray, edges: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between edges, and how many each has."""
        n = len(edges) - 1
        odd = np.zeros(n, bool)
        odd[np.searchsorted(edges, odd_spaces(data), "right") - 1] = True
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(edges, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        starts = piece_starts(data, edges)
        size = np.diff(np.append(starts, len(data)))
        per = np.diff(np.searchsorted(starts, edges))
        plain = np.repeat(~odd, per)
        starts, size, per = starts[plain], size[plain], np.where(odd, 0, per)
        at = self.numbered(data, starts, size) if len(starts) else np.zeros(0, np.int64)
        length, first = self.size[at], self.first[at]
        ids = self.ids[np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum()))]
        edge = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(per))]
        sizes = np.diff(edge)
        if odd.any():
            parts = np.split(ids, edge[1:-1])
            which = np.flatnonzero(odd).tolist()
            for i, own in zip(which, self.whole([raw[edges[i] : edges[i + 1]].decode() for i in which])):
                parts[i] = np.array(own, np.uint32)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if end is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1
        return ids.astype(np.uint32, copy=False), sizes

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts one after another, each followed by `end` if given, and how many each has, in chunks."""
        data, offsets = wordhash.buffers(texts)
        for i, j in wordhash.chunks(offsets):
            yield self.some(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
