"""64-bit hashes of the blank-separated words of Arrow text arrays, computed on whole buffers with numpy.

Equal words have equal hashes everywhere, whatever their length, and two different words meet with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
#: Bytes of a word that are hashed in steps of eight; longer words are hashed whole, one by one.
STEPPED = 128
_low_bytes = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_lengths = np.random.default_rng(20240229).integers(0, 1 << 63, STEPPED + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def solid_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are no ASCII white space (32, 9 to 13)."""
    return (data != 32) & (data - np.uint8(9) > 4)


def lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len(texts) + 1 places where they begin and end; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK bytes."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def _of_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes: eight bytes at a time, mixed after each step, from a value drawn for the length."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    h = _lengths[np.minimum(size, STEPPED)]
    some = None
    for k in range(0, min(int(size.max()), STEPPED), 8):
        if k:
            some = np.flatnonzero(size > k) if some is None else some[size[some] > k]
        at, left = (start, size) if some is None else (start[some] + k, size[some] - k)
        block = eight[at] & _low_bytes[np.minimum(left, 8)]
        if some is None:
            h = mix((h ^ block) * np.uint64(0xD1342543DE82EF95))
        else:
            h[some] = mix((h[some] ^ block) * np.uint64(0xD1342543DE82EF95))
    for i in np.flatnonzero(size > STEPPED).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), 7)
    return h


def hashes(data: np.ndarray, edges: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of data, and how many words lie between one edge and the next; no word goes over an edge."""
    solid = solid_bytes(data)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = edges[:-1][edges[:-1] < len(data)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(edges) - 1, np.int64)
    last = solid
    last[:-1] &= ~solid[1:] | first[1:]
    size = np.flatnonzero(last) + 1 - starts
    return _of_runs(lowered(data) if lower else data, starts, size), np.diff(np.searchsorted(starts, edges))


def words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunk by chunk: the first text's number, the hashes of the words, the number of words of each text."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        yield i, *hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
