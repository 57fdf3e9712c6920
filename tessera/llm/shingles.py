"""Word and shingle hashes of Arrow text columns, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 18
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_WEIGHT = mix(np.arange(1, 6, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, _SLICE * 2)
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            a = np.full(n, base, U)
            a[0] = 1
            _powers[name] = np.cumprod(a)
        if n > 16 * _SLICE:  # one very long text: don't hold on to the tables
            up, down = _powers["up"], _powers["down"]
            _powers.clear()
            return up, down
    return _powers["up"], _powers["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of about 256 KB; a null is an empty text."""
    a = column.cast(pa.large_string()).fill_null("")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(a):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLICE, "right")) - 1)
        end = min(end, len(a))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of other than ASCII white space, A-Z
    lower-cased) of a slice, and each word's row."""
    if not len(data):
        return np.empty(0, U), np.empty(0, np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | cut[1:]))
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((_FOLD[data].astype(U) + U(1)) * up[: len(data)], out=total[1:])
    h = (total[ends + 1] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA24BAED4963EE407)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its 5-word shingles) for every row. A
    text of one to four words has one shingle, the sequence; one without words none."""
    for first, data, offsets in text_slices(column):
        words, row = word_hashes(data, offsets)
        n = len(offsets) - 1
        bound = np.searchsorted(row, np.arange(n + 1))
        rolled = np.zeros(max(0, len(words) - 4), U)
        for k in range(5):
            rolled += words[k : k + len(rolled)] * _WEIGHT[k]
        rolled = mix(rolled)
        for i in range(n):
            a, b = bound[i], bound[i + 1]
            if b - a >= 5:
                s = np.sort(rolled[a : b - 4])
                yield first + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                short = np.array([b - a], U) * U(0xC2B2AE3D27D4EB4F)
                for k in range(b - a):
                    short = mix(short + words[a + k : a + k + 1] * _WEIGHT[k])
                yield first + i, short
            else:
                yield first + i, np.empty(0, U)


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that name a set of hashes."""
    one, two = mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U), mix(s * U(0xFF51AFD7ED558CCD) + U(7)).sum(dtype=U)
    return np.array([one, two], U).tobytes()
