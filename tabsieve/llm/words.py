"""Words of Arrow string columns as numpy spans and 64-bit hashes.

Everything here works on one Arrow batch inside a task. A word is a maximal run of bytes outside
`[\\x20\\x09-\\x0D]`; null texts count as empty. Memory stays a small multiple of the batch: hashing
walks the bytes in segments, so one very long text needs no larger temporaries than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MASK = 2**64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the whole value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, _SEGMENT + 4096)
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, _MASK), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * _SEGMENT:
            _POWERS[base] = have
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the n + 1 word numbers at which the rows begin. `gap` marks the
    byte values that separate words."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = gap[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    base, i, n = _BASES[0], 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, side="right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = _powers(base, hi - lo + 1)
        prefix = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def hash_windows(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of every k consecutive values (n - k + 1 of them); `which` picks an independent function."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = _BASES[which]
    up, down = _powers(base, _SEGMENT + k)
    out = np.empty(n, dtype=np.uint64)
    for lo in range(0, n, _SEGMENT):
        hi = min(n, lo + _SEGMENT)
        part = mix(values[lo:hi + k - 1] + np.uint64(_BASES[which]))
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:len(part)], out=prefix[1:])
        out[lo:hi] = mix((prefix[k:k + hi - lo] - prefix[:hi - lo]) * down[:hi - lo])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
