"""Packed integer lists and byte gathering for operators that move arrays instead of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_LEVEL = 3


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (sizes[i] of them), one list after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(total, dtype=np.int64)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The byte spans of `data` as an Arrow column."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    body = np.ascontiguousarray(data[ranges(starts, sizes)])
    kind = kind or pa.large_string()
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def varints(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each list values[bounds[i]:bounds[i + 1]] of ascending numbers as differences of 7 bits a byte."""
    values = values.astype(np.int64)
    steps = np.diff(values, prepend=0)
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    steps[first] = values[first]
    size = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(5):
        some = size > k
        if not some.any():
            break
        out[at[some] + k] = (steps[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    offsets = np.append(at, len(out))[bounds].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unvarints(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lists of `varints`, one after the other; `sizes` are their numbers of values."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    last = data < 128
    ends = np.flatnonzero(last)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    steps = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins)
    total = np.cumsum(steps)
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    base = total[firsts] - steps[firsts]
    return total - np.repeat(base, sizes[sizes > 0])


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Unsigned integers, in the smallest width that holds them, compressed; ascending ones as differences."""
    values = values.astype(np.uint64)
    if sorted_ and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    # Bytes of one weight lie side by side: high bytes are mostly equal.
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, sorted_: bool = False) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if sorted_ else values
