"""Text work on whole Arrow batches in numpy: words, fingerprints and windows of many documents at once.

A substring's fingerprint comes from prefix sums of T[byte] * B**position modulo 2**64, where T maps
bytes to fixed random numbers: the difference of two sums times an inverse power depends on the bytes
alone, not on where they stand. A finisher mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240521)
BYTE_KEYS = _rng.integers(0, 1 << 64, 256, dtype=U) | U(1)
BASE = int(_rng.integers(0, 1 << 61)) * 8 + 5
ODD = _rng.integers(0, 1 << 64, 4096, dtype=U) | U(1)
#: Bytes of text that one step of a worker handles, a longer text apart.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, U(b))
            x[0] = 1
            both.append(np.cumprod(x, dtype=U))
        found = both[0], both[1]
        if size <= 8 * CHUNK:  # the tables of one huge text aren't kept
            _powers[base] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit words."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def prefix(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of values[i] * base**i before each position."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], dtype=U, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Fingerprints of [start, end), equal for equal values."""
    return mix((sums[end] - sums[start]) * powers(len(sums), base)[1][start])


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary column without nulls as its bytes and offsets, not copied."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of stretches of about ``limit`` bytes, one row at least."""
    data, offsets = binary(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each document's words begin among them (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ids(bounds: np.ndarray) -> np.ndarray:
    """For bounds of consecutive groups, the group of each member."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
