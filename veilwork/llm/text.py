"""Vectorised words and hashes over Arrow string buffers.

Texts are read as UTF-8 bytes where they lie; words, their hashes and shingles are numpy arrays, so no Python object
is made for a word. Null texts count as empty. Memory is about 60 bytes for each byte of the chunk in hand; a chunk
holds CHUNK bytes, or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19

#: bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased texts
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and len+1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    data, at = buffers(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and the row of each. No word crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _table(places: int) -> np.ndarray:
    """Random 64-bit numbers for each byte at each of the first places of a word, as one flat table."""
    return mix(mix(np.arange(1, 256 * places + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


_PLACES = 64
_TABLE = _table(_PLACES)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random number for each byte at its place (tabulation), and the length.

    The numbers of places beyond the table are made when they are met, so that long words are hashed whole.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = np.cumsum(size)
    own = np.repeat(start - (total - size), size) + np.arange(total[-1])  # the bytes of words, one after another
    place = own - np.repeat(start, size)
    code = place * 256 + data[own]
    far = np.flatnonzero(place >= _PLACES)
    x = _TABLE[np.where(place < _PLACES, code, 0)] if len(far) else _TABLE[code]
    if len(far):
        x[far] = mix(mix((code[far] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(x, total - size) + size.astype(np.uint64))


def runs(h: np.ndarray, row: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one row, and the place (word number here) at which each starts."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = len(h) - n + 1
    place = np.flatnonzero(row[:whole] == row[n - 1 :])
    base = np.uint64(0xD6E8FEB86659FD93 + 2 * salt)
    if n <= 8:
        out = np.zeros(whole, np.uint64)
        for k in range(n):
            out = out * base + h[k : k + whole]
        return mix(out[place]), place
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(len(h), base, np.uint64), np.full(whole, inverse, np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * np.multiply.accumulate(up), out=total[1:])
    return mix((total[n:] - total[:-n])[place] * np.multiply.accumulate(down)[place]), place


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, byte by byte of all numbers, so that bytes that are always 0 take no room."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    """The columns that packed took, as rows of a uint64 array."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.uint64)[..., 0]
