"""Arrow texts as byte arrays: words, shingles and hashes without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """Powers 0, 1, ... of an odd number modulo 2^64; kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, CHUNK_BYTES + 1), np.uint64(base % (1 << 64)))
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded size: first row, end row, their bytes, and the place of each row in them (one more at the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK_BYTES, "right")) - 1)
        yield begin, end, raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in small letters, everything else as it is."""
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and how many words stand before each row (one more at the end)."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)  # a row starts or ends here
    cut[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, at)


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every unit (white space with the word behind it), and the number of units before each row."""
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    begins[at] = True
    begins[-1] = False
    begin = np.flatnonzero(begins)
    return begin, np.append(begin[1:], len(data)), np.searchsorted(begin, at)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from running sums over the bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_STEP, len(data) + 1)[: len(data)], out=total[1:])
    return mixed((total[end] - total[begin]) * _power(_BACK, len(data) + 1)[begin] + (end - begin).astype(np.uint64))


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive values, for every place that has so many."""
    count = max(0, len(values) - size + 1)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[i : i + count]
    return mixed(out)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending, and where each row's begin (one more at the end).

    Fewer words than ``size`` are one shingle; a row without words has none.
    """
    data = lowered(data)
    begin, end, before = words(data, at)
    word = hashes(data, begin, end)
    count = np.diff(before)
    row = np.repeat(np.arange(len(count)), count)
    value = runs(word, size)
    inside = before[1:][row[: len(value)]] - np.arange(len(value)) >= size  # the run ends in its own row
    value, owner = value[inside], row[: len(value)][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short):
        extra[i] = runs(word[before[r] : before[r + 1]], count[r])[0] ^ np.uint64(int(count[r]))
    value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def binaries(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Ranges of a flat array as Arrow binary values."""
    flat = np.ascontiguousarray(flat)
    places = np.asarray(at, np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(flat)]).cast(pa.binary())
