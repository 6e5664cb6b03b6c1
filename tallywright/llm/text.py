"""Words and hashes of a column of texts, whole column slices at a time.

Texts stay UTF-8 bytes: every separator used here is ASCII, so bytes of longer characters are
never cut. Hashes are 64 bits wide; A-Z counts as a-z in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19


def _mixed(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    v = _mixed(256, 7)
    v[65:91] = v[97:123]
    return v


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    f = np.zeros(256, bool)
    for low, high in ranges:
        f[low:high + 1] = True
    return f


BYTES = _byte_values()
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
#: [^\x20\x09-\x0D]
SOLID = ~_flags((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], once A-Z is lower-cased
ALNUM = _flags((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: ASCII letters, and all bytes of longer characters
LETTER = _flags((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class _Kept(dict):
    """Tables made anew wherever they are used; they don't travel with functions."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** 0..n-1 and their inverses, modulo 2 ** 64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums that `span_hash` takes differences of."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the values that `running` was given."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most max_bytes of text (one row may be longer): rows, bytes, row bounds.

    A null text counts as empty."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = pc.fill_null(text, "")
    # The column's own buffers: nothing is copied.
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    bounds = np.frombuffer(text.buffers()[1], width)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `kind` bytes that do not cross rows, and where the
    words of each row begin and end among them."""
    m = kind[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= m[cut]
    last[cut - 1] |= m[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(running(BYTES[data]), starts, ends)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the items of each row; of none, 0."""
    if values.dtype.kind in "bui":
        values = values.astype(np.int64)
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind == "i" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(values[bounds[0]:bounds[-1]]))
