"""Vectorised text arithmetic shared by the operators that work on words or bytes.

Everything here is a small numpy helper for use inside Spark tasks. Hashes are 64 bit,
computed modulo 2**64, and are the same on every machine and in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Code points that separate words: space and U+0009 to U+000D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_ODD = U64(0x9E3779B97F4A7C15)
_MUL_A = U64(0xFF51AFD7ED558CCD)
_MUL_B = U64(0xC4CEB9FE1A85EC53)
_S33 = U64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _MUL_A
    x = x ^ (x >> _S33)
    x = x * _MUL_B
    return x ^ (x >> _S33)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text, b"" for null; lone surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end, for UTF-8 bytes as a uint8 array."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sep = _IS_SEP[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    if not sep[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


#: Positions for which powers are kept; longer texts get their own.
_KEPT = 1 << 22
_kept: dict[str, np.ndarray] = {}
_ODD_INVERSE = U64(pow(int(_ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    known = _kept.get(str(base))
    if known is None or len(known) < n:
        size = n if n > _KEPT else min(_KEPT, max(n, 1 << 16) * 2)
        known = np.full(size, base, U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= _KEPT:
            _kept[str(base)] = known
    return known[:n]


def _prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * _ODD**i, one more than there are values."""
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * _powers(_ODD, len(values)), out=sums[1:])
    return sums


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, from its bytes only."""
    if not len(starts):
        return np.empty(0, U64)
    sums = _prefix(data.astype(U64) + U64(1))
    return mix64((sums[ends] - sums[starts]) * _powers(_ODD_INVERSE, len(data))[starts] + (ends - starts).astype(U64) * _MUL_B)


_BYTE = mix64(np.arange(1, 257, dtype=U64) * _ODD)


def byte_runs(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    sums = _prefix(_BYTE[data])
    return mix64((sums[k:] - sums[:-k]) * _powers(_ODD_INVERSE, n))


def rolling(items: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k items (a doubling scheme: log2(k) passes)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, level, width = None, 0, items, 1
    while True:
        if k & width:
            part = level[done : done + n]
            out = part.copy() if out is None else mix64(out * _ODD + part)
            done += width
        if width * 2 > k:
            return out
        level = mix64(level[:-width] * _ODD + level[width:])
        width *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    width = 1
    while width * 2 <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == w else np.minimum(values[: len(values) - (w - width)], values[w - width :])


_POS_BITS = U64(0xFFFFFFFF)


def anchors(seeds: np.ndarray, w: int, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: the leftmost least seed of every w consecutive seeds.

    Returns the anchors' positions, and for each the first window that chose it and how many
    consecutive windows did. A window's anchor depends only on what is in the window. ``valid`` has
    the windows that count, in order; those that lie in two texts do not.
    """
    n = len(seeds) - w + 1
    if n <= 0 or (valid is not None and not len(valid)):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    packed = (mix64(seeds ^ _ODD) & ~_POS_BITS) | np.arange(len(seeds), dtype=U64)
    best = sliding_min(packed, w)
    if valid is not None:
        best = best[valid]
    best = (best & _POS_BITS).astype(np.int64)
    lead = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    first = lead if valid is None else valid[lead]
    return best[lead], first, np.diff(np.concatenate((lead, [len(best)])))


# ---------------------------------------------------------------- many texts at once


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts (null: none), with a blank after each text, and where each
    text starts, with one more start past the end."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, body = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(body or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    return np.insert(data, at[1:], 0x20), at + np.arange(len(at))


def inside(starts: np.ndarray, width: int, gap: int = 0) -> np.ndarray:
    """Positions at which a run of ``width`` lies in one text; texts end ``gap`` before the next starts."""
    size = np.maximum(np.diff(starts) - gap - width + 1, 0)
    return np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)
