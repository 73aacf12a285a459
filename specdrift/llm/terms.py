"""Lower-cased terms of many texts at once, as byte ranges and hashes, for the operators that search and mine.

Small numpy helpers for use inside Spark tasks. Only A-Z are lower-cased; other letters stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from specdrift.llm.textnum import _MUL_A, _MUL_B, _ODD, U64, flat_texts, mix64, word_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of terms: ASCII digits and letters, and all of other code points.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and end."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of a column of texts with a blank after each, and where each text starts."""
    data, starts = flat_texts(column)
    return _LOWER[data], starts


class Terms:
    """The terms of a column of texts: byte ranges, 64-bit hashes, and at which term each text starts."""

    def __init__(self, column: pa.Array):
        self.data, texts = lowered(column)
        self.starts, self.ends = runs(_TERM[self.data])
        self.first = np.searchsorted(self.starts, texts)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each run of ``width`` items that starts at one of the places ``at``."""
    h, g = np.full(len(at), width, U64), np.full(len(at), width, U64)
    for j in range(width):
        one = hashes[at + j]
        h = mix64(h * _ODD + one)
        g = g * _MUL_A + mix64(one + _MUL_B)
    return h, mix64(g)


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, first + many), one range after the other."""
    if not len(first):
        return np.empty(0, np.int64)
    return np.arange(many.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list of the next ``counts[i]`` values for each i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
