"""A large block of suffixes leaves its task in bounded batches."""

import random

import numpy as np

from specdrift.llm import suffix_dedup


def _place(doc: int, at: int) -> bytes:
    one = lambda v: np.array([v])
    return suffix_dedup.places(one(doc), one(0), one(at), one(at), one(69))[0]


def _merged(n: int, read: list):
    """n suffixes that share a seed of 32 bytes and differ after it, the first one in two places."""
    last = None
    for i in range(n):
        text = b"s" * 32 + b"%08d" % i + random.Random(i).randbytes(128)
        key = text + len(text).to_bytes(4, "big")
        shared = 0 if last is None else suffix_dedup.common(last, key, 0)
        read.append(i)
        yield key, shared, _place(i, 0)
        last = key
        if i == 0:
            yield key, len(key), _place(n, 7)


def _rows(batches) -> list:
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def test_large_block_is_streamed(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 200_000)
    read, most, seen, opened = [], 0, 0, set()
    n = 6_000
    for batch in suffix_dedup.settled(_merged(n, read), 100, 32):
        if not seen:
            assert len(read) < n
        seen += batch.num_rows
        most = max(most, batch.num_rows)
        rows = _rows([batch])
        opened |= {(d, s) for d, _, s, _, _, _, sure in rows if not sure}
        assert all((d, s, e) == (n, 7, 175) for d, _, s, e, _, _, sure in rows if sure)
    assert most <= 69 * (200_000 // 168 + 2)
    assert seen == 69 * n + 1 and opened == {(d, s) for d in range(n) for s in range(69)}


def test_small_block_is_settled_in_its_task():
    rows = _rows(suffix_dedup.settled(_merged(3, []), 100, 32))
    # the strings of all three differ, but for the second place of the first
    assert [(d, s, e, sure) for d, _, s, e, _, _, sure in rows] == [(3, 7, 175, True)]


def test_block_at_the_edge_of_a_range_stays_open():
    rows = _rows(suffix_dedup.settled(_merged(3, []), 100, 32, below=b"s" * 40))
    assert sum(not r[-1] for r in rows) == 3 * 69
    assert _rows(suffix_dedup.settled(_merged(3, []), 100, 32, above=b"t" * 40)) == rows[:1]
