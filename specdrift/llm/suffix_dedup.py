"""Suffix-array removal of repeated byte strings: a distributed merge sort that knows common prefixes.

Every ``length``-byte string of the corpus that also starts earlier (in a smaller document, or earlier
in the same one) is a repeat; each byte that a repeat covers is removed.

The suffix array is sparse. Winnowing picks an anchor (a seed of ``seed`` bytes) in every window of
``length`` bytes, from the window's content alone, so two equal windows have equal anchors at equal
offsets. Only anchors whose seed occurs more than once in the corpus can lie in a repeat, and only
their suffixes are sorted. A suffix is compared on what the windows of its anchor span: the bytes
from the anchor on, then those before it.

1. Anchors are counted by seed hash; those that occur once are dropped.
2. Each map task sorts its suffixes (a run), cuts the run at range boundaries, and front-codes every
   piece: an entry is the length of the prefix it shares with the entry before, and the rest. Equal
   suffixes of a run are one entry. Pieces travel as one block each. Boundaries are whole suffixes, so
   suffixes that begin alike, however many, spread over ranges.
3. Each range merges its pieces with a loser tree. There are as many ranges as the text's size asks for, so what a task holds
   does not grow with the table. An entry carries the length of its common prefix
   with the last entry put out. In a match the longer common prefix wins without looking at a byte;
   equal ones are compared from that length on, and the loser keeps the length found. So no prefix
   known to be common is compared again, and the merged sequence comes with its common prefixes.
4. Entries with a common prefix of ``seed`` bytes or more form a block. In equal entries every place
   but the first repeats all its windows. The windows of a block's different entries are compared by
   two 64-bit hashes: in the task, ``CHUNK`` bytes of them at a time, and where a block goes on beyond
   the chunk or the range, each string's first place is found by a window over the hashes.

Texts are moved to their marks by one exchange, which serves the sort and the removal. Two different
strings are taken for equal with a probability of about 2**-128 for each pair.

Places are ordered by (doc_id, offset). Defined results: null texts count as empty; texts shorter
than ``length`` lose nothing; rows with a null doc_id are kept whole and are no witnesses; repeated rows
get the same result; where rows of one doc_id have different texts, a string is earlier in one than in
the other by its offset; an empty table gives no rows; other columns pass through unchanged, except
that columns named as the result's are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdrift.llm.spans import ROW_DDL, applied, joined_runs, named_texts, repeated, rows_batch, sure_runs
from specdrift.llm.textnum import anchors, byte_runs, flat_texts, inside, mix64, sliced

LENGTH = 100
SEED = 32
#: Bytes of text a map task turns into one run.
RUN_BYTES = 24_000_000
#: Bytes of text for each range at most; a task holds one range.
RANGE_BYTES = 64_000_000
#: Anchors that an indexing task holds before it sends them on.
HELD = 400_000
#: Bytes of different entries whose strings are compared at a time.
CHUNK = 2_000_000
#: For range boundaries: documents sampled, suffixes of each, and bytes of a suffix; they only balance the ranges.
SAMPLED, SAMPLED_EACH, CUT_BYTES = 8, 8, 96
U64 = np.uint64


class _Anchors:
    """The anchors of a column of texts; ``row`` numbers the texts, places count a text's bytes."""

    def __init__(self, texts: pa.Array, length: int, seed: int):
        self.data, self.begins = flat_texts(texts)
        seeds = byte_runs(self.data, seed)
        flat, first, self.count = anchors(seeds, length - seed + 1, inside(self.begins, length, 1))
        self.key = seeds[flat]
        self.row = np.searchsorted(self.begins, flat, "right") - 1
        self.at, self.first = flat - self.begins[self.row], first - self.begins[self.row]

    def keys(self, some: np.ndarray, length: int) -> Iterator[bytes]:
        """What the suffixes of some anchors are compared on. The number of bytes from the anchor on ends
        it: equal keys are split alike."""
        data, begin = self.data.tobytes(), self.begins[self.row[some]]
        at, first = begin + self.at[some], begin + self.first[some]
        for a, f, e in zip(at.tolist(), first.tolist(), (first + self.count[some] - 1 + length).tolist(), strict=True):
            yield data[a:e] + data[f:a] + (e - a).to_bytes(4, "big")


# ---------------------------------------------------------------- front coding


def front_code(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (key, places) entries as one block: shared length, rest length, places length, rest, places."""
    shared = np.zeros(len(entries), np.uint16)
    rests, last = [], b""
    for i, (key, _) in enumerate(entries):
        n = common(last, key, 0)
        shared[i] = n
        rests.append(key[n:])
        last = key
    rest_len = np.array([len(r) for r in rests], np.uint16)
    place_len = np.array([len(p) for _, p in entries], np.uint32)
    head = np.uint32(len(entries)).tobytes() + shared.tobytes() + rest_len.tobytes() + place_len.tobytes()
    return zlib.compress(head + b"".join(rests) + b"".join(p for _, p in entries), 1)


def front_decode(block: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(key, length shared with the key before, places)."""
    raw = zlib.decompress(block)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    shared = np.frombuffer(raw, np.uint16, n, 4).tolist()
    rest = np.frombuffer(raw, np.uint16, n, 4 + 2 * n).tolist()
    place = np.frombuffer(raw, np.uint32, n, 4 + 4 * n).tolist()
    at = 4 + 8 * n
    to = at + sum(rest)
    key = b""
    for s, r, p in zip(shared, rest, place, strict=True):
        key = key[:s] + raw[at : at + r]
        yield key, s, raw[to : to + p]
        at += r
        to += p


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known`` of which is known to be common."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


class LoserTree:
    """Merges sorted streams of (key, length shared with the key before in its stream, places)."""

    def __init__(self, streams: list[Iterator[tuple[bytes, int, bytes]]]):
        self.k = 1
        while self.k < len(streams):
            self.k *= 2
        self.streams = [*streams, *[iter(())] * (self.k - len(streams))]
        # by leaf: key (None at the end), length shared with the last winner, places
        self.key: list[bytes | None] = [None] * self.k
        self.lcp = [0] * self.k
        self.places = [b""] * self.k
        for i in range(self.k):
            self._advance(i)
            self.lcp[i] = 0
        self.loser = [0] * self.k
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        got = next(self.streams[i], None)
        if got is None:
            self.key[i] = None
        else:
            self.key[i], self.lcp[i], self.places[i] = got

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = self._match(a, b)
        return win

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes what it shares with the winner."""
        ka, kb = self.key[a], self.key[b]
        if kb is None:
            return a, b
        if ka is None:
            return b, a
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            # the one that shares more with the last winner comes first, and the other shares with
            # it what it shared before
            return (a, b) if la > lb else (b, a)
        n = common(ka, kb, la)
        if ka[n:] <= kb[n:]:
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, length shared with the key put out before, places)."""
        key, lcp, loser, match = self.key, self.lcp, self.loser, self._match
        while (first := key[self.winner]) is not None:
            w = self.winner
            yield first, lcp[w], self.places[w]
            self._advance(w)
            node = (w + self.k) >> 1
            while node:
                w, loser[node] = match(w, loser[node])
                node >>= 1
            self.winner = w


# ---------------------------------------------------------------- places


#: A place as bytes that sort by document and offset.
_PLACE = np.dtype([("doc", ">u8"), ("at", ">u4"), ("first", ">u4"), ("count", ">u4"), ("tag", ">i4")])
_WIDTH, _WHERE = _PLACE.itemsize, 12
_SIGN = U64(1 << 63)


def places(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[bytes]:
    out = np.empty(len(doc), _PLACE)
    out["doc"], out["tag"], out["at"], out["first"], out["count"] = doc.astype(np.int64).view(U64) ^ _SIGN, tag, at, first, count
    raw = out.tobytes()
    return [raw[i : i + _WIDTH] for i in range(0, len(raw), _WIDTH)]


def fields(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, tag, at, first, count) of places."""
    found = np.frombuffer(b"".join(raw), _PLACE)
    doc = (found["doc"].astype(U64) ^ _SIGN).view(np.int64)
    return doc, *(found[f].astype(np.int64) for f in ("tag", "at", "first", "count"))


def _later(raw: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The first place of equal entries, and those of the others that start later. The same place in
    another text of the same document stays beside the first."""
    if len(raw) == 1:
        return raw, []
    lead = min(raw)
    return sorted({r for r in raw if r[:_WHERE] == lead[:_WHERE]}), [r for r in raw if r[:_WHERE] != lead[:_WHERE]]


def _runs(raw: list[bytes], length: int) -> pa.RecordBatch:
    """Sure rows of all windows of the places."""
    doc, tag, _, first, count = fields(raw)
    return sure_runs(doc, tag, first, first + count - 1 + length)


class _Settler:
    """Finds repeats among the strings of different entries, block by block."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.keys: list[bytes] = []
        self.raws: list[bytes] = []
        self.blocks: list[int] = []
        self.later: list[bytes] = []
        self.size = 0

    def add(self, block: int, key: bytes, raw: list[bytes]) -> None:
        lead, later = _later(raw)
        self.later += later
        for r in lead:
            self.keys.append(key)
            self.raws.append(r)
            self.blocks.append(block)
        self.size += len(lead) * len(key) + len(later) * _WIDTH

    def drop(self) -> None:
        """Forgets the last entry."""
        self.size -= len(self.keys.pop())
        self.raws.pop(), self.blocks.pop()

    def settle(self, unclosed: set[int]) -> Iterator[pa.RecordBatch]:
        """Rows of what is held: repeats, and for blocks of which more is to come elsewhere the first place
        of each string, with its hashes."""
        if self.later:
            yield _runs(self.later, self.length)
        if self.keys:
            yield from self._strings(unclosed)
        self.clear()

    def _strings(self, unclosed: set[int]) -> Iterator[pa.RecordBatch]:
        n = self.length
        doc, tag, at, first, count = fields(self.raws)
        order = np.lexsort((first, doc))  # strings then come in order of their places
        right = (first + count - 1 + n - at)[order].tolist()
        keys = [self.keys[i] for i in order.tolist()]
        doc, tag, first, block = doc[order], tag[order], first[order], np.array(self.blocks)[order]
        data = np.frombuffer(b"".join([k[r:-4] + k[:r] for k, r in zip(keys, right, strict=True)]), np.uint8)
        begins = np.concatenate(([0], np.cumsum(count[order] - 1 + n)))
        at = inside(begins, n)
        entry = np.searchsorted(begins, at, "right") - 1
        h, g = byte_runs(data, n)[at], byte_runs(data ^ np.uint8(0x5A), n)[at]
        start = first[entry] + (at - begins[entry])
        key = mix64(h) + mix64(block.astype(U64))[entry]
        texts_differ = ((doc[1:] == doc[:-1]) & (tag[1:] != tag[:-1])).any()
        by = np.lexsort((start, doc[entry], key)) if texts_differ else np.argsort(key, kind="stable")
        hs, gs, bs = h[by], g[by], block[entry[by]]
        lead = np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1]) | (bs[1:] != bs[:-1])))
        owner = np.empty(len(at), np.int64)
        owner[by] = by[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        gone = (doc[entry] != doc[entry[owner]]) | (start != start[owner])
        if gone.any():
            e, s, t = joined_runs(entry[gone], start[gone], start[gone] + n)
            yield rows_batch(doc[e], tag[e], s, t)
        if unclosed:
            left = ~gone & np.isin(block, list(unclosed))[entry]
            if left.any():
                e = entry[left]
                yield rows_batch(doc[e], tag[e], start[left], start[left] + n, h[left], g[left], np.zeros(len(e), bool))


def settled(merged: Iterator[tuple[bytes, int, bytes]], length: int, seed: int, below: bytes = b"", above: bytes | None = None,
            chunk: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROW_DDL`` of the merged suffixes of the range from ``below`` to ``above``. No more than about
    ``chunk`` bytes of entries are held: a block that has more is put out piece by piece."""
    chunk = CHUNK if chunk is None else chunk
    settler = _Settler(length)
    same: list[bytes] = []
    last = first = b""
    block, size, unclosed = 0, 0, set()

    def cut_off(edge: bytes | None) -> bool:
        """Whether the block may go on beyond an edge of the range."""
        return bool(edge) and first[:seed] == edge[:seed]

    for key, shared, raw in merged:
        if same and shared == len(key) == len(last):
            same += [raw[i : i + _WIDTH] for i in range(0, len(raw), _WIDTH)]
            if len(same) * _WIDTH > chunk:
                same, later = _later(same)
                if later:
                    yield _runs(later, length)
            continue
        if same:
            settler.add(block, last, same)
            size += 1
            full = settler.size > chunk
            if shared < seed:
                if cut_off(below):
                    unclosed.add(block)
                elif size == 1 and len(settler.keys) and block not in unclosed:
                    settler.drop()  # a block of one entry has no string to compare
                block, size = block + 1, 0
            elif full:
                unclosed.add(block)
            if full:
                yield from settler.settle(unclosed)
                unclosed = {block} if size else set()
        if not size:
            first = key
        same, last = [raw[i : i + _WIDTH] for i in range(0, len(raw), _WIDTH)], key
    if same:
        settler.add(block, last, same)
        if cut_off(below) or cut_off(above):
            unclosed.add(block)
    yield from settler.settle(unclosed)


def _boundaries(docs: DataFrame, total: int, ranges: int, length: int, seed: int) -> list[bytes]:
    """Keys that cut the sorted suffixes into ranges of about equal size, from a sample of ``SAMPLED``
    documents and up to ``SAMPLED_EACH`` suffixes of each for every range; ``total`` is the number of documents."""
    sample = docs.sample(min(1.0, SAMPLED * ranges / max(1, total)), seed=7).select("__body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__body"):
            a = _Anchors(batch.column("__body"), length, seed)
            rank = np.arange(len(a.row)) - np.searchsorted(a.row, a.row)
            some = np.lexsort((mix64(a.key), a.row))[rank < SAMPLED_EACH]
            yield pa.RecordBatch.from_arrays([pa.array([k[:CUT_BYTES] for k in a.keys(some, length)], pa.binary())], names=["k"])

    keys = sorted(bytes(r["k"]) for r in sample.mapInArrow(run, "k binary").toLocalIterator())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _index(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, doc, at, n): seed hashes of the anchors, with how often a task has seen them (2 for more)."""

    def flush(held: list) -> pa.RecordBatch:
        key, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, doc, at = key[order], doc[order], at[order]
        lead = np.concatenate(([True], key[1:] != key[:-1]))
        size = np.diff(np.concatenate((np.flatnonzero(lead), [len(key)])))
        # one row of a seed counts for all that the task holds; the others, known to repeat, pass
        # through under keys of their own
        n = np.full(len(key), 2)
        n[lead] = np.minimum(size, 2)
        columns = (np.where(lead, key, mix64(mix64(doc.astype(U64)) + at.astype(U64))).view(np.int64), doc, at.astype(np.int32), n.astype(np.int8))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, "__body"):
            a = _Anchors(batch.column("__body"), length, seed)
            if len(a.at):
                held.append((a.key, batch.column("doc").to_numpy()[a.row], a.at))
                size += len(a.at)
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "key bigint, doc bigint, at int, n tinyint")


def _occurrences(texts: DataFrame, cuts: list[bytes], length: int, seed: int, chunk: int) -> DataFrame:
    """``ROW_DDL`` of the repeats of marked anchors (rest, doc, tag, __body, chosen)."""
    ddl = f"range int, block binary, {ROW_DDL}"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts: list[list[tuple[bytes, bytes]]] = [[] for _ in range(len(cuts) + 1)]
            later: list[bytes] = []
            for key in sorted(held):
                # only the first place of equal suffixes travels; the others repeat it
                lead, others = _later(held[key])
                later += others
                parts[bisect.bisect_right(cuts, key[:CUT_BYTES])].append((key, b"".join(lead)))
            full = [(i, front_code(p)) for i, p in enumerate(parts) if p]
            rows = rows_batch(*[np.zeros(0, np.int64)] * 4)
            for i, block in full:
                columns = [pa.array([i], pa.int32()), pa.array([block], pa.binary()), *[pa.nulls(1, c.type) for c in rows.columns]]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", *rows.schema.names])
            if later:
                found = _runs(later, length)
                spread = pa.array((found.column("doc").to_numpy() % (len(cuts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([spread, pa.nulls(found.num_rows, pa.binary()), *found.columns], names=["range", "block", *found.schema.names])

        for batch in sliced(batches, "__body"):
            a = _Anchors(batch.column("__body"), length, seed)
            chosen = batch.column("chosen")
            row = np.repeat(np.arange(len(chosen)), chosen.value_lengths())
            some = np.flatnonzero(np.isin((a.row.astype(np.int64) << 32) + a.at, (row << 32) + chosen.flatten().to_numpy()))
            doc, tag = (batch.column(c).to_numpy()[a.row[some]] for c in ("doc", "tag"))
            for key, place in zip(a.keys(some, length), places(doc, tag, a.at[some], a.first[some], a.count[some]), strict=True):
                held.setdefault(key, []).append(place)
            size += batch.column("__body").nbytes
            if size > RUN_BYTES:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[bytes]] = {}
        for batch in batches:
            coded = batch.column("block").is_valid()
            some = batch.filter(coded)
            for r, block in zip(some.column("range").to_pylist(), some.column("block").to_pylist(), strict=True):
                pieces.setdefault(r, []).append(block)
            yield batch.filter(pc.invert(coded)).drop_columns(["range", "block"])
        for r in sorted(pieces):
            below, above = cuts[r - 1] if r else b"", cuts[r] if r < len(cuts) else None
            yield from settled(LoserTree([front_decode(b) for b in pieces.pop(r)]), length, seed, below, above, chunk)

    return texts.mapInArrow(runs, ddl).repartitionById(len(cuts) + 1, "range").mapInArrow(merge, ROW_DDL)


def find(docs: DataFrame, finish: Callable, ddl: str, length: int = LENGTH, seed: int = SEED,
         text: str = "text", doc_id: str = "doc_id", ranges: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` without its text, with what ``finish(bytes or None, spans)`` makes of each text and its
    repeats: ``spans`` is the flat array [from, to, ...] of maximal removed runs of bytes, and the result
    is a tuple of the columns named in ``ddl`` (bigint, int or string)."""
    texts, without = named_texts(docs, text, doc_id, [f.split()[0].strip("`") for f in ddl.split(",")])
    body = texts.select("doc", "__body")
    total, size = body.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__body")), F.lit(0))).first()
    ranges = ranges or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    again = _index(body, length, seed).selectExpr("doc", "at", "sum(n) OVER (PARTITION BY key) AS n").filter("n > 1")
    chosen = again.groupBy("doc").agg(F.collect_list("at").alias("chosen"))
    # all columns go along, so that Spark can reuse the exchange of the texts
    met = texts.join(chosen, "doc").select("rest", "doc", "tag", "__body", "chosen")
    found = _occurrences(met, _boundaries(body, total, ranges, length, seed), length, seed, chunk)
    return applied(texts, without, repeated(found, "doc", "start"), finish, ddl)


def digest(data: bytes | None, spans: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the SHA-256 of the bytes that remain."""
    data = data or b""
    out, at = [], 0
    for a, b in zip(spans[0::2].tolist(), spans[1::2].tolist(), strict=True):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    kept = b"".join(out)
    return len(data), len(data) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest()
