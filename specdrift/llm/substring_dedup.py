"""Substring removal by seed and extend, on words.

A window is ``length`` consecutive words of one document. Windows that also start in a document of
smaller doc_id are repeats; every word that a repeat covers is removed.

Seeds are runs of ``seed`` words. Winnowing picks one for each window (its anchor) from what is in the
window alone, so equal windows have equal anchors at equal offsets. Documents are joined on their
anchors. An anchor stands for the run of windows that chose it, and that run of words, to the left
and right of the seed, is its reach:

* two occurrences whose reaches are equal match over all of it: the match is extended both ways to
  the end of the reach in one comparison, and the one in the larger document is removed;
* where occurrences of an anchor differ in their reach, they are extended window by window: only
  the windows of these anchors are joined, and the least document of each is found.

Neighbouring matched windows unite to maximal repeats of ``length`` words or more. No pair of
occurrences is ever formed: each key only needs its least document. Tasks shorten what they send to
one occurrence for each anchor and reach, so a passage or a group of copies in a third of all
documents reaches the shuffle once for each task. Texts are moved to their marks by one exchange,
which serves both the extension and the removal; nothing is written in between.

Hashes are 64 bit and are compared in pairs (anchor and reach, anchor and window), so that two
different runs of words are taken for equal with a probability of about 2**-128 for each pair.

Defined results: null texts count as empty; texts shorter than a window lose nothing; rows with a
null doc_id are kept whole and are no witnesses; repeated rows get the same result; where rows of
one doc_id have different texts, each is judged against smaller doc_ids only; an empty table gives
no rows; other columns pass through unchanged, except that columns named as the result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdrift.llm.spans import ROW_DDL, applied, joined_runs, named_texts, repeated, rows_batch, sure_runs
from specdrift.llm.textnum import anchors, flat_texts, inside, mix64, rolling, sliced, word_bounds, word_hashes

LENGTH = 13
SEED = 5
#: Anchors, and windows left to compare, that a task holds before it sends them on.
HELD = 400_000
U64 = np.uint64
_K = U64(0x9E3779B97F4A7C15)
#: What is known of an anchor's occurrence: its reach was seen in a smaller document, or is to be extended window by window.
SEEN, OPEN = 1, 2


class _Anchors:
    """The anchors of a column of texts; ``row`` numbers the texts, places count a text's words."""

    def __init__(self, texts: pa.Array, length: int, seed: int):
        data, begins = flat_texts(texts)
        starts, ends = word_bounds(data)
        words = word_hashes(data, starts, ends)
        begins = np.searchsorted(starts, begins)
        seeds = rolling(words, seed)
        at, self.flat_first, self.count = anchors(seeds, length - seed + 1, inside(begins, length))
        self.key = seeds[at]
        self.windows = rolling(words, length)
        self.row = np.searchsorted(begins, at, "right") - 1
        self.at, self.first = at - begins[self.row], self.flat_first - begins[self.row]
        last = self.flat_first + self.count - 1
        self.reach = mix64(
            (self.windows[self.flat_first] * _K + self.windows[last]) * _K
            + (at - self.flat_first).astype(U64) * U64(1 << 32)
            + self.count.astype(U64)
        ) if len(at) else np.empty(0, U64)


def _index(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, reach, doc, at): ``at`` is 2 * position, plus 1 where a smaller document of the same task
    has the same reach (such rows get a key of their own and only pass through)."""

    def flush(held: list) -> pa.RecordBatch:
        key, reach, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, reach, key))
        key, reach, doc, at = key[order], reach[order], doc[order], at[order]
        lead = np.concatenate(([True], (key[1:] != key[:-1]) | (reach[1:] != reach[:-1])))
        seen = doc > doc[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        own = mix64(mix64(doc.astype(U64)) + at.astype(U64))
        columns = (np.where(seen, own, key).view(np.int64), reach.view(np.int64), doc, (at * 2 + seen).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "reach", "doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, "__body"):
            a = _Anchors(batch.column("__body"), length, seed)
            if len(a.at):
                held.append((a.key, a.reach, batch.column("doc").to_numpy()[a.row], a.at))
                size += len(a.at)
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "key bigint, reach bigint, doc bigint, at int")


def _known(index: DataFrame) -> DataFrame:
    """(doc, known array<bigint>) of the anchors that repeat: position, 32 bits of the reach (the mark is for
    texts that have it there), and SEEN or OPEN."""
    by_reach = "min(doc) OVER (PARTITION BY key, reach)"
    by_key = "{}({}) OVER (PARTITION BY key)"
    marked = index.selectExpr(
        "doc", "at", "reach", f"doc > {by_reach} AS later",
        f"{by_key.format('min', 'doc')} <> {by_key.format('max', 'doc')} AS apart",
        f"{by_key.format('min', 'reach')} <> {by_key.format('max', 'reach')} AS differ",
    )
    code = F.when((F.col("at") % 2 == 1) | F.col("later"), SEEN).when(F.col("apart") & F.col("differ"), OPEN)
    place = F.shiftleft(F.floor(F.col("at") / 2).cast("bigint"), 34) + F.shiftleft(F.col("reach").bitwiseAND(F.lit(0xFFFFFFFF)), 2)
    found = marked.select("doc", place.alias("place"), code.alias("code")).filter("code is not null")
    return found.groupBy("doc").agg(F.collect_list(F.col("place") + F.col("code")).alias("known"))


def _occurrences(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """The runs of marked anchors (rest, doc, tag, __body, known): reaches that were seen before, and single
    windows of the others."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        doc, tag, start, h, g = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, g, h))
        doc, tag, start, h, g = doc[order], tag[order], start[order], h[order], g[order]
        lead = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        sure = doc > doc[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        if sure.any():
            yield sure_runs(doc[sure], tag[sure], start[sure], start[sure] + length)
        left = ~sure
        yield rows_batch(doc[left], tag[left], start[left], start[left] + length, h[left], g[left], np.zeros(left.sum(), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, "__body"):
            a = _Anchors(batch.column("__body"), length, seed)
            known = batch.column("known")
            marks, row = known.flatten().to_numpy(), np.repeat(np.arange(len(known)), known.value_lengths())
            order = np.lexsort((marks, row))
            marks, row = marks[order], row[order]
            # find each mark's anchor: places are unique in a text, and both sides are in order
            place = (row << 32) + (marks >> 34)
            mine = (a.row.astype(np.int64) << 32) + a.at
            i = np.minimum(np.searchsorted(mine, place), max(0, len(mine) - 1))
            fits = (mine[i] == place) & (a.reach[i] & U64(0xFFFFFFFF) == (marks >> 2 & 0xFFFFFFFF).astype(U64)) if len(mine) else np.zeros(len(place), bool)
            i, code = i[fits], marks[fits] & 3
            # one that is marked both ways (repeated rows) counts as seen
            first = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.empty(0, bool)
            i, code = i[first], code[first]
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            s = i[code == SEEN]
            if len(s):
                text, start, end = joined_runs(a.row[s], a.first[s], a.first[s] + a.count[s] - 1 + length)
                yield rows_batch(doc[text], tag[text], start, end)
            o = i[code == OPEN]
            if len(o):
                count = a.count[o]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text = np.repeat(a.row[o], count)
                held.append((
                    doc[text], tag[text], np.repeat(a.first[o], count) + step,
                    a.windows[np.repeat(a.flat_first[o], count) + step], np.repeat(a.key[o], count),
                ))
                size += len(text)
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return texts.mapInArrow(run, ROW_DDL)


def find(docs: DataFrame, finish: Callable, ddl: str, length: int = LENGTH, seed: int = SEED,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with what ``finish`` makes of each text and its repeats.

    ``finish(bytes or None, spans)`` gets the flat array of word numbers [from, to, ...] of the maximal
    repeats and returns a tuple of the columns named in ``ddl`` (bigint, int or string).
    """
    texts, without = named_texts(docs, text, doc_id, [f.split()[0].strip("`") for f in ddl.split(",")])
    known = _known(_index(texts.select("doc", "__body"), length, seed))
    # all columns go along, so that Spark can reuse the exchange of the texts
    met = texts.join(known, "doc").select("rest", "doc", "tag", "__body", "known")
    return applied(texts, without, repeated(_occurrences(met, length, seed), "doc"), finish, ddl)


def digest(text: bytes | None, spans: np.ndarray) -> tuple[int, int, str]:
    """n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    words = (text or b"").split()
    if len(spans):
        keep = np.ones(len(words), bool)
        for a, b in zip(spans[0::2], spans[1::2], strict=True):
            keep[a:b] = False
        kept = list(compress(words, keep.tolist()))
    else:
        kept = words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def cleaned(text: bytes | str | None, spans: np.ndarray) -> tuple[str | None]:
    """The text without its repeats: from the first word removed up to the next word kept. Texts
    without a repeat stay as they are."""
    if text is None:
        return (None,)
    text = text.encode() if isinstance(text, str) else text
    starts, ends = word_bounds(np.frombuffer(text, np.uint8))
    out, at = [], 0
    for a, b in zip(spans[0::2], spans[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    out.append(text[at:])
    return (b"".join(out).decode("utf-8", "replace"),)
