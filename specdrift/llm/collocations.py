"""Phrase collocation mining with prefix-free parsing.

Pieces of texts are cut into chunks where the hash of the next three words says so (and after ``LONGEST``
words in any case); a chunk goes on for ``most_words - 1`` words into the next one. Chunks form a dictionary with
their frequencies, so a passage is parsed once however often it is repeated. Phrases are counted inside distinct
chunks, weighted; a phrase belongs to the chunk in which it starts, so what overlaps counts once.

A phrase is frequent only if all its parts are. Words are counted first, then pairs of frequent words, then
longer phrases all of whose pairs are frequent. What is frequent is told to the tasks by bits, 2 MB to 16 MB of them
however much there is: a bit that is set by chance costs a row that is counted for nothing, and
never changes a result. Scores are exact decimals.

Defined results: null and empty texts have no words; a null language is ``und``; repeated documents and rows without
a doc_id count as often as they are there; equal scores and counts are ranked by the phrase's UTF-8 bytes; empty tables give no
rows; columns but lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specdrift.llm.io import discard, stored
from specdrift.llm.terms import lowered, runs, spread, window_hashes
from specdrift.llm.textnum import _ODD, U64, mix64, rolling, sliced, utf8, word_hashes

#: One in so many places begins a chunk, and a chunk has so many words of its own at most.
SPACING, LONGEST = 32, 64
#: Least occurrences, words of a phrase, phrases of each language.
LEAST, WORDS, TOP = 30, 4, 2000
#: Bytes of chunks that are counted together.
TOGETHER = 3_000_000
#: Bits for each frequent phrase, and the most bits that are sent to the tasks.
BITS, MOST_BITS = 16, 1 << 27

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    grams = frequent(docs, lang, text, least)
    total = grams.filter("k = 0").select("lang", F.col("f").alias("n"))
    ranked = best(undominated(scored(grams), grams), top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of k words, up to four, that occur ``least`` times; k = 0 has all words' number."""
    chunks = stored(dictionary(docs, lang, text), "chunks")
    found, bits = None, None
    for sizes in ((0, 1), (2,), (3, 4)):
        if bits is not None:
            bits = chunks.sparkSession.sparkContext.broadcast(bits)
        counted = chunks.mapInArrow(_counts(sizes, bits), "lang string, phrase string, k int, f bigint")
        part = counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))
        part = stored(part, "phrases")
        bits = _bits(part.filter("k > 0"))
        found = part if found is None else found.union(part)
    discard(chunks)
    return found


def dictionary(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, own, tail, n): distinct chunks, their own words and those of the next chunk they go on for, and how often
    they occur. Words are lower-cased, each with a blank after it."""
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("body"))
    return named.mapInArrow(_chunks, "lang string, own string, tail string").groupBy("lang", "own", "tail").agg(F.count("*").alias("n"))


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts data[start:end]."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[spread(start, size)]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "body", 2_000_000):
        data, texts = lowered(batch.column("body"))
        data[texts[1:] - 1] = 0x0A
        start, end = runs(~(_BLANK | _BREAK)[data])
        if not len(start):
            continue
        broken = np.cumsum(_BREAK[data])[start]
        piece = np.flatnonzero(np.concatenate(([True], broken[1:] != broken[:-1])))
        stop = np.concatenate((piece[1:], [len(start)]))  # where each piece ends
        starts = _cuts(word_hashes(data, start, end), piece, stop)
        kept = ~(_BLANK | _BREAK)[data]
        kept[end] = True  # a blank after each word
        flat = data[kept]
        at = np.concatenate(([0], np.cumsum(end - start + 1)))
        flat[at[1:] - 1] = 0x20
        until = np.concatenate((starts[1:], [len(start)]))
        last = stop[np.searchsorted(piece, starts, "right") - 1]
        tail = np.minimum(until + WORDS - 1, last)
        own = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at[np.concatenate((starts, [len(start)]))].astype(np.int32)), pa.py_buffer(flat))
        of = np.searchsorted(texts, start[starts], "right") - 1
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(of)), own, _slices(flat, at[until], at[tail])], names=["lang", "own", "tail"])


def _cuts(words: np.ndarray, piece: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words at which chunks start: those of pieces, those whose next three words' hash says so, and every
    ``LONGEST``-th word after one of these."""
    n = len(words)
    starts = np.zeros(n, bool)
    if n >= 3:
        said = np.flatnonzero(rolling(words, 3) % U64(SPACING) == 0)
        starts[said[said + 3 <= stop[np.searchsorted(piece, said, "right") - 1]]] = True
    starts[piece] = True
    first = np.flatnonzero(starts)
    size = np.diff(np.concatenate((first, [n])))
    more = (size - 1) // LONGEST
    return np.sort(np.concatenate((first, np.repeat(first, more) + LONGEST * spread(np.ones(len(first), np.int64), more))))


def _gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``limit`` bytes of a column."""
    held, size = [], 0
    for batch in sliced(batches, column, limit):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Parsed:
    """The words of a column of texts with languages, hashed together with the language."""

    def __init__(self, lang: pa.Array, texts: pa.Array):
        self.data, self.texts = lowered(texts)
        self.start, self.end = runs(self.data != 0x20)
        self.of = np.searchsorted(self.texts, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.texts)
        code = pc.dictionary_encode(lang)
        names = np.array([_lang_hash(x) for x in code.dictionary.to_pylist()], U64)
        self.hashes = mix64(word_hashes(self.data, self.start, self.end) ^ names[code.indices.to_numpy()][self.of]) if len(names) else np.empty(0, U64)


def _lang_hash(name: str) -> int:
    data = np.frombuffer(utf8(name), np.uint8)
    return int(mix64(word_hashes(data, np.array([0]), np.array([len(data)])) * _ODD)[0]) if len(data) else 0


def _counts(sizes: tuple[int, ...], bits) -> Callable:
    """Phrases of ``sizes`` words that start in chunks, weighted; those only whose parts the bits say are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "own", TOGETHER):
            lang, own, weight = batch.column("lang"), batch.column("own"), batch.column("n").to_numpy()
            p = _Parsed(lang, pc.binary_join_element_wise(own, batch.column("tail"), ""))
            n = len(p.start)
            mine = p.start - p.texts[p.of] < np.asarray(pc.binary_length(own))[p.of]  # starts here, not in the next chunk
            last = p.first[p.of + 1]  # where its chunk's words end
            if bits is not None:
                k = 1 if sizes == (2,) else 2
                at = np.flatnonzero(np.arange(n) + k <= last)
                good = np.zeros(n + 2, bool)
                good[at] = _set(bits.value, window_hashes(p.hashes, at, k)[0])
            for size in sizes:
                if size == 0:
                    held = pc.dictionary_encode(lang)
                    sums = np.bincount(held.indices.to_numpy()[p.of[mine]], weight[p.of[mine]], len(held.dictionary))
                    yield _rows(held.dictionary, pa.array([""] * len(sums), pa.string()), 0, sums.astype(np.int64))
                    continue
                ok = mine & (np.arange(n) + size <= last)
                for j in range(size if size < 3 else size - 1) if size > 1 else ():
                    ok &= good[j : j + n]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                h, g = window_hashes(p.hashes, at, size)
                order = np.lexsort((g, h))
                h, g, at = h[order], g[order], at[order]
                lead = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
                sums = np.add.reduceat(weight[p.of[at]], lead)
                at = at[lead]
                yield _rows(lang.take(pa.array(p.of[at])), _slices(p.data, p.start[at], p.end[at + size - 1]), size, sums)

    return run


def _rows(lang: pa.Array, phrase: pa.Array, k: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(f), k, np.int32)), pa.array(f)], names=["lang", "phrase", "k", "f"])


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U64(len(bits) * 64 - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def _bits(phrases: DataFrame) -> np.ndarray:
    """A bit for each phrase's hash: ``BITS`` bits a phrase, ``MOST_BITS`` at most, in 64-bit words."""
    n = max(1, BITS * phrases.count())
    size = min(MOST_BITS, 1 << max(16, (n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, k = _Parsed(batch.column("lang"), batch.column("phrase")), batch.column("k").to_numpy()
            for width in np.unique(k).tolist():
                h = window_hashes(p.hashes, p.first[:-1][k == width], width)[0] & U64(size - 1)
                yield pa.RecordBatch.from_arrays([pa.array((h >> U64(6)).astype(np.int64)), pa.array((U64(1) << (h & U64(63))).view(np.int64))], names=["at", "word"])

    words = phrases.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(size // 64, U64)
    out[words["at"].to_numpy()] = words["word"].to_numpy(np.int64).view(U64)
    return out


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of phrases of two words or more: at the cut that scores lowest."""
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = grams.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), cut)
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    parts = grams.filter("k > 0")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as bigint)").alias("score")
    met = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "phrase", "k", "a", "cut", "l", "r", score)
    low = met.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "k", "a", "low.l", "low.r", "low.score")


def undominated(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """Candidates without those that lie in a longer one with four fifths of their occurrences or more."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = grams.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    stays = F.expr("most is null or cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
    return candidates.join(longer, ["lang", "phrase"], "left").filter(stays).drop("most")


def best(candidates: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top``, with rank: first of each of 64 parts, so that no task orders a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return part.withColumn("rank", rank).filter(F.col("rank") <= top).drop("part")
