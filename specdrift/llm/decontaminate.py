"""Benchmark decontamination by winnowing.

Of each window of ``window`` words the leftmost least ``seed``-word hash is kept as its fingerprint. Equal
windows keep equal fingerprints, so no shared span of ``window`` words or more is missed. Fingerprints of
documents and benchmark are joined; around each hit all windows that chose it are compared with those
of the benchmark, by two 64-bit hashes, and those that match join to spans, so a hit extends as far to both sides
as the texts agree. An item of fewer words is one window, and its own fingerprint.

The benchmark's distinct windows are counted first. Up to ``most`` of them (40 bytes each) are sent to all tasks,
and documents are not moved at all; beyond, documents' fingerprints are joined with the benchmark's by a shuffle,
and only texts with a hit go on. Both ways give the same rows. Which items a document holds is told by
sets: windows that occur in the same items share one set, documents with the same sets share one
list, so a passage of many items in many documents is listed once.

Defined results: null and empty texts have no words and no hit; null and empty items, and items without an id,
take no part; rows that repeat an item id count as one item, and no window crosses rows; repeated
documents, also rows without a doc_id, are each told; an empty benchmark hits nothing; other columns pass
through, those named like a made one give way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.llm.io import discard, stored
from specdrift.llm.terms import Terms, lists, runs, spread, window_hashes
from specdrift.llm.textnum import anchors, inside, rolling, sliced, with_columns

WINDOW, SEED = 10, 5
#: Windows of the benchmark that are sent to every task at most.
MOST = 1_000_000
MADE = ("n_words", "hits", "items")
_HITS = "array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def find(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, seed: int = SEED, most: int = MOST,
) -> DataFrame:
    """All columns of ``docs`` but the text, with n_words bigint, hits array<struct<start,end>> (maximal runs of words that
    lie in windows of the benchmark) and items array<string> (ids of the items these windows are of, in order)."""
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("body"))
    each = own.filter("item is not null").mapInArrow(_of_items(window, seed), "item string, width int, seed bigint, h bigint, g bigint")
    sets = F.array_sort(F.collect_set("item"))
    windows = each.groupBy("width", "h", "g").agg(F.min("seed").alias("seed"), sets.alias("items"))
    windows = stored(windows.withColumn("set", F.xxhash64("items")), "windows")
    rest = [c for c in docs.columns if c not in (text, *MADE)]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("int").alias("__none"))
    named = docs.select(whole.alias("rest"), F.col(f"`{text}`").cast("string").alias("body"))
    found = _sent(named, windows, window, seed) if windows.count() <= most else _shuffled(named, windows, window, seed)
    # a third of the documents may hold the same sets; those without any are dealt by their own columns, and meet none
    key = F.when(F.size("sets") > 0, F.xxhash64("sets")).otherwise(F.xxhash64("rest", F.lit(1)))
    found = stored(found.withColumn("key", key), "found")
    one = windows.groupBy("set").agg(F.first("items").alias("items"))
    distinct = found.filter("size(sets) > 0").select("key", "sets").distinct().select("key", F.explode("sets").alias("set"))
    named_by = distinct.join(one, "set").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = found.join(named_by, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(*[F.col("rest").getField(c).alias(c) for c in rest], *MADE)


def digests(found: DataFrame) -> list[Column]:
    """n_words, n_hit, n_items, items_sha256 and contaminated of rows from ``find``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return [
        F.col("n_words"), n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    ]


def _anchored(t: Terms, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the texts' windows: hash, first window that chose it, how many did."""
    seeds = rolling(t.hashes, seed)
    at, first, many = anchors(seeds, window - seed + 1, inside(t.first, window))
    return seeds[at], first, many


def _of_items(window: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            t = Terms(batch.column("body"))
            prints, first, many = _anchored(t, window, seed)
            parts = [(window, np.repeat(prints, many), spread(first, many))]
            for width in np.unique(t.sizes[(t.sizes > 0) & (t.sizes < window)]).tolist():
                at = t.first[:-1][t.sizes == width]
                parts.append((width, rolling(t.hashes, width)[at], at))
            for width, chosen, at in parts:
                h, g = window_hashes(t.hashes, at, width)
                of = np.searchsorted(t.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(of)), pa.array(np.full(len(at), width, np.int32)), *(pa.array(x.view(np.int64)) for x in (chosen, h, g))],
                    names=["item", "width", "seed", "h", "g"],
                )

    return run


def _covered(t: Terms, at: np.ndarray, width: np.ndarray) -> pa.ListArray:
    """For each text its maximal runs of words inside one of the windows."""
    edge = np.zeros(len(t.hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    hit = np.cumsum(edge[:-1]) > 0
    start, end = runs(hit)
    # runs of two texts may touch
    cut = t.first[1:-1]
    cut = cut[(cut > 0) & (cut < len(hit))]
    cut = np.unique(cut[hit[cut] & hit[cut - 1]])
    start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    of = np.searchsorted(t.first, start, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((x - t.first[of]).astype(np.int32)) for x in (start, end)], fields=list(_SPAN))
    return lists(np.bincount(of, minlength=len(t.sizes)), spans)


def _sent(named: DataFrame, windows: DataFrame, window: int, seed: int) -> DataFrame:
    """The documents met with all windows of the benchmark, which every task has."""
    rows = windows.select("width", "seed", "h", "g", "set").toPandas()
    known = {}
    for width, part in rows.groupby("width"):
        part = part.sort_values(["h", "g"])
        h, g = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "g"))
        order = np.argsort(h, kind="stable")
        same = int(np.unique(h, return_counts=True)[1].max())
        known[int(width)] = (np.unique(part["seed"].to_numpy(np.int64).view(np.uint64)), h[order], g[order], part["set"].to_numpy(np.int64)[order], same)
    held = named.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            t = Terms(batch.column("body"))
            met = []
            for width, (prints, hs, gs, sets, same) in held.value.items():
                if width == window:
                    chosen, first, many = _anchored(t, window, seed)
                    hit = _member(chosen, prints)
                    at = spread(first[hit], many[hit])
                else:
                    at = inside(t.first, width)
                    at = at[_member(rolling(t.hashes, width)[at], prints)]
                h, g = window_hashes(t.hashes, at, width)
                place = np.searchsorted(hs, h)
                for step in range(same):  # windows whose first hashes are equal
                    i = np.minimum(place + step, len(hs) - 1)
                    ok = (hs[i] == h) & (gs[i] == g)
                    met.append((at[ok], np.full(ok.sum(), width), sets[i[ok]]))
            at, width, sets = (np.concatenate([m[i] for m in met] or [np.empty(0, np.int64)]) for i in range(3))
            of = np.searchsorted(t.first, at, "right") - 1
            pairs = np.unique(np.stack((of, sets), axis=1), axis=0) if len(of) else np.empty((0, 2), np.int64)
            yield with_columns(batch.select(["rest"]), {
                "n_words": pa.array(t.sizes.astype(np.int64)), "hits": _covered(t, at, width),
                "sets": lists(np.bincount(pairs[:, 0], minlength=len(t.sizes)), pa.array(pairs[:, 1])),
            })

    return named.mapInArrow(run, f"rest {named.schema['rest'].dataType.simpleString()}, n_words bigint, hits {_HITS}, sets array<bigint>")


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _shuffled(named: DataFrame, windows: DataFrame, window: int, seed: int) -> DataFrame:
    """The documents met with the benchmark by joins on fingerprints and on windows. A text stands for all its copies."""
    widths = [int(w) for (w,) in windows.select("width").distinct().collect()]
    named = named.withColumns({"k": F.xxhash64("body"), "l": F.xxhash64(F.lit(1), "body")})
    texts = named.filter("body is not null").dropDuplicates(["k", "l"]).select("k", "l", "body")
    places = "k bigint, l bigint, width int, first int, many int, seed bigint"
    met = texts.mapInArrow(_prints(widths, window, seed), places).join(windows.select("width", "seed").distinct(), ["width", "seed"], "left_semi")
    per = met.groupBy("k", "l").agg(F.collect_list(F.struct("width", "first", "many")).alias("at"))
    tried = texts.join(per, ["k", "l"]).mapInArrow(_around_hits, "k bigint, l bigint, width int, first int, h bigint, g bigint")
    same = tried.join(windows.select("width", "h", "g", "set"), ["width", "h", "g"])
    per = same.groupBy("k", "l").agg(F.collect_set(F.struct("width", "first")).alias("at"), F.array_sort(F.collect_set("set")).alias("sets"))
    none = F.array().cast("array<bigint>")
    both = named.join(per, ["k", "l"], "left").select("rest", "body", "at", F.coalesce("sets", none).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            t, at = Terms(batch.column("body")), batch.column("at")
            of = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths().fill_null(0)))
            width, first = (at.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            made = {"n_words": pa.array(t.sizes.astype(np.int64)), "hits": _covered(t, t.first[of] + first, width)}
            yield with_columns(batch.select(["rest", "sets"]), made)

    out = both.mapInArrow(run, f"rest {named.schema['rest'].dataType.simpleString()}, sets array<bigint>, n_words bigint, hits {_HITS}")
    return out.select("rest", "n_words", "hits", "sets")


def _prints(widths: list[int], window: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            t = Terms(batch.column("body"))
            for width in widths:
                if width == window:
                    chosen, first, many = _anchored(t, window, seed)
                else:
                    first = inside(t.first, width)
                    chosen, many = rolling(t.hashes, width)[first], np.ones(len(first), np.int64)
                of = np.searchsorted(t.first, first, "right") - 1
                at, key = pa.array(of), [batch.column(c) for c in ("k", "l")]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in key), *(pa.array(x.astype(np.int32)) for x in (np.full(len(of), width), first - t.first[of], many)), pa.array(chosen.view(np.int64))],
                    names=["k", "l", "width", "first", "many", "seed"],
                )

    return run


def _around_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows that chose one of the fingerprints ``at``."""
    for batch in sliced(batches, "body"):
        t, at = Terms(batch.column("body")), batch.column("at")
        of = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths()))
        width, first, many = (at.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        for w in np.unique(width).tolist():
            mine = width == w
            start, owner = spread(t.first[of[mine]] + first[mine], many[mine]), np.repeat(of[mine], many[mine])
            h, g = window_hashes(t.hashes, start, w)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(rows), batch.column("l").take(rows), *(pa.array(x.astype(np.int32)) for x in (np.full(len(start), w), start - t.first[owner])), *(pa.array(x.view(np.int64)) for x in (h, g))],
                names=["k", "l", "width", "first", "h", "g"],
            )
