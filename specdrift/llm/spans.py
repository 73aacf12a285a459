"""Runs to remove from texts: settling which occurrences repeat, and applying runs to whole texts.

Shared by the operators that remove repeats. They describe an occurrence by (doc, tag, start, end, h,
g, sure): a run of a document, the hash ``tag`` of the text it was found in, and either ``sure`` (known
to repeat) or a pair of 64-bit hashes that equal runs have in common. Everything is one plan: texts
are moved to their runs once, and Spark reuses that exchange where they are needed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from specdrift.llm.textnum import mix64, sliced, with_columns

U64 = np.uint64
ROW_DDL = "doc bigint, tag int, start int, end int, h bigint, g bigint, sure boolean"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def named_texts(docs: DataFrame, text: str, doc_id: str, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rest struct, doc, tag, __body) of rows with a doc_id, and of those without; ``rest`` holds the
    columns that pass through. All have new names: an alias that the optimizer drops in one place only
    would keep it from reusing an exchange."""
    rest = [c for c in docs.columns if c not in (text, *made)]
    body = F.col(f"`{text}`").cast("string")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast("void").cast("int").alias("__none")).alias("rest"),
        F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.hash(body).alias("tag"), body.alias("__body"),
    )
    return named.filter("doc is not null"), named.filter("doc is null")


def rows_batch(doc, tag, start, end, h=None, g=None, sure=None) -> pa.RecordBatch:
    """A batch of ``ROW_DDL``. Sure rows get hashes of their own, so that they meet no others."""
    n = len(doc)
    sure = np.ones(n, bool) if sure is None else sure
    own = mix64(mix64(doc.astype(U64)) + start.astype(U64))
    h = own if h is None else np.where(sure, own, h)
    g = np.zeros(n, U64) if g is None else np.where(sure, U64(0), g)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    columns = (doc, tag, start, end, h.view(np.int64), g.view(np.int64), sure)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k, safe=False) for c, k in zip(columns, kinds, strict=True)], names=["doc", "tag", "start", "end", "h", "g", "sure"]
    )


def repeated(rows: DataFrame, *place: str) -> DataFrame:
    """(doc, spans array<struct<tag,start,end>>): the sure rows, and those whose hashes another row has that
    comes before in the order of the columns ``place``.

    Tasks have combined what they hold before: of equal runs in one batch only the first still has
    its hash in common with others, so a run that a third of all documents hold has a row for each
    batch here, not for each document.
    """
    rank = F.rank().over(Window.partitionBy("h", "g").orderBy(*place))
    gone = rows.select("doc", "tag", "start", "end", (F.col("sure") | (rank > 1)).alias("gone")).filter("gone")
    return gone.groupBy("doc").agg(F.collect_list(F.struct("tag", "start", "end")).alias("spans"))


def applied(texts: DataFrame, without: DataFrame, spans: DataFrame, finish: Callable, ddl: str) -> DataFrame:
    """The passed-through columns and those that ``finish(bytes, spans)`` makes of each text; ``spans`` is
    the flat array [from, to, ...] of its maximal runs."""
    added = StructType.fromDDL(ddl)
    both = texts.join(spans, "doc", "left").select("rest", "tag", "__body", "spans").unionByName(
        without.select("rest", "tag", "__body", F.lit(None).cast("array<struct<tag:int,start:int,end:int>>").alias("spans"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__body", 16_000_000):
            out = []
            marks = batch.column("spans")
            flat, edges = marks.flatten(), np.concatenate(([0], np.cumsum(marks.value_lengths().fill_null(0))))
            of, start, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for t, tag, a, b in zip(batch.column("__body").cast(pa.binary()).to_pylist(), batch.column("tag").to_pylist(), edges[:-1], edges[1:], strict=True):
                mine = slice(a, b) if (of[a:b] == tag).all() else a + np.flatnonzero(of[a:b] == tag)
                out.append(finish(t, united(start[mine], end[mine])))
            columns = zip(*out, strict=True)
            made = {f.name: pa.array(c, _TYPES[f.dataType.simpleString()]) for f, c in zip(added.fields, columns, strict=True)}
            yield with_columns(batch.select(["rest"]), made)

    made = both.mapInArrow(run, StructType([texts.schema["rest"], *added.fields]))
    rest = [c for c in texts.schema["rest"].dataType.names if c != "__none"]
    return made.select(*[F.col("rest").getField(c).alias(c) for c in rest], *[F.col(f"`{f.name}`") for f in added.fields])


def united(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of [start, end) runs, flat."""
    if not len(start):
        return np.empty(0, np.int64)
    order = np.argsort(start, kind="stable")
    a, reach = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    lead = np.concatenate(([True], a[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(lead)[1:] - 1, [len(a) - 1]))
    return np.stack((a[lead], reach[last]), axis=1).ravel()


def sure_runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Sure rows of runs in any order; neighbouring runs of a text become one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    text, start, end = joined_runs(np.cumsum(new) - 1, start, end)
    at = np.flatnonzero(new)[text]
    return rows_batch(doc[at], tag[at], start, end)


def joined_runs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) with runs of a text that touch or overlap united, for runs sorted by text and start."""
    if not len(text):
        return text, start, end
    far = np.maximum.accumulate(end + text.astype(np.int64) * (1 << 33))
    lead = np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] + text[1:].astype(np.int64) * (1 << 33) > far[:-1])))
    at = np.flatnonzero(lead)
    return text[lead], start[lead], np.maximum.reduceat(end, at)
