"""Token counts of documents in flat token files, by scanning for the separator.

A token file is nothing but token ids of fixed width, little-endian, one after another; every
document ends with the end-of-document id. There is no index. The scan works in two steps.

1. Files are cut into blocks, byte ranges that are dealt over all tasks, so one large file is read by
   many. Each block is searched for the separator in one vectorised comparison and yields its number of
   tokens, the lengths of the documents that lie wholly inside, and the tokens before its first and
   after its last separator.
2. Documents that cross block boundaries are stitched by a prefix scan over the blocks of a file: a
   running sum of open tails, restarted at blocks that hold a separator, gives the tokens carried
   into each block, and a running count of separators numbers the documents.

Only block summaries are shuffled for the scan; a window runs over the blocks of one file, one row for
each ``BLOCK`` tokens. Defined results: a document that never ends (no separator up to the end of its
file) counts as a last document with ``ended`` false; empty documents (two separators in a row) count
with 0 tokens; an empty file, or a folder without files, gives no document; repeated files count one by
one. Files whose length is not a multiple of the width are refused. Files are found by Spark's reader
and read through Arrow's file systems (local, HDFS, S3 and others by their addresses).

Files are written by ``write_token_files``, a folder for each shard with the documents in order of their
id; ``file_keys`` gives the id of each document by shard and number. Null ids come first; documents that
repeat an id are interchangeable there; a null text has no token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specdrift.llm.textnum import flat_texts, sliced, word_bounds, word_hashes

#: Tokens in a block.
BLOCK = 1 << 18
#: Width in bytes to numpy type.
TYPES = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}
SUMMARY = "file string, block int, n_tokens bigint, n_ends bigint, head bigint, tail bigint, inner array<bigint>"


def _summary(file: str, block: int, tokens: np.ndarray, separator: int) -> tuple:
    """``head``: tokens before the first separator, ``tail``: after the last; a block without one is all
    tail. ``inner``: tokens of the documents between the first and the last separator."""
    ends = np.flatnonzero(tokens == separator)
    if not len(ends):
        return file, block, len(tokens), 0, 0, len(tokens), np.empty(0, np.int64)
    return file, block, len(tokens), len(ends), int(ends[0]), int(len(tokens) - 1 - ends[-1]), np.diff(ends) - 1


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "block", "n_tokens", "n_ends", "head", "tail", "inner"])


def _whole(file: str, length: int, width: int) -> None:
    if length % width:
        raise ValueError(f"{file}: {length} bytes are no whole number of {width}-byte tokens")


def blocks(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Rows (file, content binary) to one summary row for each block."""
    kind = np.dtype(TYPES[width])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"], strict=True):
                _whole(name, len(content), width)
                tokens = np.frombuffer(content, kind)
                if rows := [_summary(name, i, tokens[at : at + block], separator) for i, at in enumerate(range(0, len(tokens), block))]:
                    yield _frame(rows)

    return files.mapInPandas(scan, SUMMARY)


def scan_ranges(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """Files (file, length) to one summary row for each block; each block is a byte range of its own."""
    kind, size = np.dtype(TYPES[width]), block * width
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size).cast("bigint"))
    ranges = files.filter("length > 0").select("file", "length", F.explode(numbers).alias("block")).repartition(tasks)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, mine in batch.groupby("file", sort=False):
                length = int(mine["length"].iloc[0])
                _whole(name, length, width)
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as f:
                    rows += [_summary(name, b, np.frombuffer(f.read_at(min(size, length - b * size), b * size), kind), separator) for b in mine["block"].tolist()]
            yield _frame(rows)

    return ranges.mapInPandas(scan, SUMMARY)


def documents(summaries: DataFrame) -> DataFrame:
    """(file, document, n_tokens, ended) from block summaries; ``document`` numbers those of a file from 0.

    Windows run over the blocks of one file, whose number its size bounds.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        summaries.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        # blocks from one with a separator up to the next form a segment; its open tails add up
        .withColumn("segment", F.sum((F.col("n_ends") > 0).cast("int")).over(order))
        .withColumn("open", F.sum("tail").over(Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("is_last", F.lead("block").over(order).isNull())
    )
    closed = scanned.filter("n_ends > 0").select(
        "file", "ends_before",
        F.posexplode(F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).alias("i", "n_tokens"),
    ).select("file", (F.col("ends_before") + F.col("i")).alias("document"), "n_tokens", F.lit(True).alias("ended"))
    rest = scanned.filter("is_last and open > 0").select(
        "file", (F.col("ends_before") + F.col("n_ends")).alias("document"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended")
    )
    return closed.union(rest)


def count_tokens(spark: SparkSession, path: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``documents`` of the token files under ``path``."""
    # only names and lengths are read here, not the files
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), "length")
    return documents(scan_ranges(named, separator, width, block))


def _shard(shards: int, doc_id: str, text: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(shards)).cast("int")


def write_token_files(tokens: DataFrame, path: str, separator: int, width: int = 2, column: str = "tokens", order: str | None = None) -> None:
    """Writes a binary column of packed token ids as flat files under ``path``: one for each value of the column
    ``shard``, its documents in order of the column ``order``; without a shard, one for each partition.

    Spark's text writer puts bytes out as they are, with a line separator after each row; here that
    is the separator id. The ids must not hold the separator.
    """
    end = int(separator).to_bytes(width, "little").decode("latin-1")
    body = F.coalesce(F.col(f"`{column}`"), F.lit(b"")).cast("string").alias("value")
    if "shard" in tokens.columns:
        tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = tokens.repartition(tasks, "shard").sortWithinPartitions("shard", *[order] if order else [])
        writer = dealt.select("shard", body).write.partitionBy("shard")
    else:
        writer = tokens.select(body).write
    # one file a shard, whatever the session says of records in a file: documents are numbered by file
    writer.option("maxRecordsPerFile", 0).option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def file_keys(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, document, <doc_id>): which document is which in the files of ``word_tokens``. Both order ids of any type as they are."""
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(f"`{doc_id}`")) - 1
    return docs.select(_shard(shards, doc_id, text).alias("shard"), F.col(f"`{doc_id}`")).withColumn("document", rank.cast("bigint"))


def keyed_counts(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """(<doc_id>, n_tokens, ended): ``counts`` (shard, document, n_tokens, ended) by the keys of ``file_keys``. Each document has
    a count and each count a document; if not, the files are not those of the keys, which is an error."""
    (doc_id,) = [c for c in keys.columns if c not in ("shard", "document")]
    # both sides have a row for each document; Spark's estimate of the counts, from file names, is far too low to broadcast by
    both = counts.withColumn("__counted", F.lit(True)).hint("merge").join(keys.withColumn("__named", F.lit(True)), ["shard", "document"], "full_outer")
    met = F.col("__counted").isNotNull() & F.col("__named").isNotNull()
    return both.select(F.col(f"`{doc_id}`"), F.when(met, F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files and documents do not match")).cast("bigint")).alias("n_tokens"), "ended")


def word_tokens(docs: DataFrame, text: str = "text", vocabulary: int = 50_000, shards: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(tokens binary): each text's words hashed to 16-bit ids below ``vocabulary``; null: no token. With
    ``shards``, also the document's ``shard`` and ``key`` (its id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            data, begins = flat_texts(batch.column("t"))
            starts, ends = word_bounds(data)
            ids = (word_hashes(data, starts, ends) % np.uint64(vocabulary)).astype("<u2").tobytes()
            edges = (np.searchsorted(starts, begins) * 2).tolist()
            tokens = pa.array([ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            rest = [c for c in batch.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], tokens], names=[*rest, "tokens"])

    keyed = [_shard(shards, doc_id, text).alias("shard"), F.col(f"`{doc_id}`").alias("key")] if shards else []
    return docs.select(*keyed, F.col(f"`{text}`").alias("t")).mapInArrow(run, (f"shard int, key {docs.schema[doc_id].dataType.simpleString()}, " if shards else "") + "tokens binary")
