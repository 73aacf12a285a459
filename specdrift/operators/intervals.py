"""Intervals of whole numbers that touch intervals of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _size(start: Column, end: Column) -> Column:
    """k, where the interval has up to 2^k places."""
    return F.when(end == start, 0).otherwise(F.length(F.bin(end - start)))


def _dealt(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Intervals dealt to the blocks of 2^level places they lie in, two at most for a level, at each level that a pair with
    one of the others has: that of the larger of both."""
    sizes = others.select("path", F.col("k").alias("other")).distinct()
    level = F.greatest("k", "other").alias("level")
    at = spans.join(sizes, "path").select("path", "start", "end", "k", level).distinct()
    blocks = F.sequence(F.expr("shiftright(start, level)"), F.expr("shiftright(end, level)"))
    return at.select("*", F.explode(blocks).alias("block"))


def touching(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct (path, start, end), both ends included, that share a place with one of ``others`` of their path.

    Both sides are dealt to blocks as large as the larger interval of a pair, so no path is compared as a whole; a pair meets in
    its first common block alone. Intervals that end before they start touch nothing; nulls neither.
    """
    a, b = (
        t.select("path", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).filter("path is not null and start <= end").distinct()
        .withColumn("k", _size(F.col("start"), F.col("end"))) for t in (spans, others)
    )
    left, right = _dealt(a, b), _dealt(b, a).select(*[F.col(c).alias(f"o_{c}") for c in ("path", "start", "end", "k", "level", "block")])
    same = (F.col("path") == F.col("o_path")) & (F.col("level") == F.col("o_level")) & (F.col("block") == F.col("o_block"))
    first = F.expr("block = greatest(shiftright(start, level), shiftright(o_start, level))")
    touch = (F.col("start") <= F.col("o_end")) & (F.col("end") >= F.col("o_start")) & (F.col("level") == F.greatest("k", "o_k"))
    return left.join(right, same & first & touch, "left_semi").select("path", "start", "end").distinct()
