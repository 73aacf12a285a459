"""What source tables say of their symbols: notes above them, and what is exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdrift.functions.comments import note
from specdrift.operators.context import attached_note
from specdrift.operators.walks import inherited


def source_notes(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file, anchor, first, raw, text, eligible, blocked_by): the line comments directly above each anchor line, their
    words, and whether documentation may take their place."""
    found = attached_note(lines, anchors).withColumnRenamed("text", "raw").withColumn("n", note(F.col("raw")))
    return found.select("file", "anchor", "first", "raw", "n.text", "n.eligible", "n.blocked_by")


def exported_members(symbols: DataFrame) -> DataFrame:
    """(symbol, exported) from symbols (symbol, container, exported, visibility): a symbol without a container is exported if it is
    declared so; a member if it is public and its container is exported, at any depth."""
    own = F.when(F.col("container").isNull(), F.col("exported")).otherwise(F.col("visibility") == "public")
    return inherited(symbols.select(F.col("symbol").alias("node"), F.col("container").alias("parent"), own.alias("own"))).withColumnsRenamed({"node": "symbol", "value": "exported"})
