"""Reports of a check as rows, so that they are written in parallel: text lines, JSON, SARIF; and the
baseline as JSON entries, out and in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.functions.text import file_of
from specdrift.operators.classify import STATUSES, status_summary


def human(results: DataFrame, issues: DataFrame) -> DataFrame:
    """(part, line): a line for each issue, and one with the counts of all results (part 1, the last)."""
    line = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), F.col("status"), F.lit(" "), F.col("id"))
    counts = F.concat(*[x for s in ("drifted", "missing", "orphaned", "unchanged") for x in (F.col(s).cast("string"), F.lit(f" {s}" + (", " if s != "unchanged" else ".")))])
    return issues.select(F.lit(0).alias("part"), line.alias("line")).union(status_summary(results).select(F.lit(1), counts))


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _row() -> Column:
    return _json(F.col("id"), F.col("status"), F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"))


def as_json(results: DataFrame, issues: DataFrame) -> DataFrame:
    """(part, json): the summary, and one object for each issue and each result."""
    summary = status_summary(results).select(F.lit("summary").alias("part"), _json(*STATUSES).alias("json"))
    return summary.union(issues.select(F.lit("issues"), _row())).union(results.select(F.lit("results"), _row()))


def sarif(issues: DataFrame) -> DataFrame:
    """(json): a SARIF 2.1.0 result object for each issue; drift is an error, all else a warning."""
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return issues.select(_json(
        F.col("status").alias("ruleId"), F.when(F.col("status") == "drifted", "error").otherwise("warning").alias("level"),
        F.struct(F.concat("id", F.lit(" is "), "status").alias("text")).alias("message"), F.array(place).alias("locations"),
    ).alias("json"))


def sarif_head(tool: str = "specdrift") -> dict:
    """What stands around the result objects."""
    rules = [{"id": s, "shortDescription": {"text": f"Documentation {s}"}} for s in ("drifted", "missing", "orphaned")]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": []}]}


def baseline_out(entries: DataFrame) -> DataFrame:
    """(id, entry): each baseline entry as JSON; written by Spark's committer, which replaces a table as a whole."""
    return entries.select("id", _json(F.col("symbol_hash").alias("symbolHash"), F.col("doc_hash").alias("docHash"), F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("project")).alias("entry"))


def baseline_in(entries: DataFrame, version: int = 2, supported: int = 2) -> DataFrame:
    """JSON entries (id, entry) to rows (id, symbol_hash, doc_hash, file_path, start_line, project, valid).

    Names in snake case are read too; the file defaults to the one in the id, the line to 1. Entries
    without a hash, or with a line that is no whole number from 1 on, are not ``valid``. Another
    version than the supported one is refused.
    """
    if version != supported:
        raise ValueError(f"baseline version {version}; this reads {supported}")
    read = F.from_json("entry", "symbolHash string, symbol_hash string, docHash string, doc_hash string, filePath string, startLine double, project string")
    e = entries.select("id", read.alias("e"))
    line = F.coalesce("e.startLine", F.lit(1.0))
    rows = e.select(
        "id", F.coalesce("e.symbolHash", "e.symbol_hash").alias("symbol_hash"), F.coalesce("e.docHash", "e.doc_hash").alias("doc_hash"),
        F.coalesce("e.filePath", F.when(F.contains("id", F.lit("#")), file_of(F.col("id"))).otherwise("")).alias("file_path"),
        line.alias("line"), "e.project",
    )
    valid = F.col("symbol_hash").isNotNull() & F.col("doc_hash").isNotNull() & (F.col("line") >= 1) & (F.col("line") == F.floor("line"))
    return rows.select("id", "symbol_hash", "doc_hash", "file_path", F.col("line").cast("bigint").alias("start_line"), "project", valid.alias("valid"))


def evaluation_out(outcomes: DataFrame) -> DataFrame:
    """(symbol, record): an evaluation record for each outcome, as JSON without null fields."""
    record = _json(F.struct(F.col("symbol").alias("id"), F.col("file").alias("filePath")).alias("symbol"), F.struct("verdict", "error").alias("generation"), F.struct("accepted").alias("judge"), F.col("outcome").alias("output"))
    return outcomes.select("symbol", record.alias("record"))
