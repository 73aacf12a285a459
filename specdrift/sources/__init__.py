"""Files that the drift operators start from: recorded baselines and evaluation cases, as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from specdrift.operators.report import baseline_in


def read_baseline(spark: SparkSession, path: str, supported: int = 2) -> DataFrame:
    """The entries of one or more baseline files ``{"schemaVersion": 2, "symbols": {id: entry}}`` under ``path``.

    No file is an empty baseline; another version is refused, and so is an entry with invalid fields.
    """
    try:
        read = spark.read.option("multiLine", True).schema("schemaVersion int, symbols map<string,string>").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], "schemaVersion int, symbols map<string,string>")
    for (version,) in read.select("schemaVersion").distinct().limit(2).collect():
        if version != supported:
            raise ValueError(f"baseline version {version}; this reads {supported}")
    rows = baseline_in(read.selectExpr("explode(symbols) AS (id, entry)"))
    if not rows.filter("not valid").isEmpty():
        raise ValueError("baseline entries with invalid fields")
    return rows.drop("valid")


def write_baseline(entries: DataFrame, path: str) -> None:
    """Replaces the entries at ``path``, in parallel; Spark's committer shows them as a whole or not at all."""
    entries.write.mode("overwrite").parquet(path)


def read_cases(spark: SparkSession, path: str, schema: str, least: int, by: str | None = None, least_groups: int = 0) -> DataFrame:
    """Evaluation cases, one JSON object a line: ``least`` of them, from ``least_groups`` values of ``by``."""
    cases = spark.read.schema(schema).json(path)
    if cases.limit(least).count() < least:
        raise ValueError(f"fewer than {least} cases")
    if by and cases.select(by).distinct().limit(least_groups).count() < least_groups:
        raise ValueError(f"cases of fewer than {least_groups} {by}")
    return cases
