"""Snapshot diff of current symbols against a recorded baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specdrift.functions.text import EMPTY_DOC_HASH, file_of
from specdrift.operators.intervals import touching

STATUSES = ("unchanged", "drifted", "missing", "orphaned")


def classify(current: DataFrame, known: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, status, file_path, start_line).

    current: id, symbol_hash, doc_hash, has_doc, start_line; baseline: id, symbol_hash, doc_hash,
    file_path, start_line; known: id. One full outer join on id gives all four statuses; ids that
    are known but not current are taken out of the orphans by an anti join.
    """
    b = baseline.select("id", *[F.col(c).alias(f"b_{c}") for c in ("symbol_hash", "doc_hash", "file_path", "start_line")], F.lit(True).alias("b"))
    c = current.withColumn("c", F.lit(True))
    both = c.join(b, "id", "full_outer")
    gone = F.col("c").isNull()
    drift = (F.col("b_symbol_hash") != F.col("symbol_hash")) & (F.col("b_doc_hash") == F.col("doc_hash"))
    status = F.when(gone, "orphaned").when(~F.col("has_doc"), "missing").when(drift, "drifted").otherwise("unchanged")
    rows = both.filter(~gone | (F.col("b_doc_hash") != EMPTY_DOC_HASH)).select(
        "id", status.alias("status"),
        F.when(gone, F.col("b_file_path")).otherwise(file_of(F.col("id"))).alias("file_path"),
        F.when(gone, F.col("b_start_line")).otherwise(F.col("start_line")).alias("start_line"),
    )
    spared = known.select("id").distinct().withColumn("known", F.lit(True))
    return rows.join(spared, "id", "left").filter("status <> 'orphaned' or known is null").drop("known")


def ordered(results: DataFrame) -> DataFrame:
    """Report order: path, line, id, in locale order."""
    return results.orderBy(F.collate("file_path", "UNICODE"), "start_line", F.collate("id", "UNICODE"))


def status_summary(results: DataFrame) -> DataFrame:
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def reportable(results: DataFrame, missing: bool = False, orphaned: bool = True) -> DataFrame:
    wanted = ["drifted", *["missing"] * missing, *["orphaned"] * orphaned]
    return results.filter(F.col("status").isin(wanted))


def scope_baseline(baseline: DataFrame, projects: DataFrame) -> DataFrame:
    return baseline.join(projects.select("project"), "project", "left_semi")


def merge_baseline(previous: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Upsert by id: refreshed entries win, all others stay."""
    return refreshed.unionByName(previous.join(refreshed.select("id"), "id", "left_anti"))


def baseline_entries(current: DataFrame) -> DataFrame:
    return current.select("id", "symbol_hash", "doc_hash", file_of(F.col("id")).alias("file_path"), "start_line")


def changed_since(results: DataFrame, hunks: DataFrame) -> DataFrame:
    """Rows that a changed line range touches: (path, start, end), inclusive. Orphans and rows without an end match by
    path. Whether a range is touched is found once for each distinct one, in blocks of lines."""
    free = F.coalesce((F.col("status") == "orphaned") | F.col("end_line").isNull(), F.lit(False))
    spans = [F.col("file_path").alias("path"), F.col("start_line").cast("bigint").alias("start"), F.col("end_line").cast("bigint").alias("end")]
    met = touching(results.filter(~free).select(*spans), hunks).select(F.col("path").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"))
    by_path = results.filter(free).join(hunks.select(F.col("path").alias("p")).distinct(), F.col("file_path") == F.col("p"), "left_semi")
    return results.filter(~free).join(met, (F.col("file_path") == F.col("p")) & (F.col("start_line") == F.col("s")) & (F.col("end_line") == F.col("e")), "left_semi").unionByName(by_path)


def parse_diff(lines: DataFrame) -> DataFrame:
    """Unified diff lines (ord, line) of one or more diffs (diff) to hunks (diff, path, start, end).

    Headers set the path of the hunks that follow; /dev/null keeps the old path.
    """
    order = Window.partitionBy("diff").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    named = F.regexp_extract("line", r"^(?:--- a|\+\+\+ b)/(.*)$", 1)
    path = F.last(F.when(named != "", named), ignorenulls=True).over(order)
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    count = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    first = start.try_cast("int")
    size = F.when(count == "", 1).otherwise(count.try_cast("int"))
    found = lines.withColumn("path", path).withColumn("first", first).withColumn("size", size)
    return found.filter("first is not null and path is not null").select(
        "diff", "path", F.greatest(F.lit(1), F.col("first")).alias("start"),
        F.greatest(F.lit(1), F.col("first") + F.greatest(F.lit(1), F.col("size")) - 1).alias("end"),
    )


def ownership_conflicts(files: DataFrame) -> DataFrame:
    """Files that more than one project claims."""
    return files.groupBy("file").agg(F.count_distinct("project").alias("projects")).filter("projects > 1")


def union_projects(parts: list[DataFrame]) -> DataFrame:
    """Rows of all projects."""
    return reduce(DataFrame.unionByName, parts)


def union_known(*parts: DataFrame) -> DataFrame:
    """Ids that any project knows."""
    return reduce(DataFrame.union, [p.select("id") for p in parts]).distinct()


def members_among(targets: DataFrame, members: DataFrame) -> DataFrame:
    """Targets (node) that are among the members."""
    return targets.join(members, "node", "left_semi")
