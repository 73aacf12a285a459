"""Selection of targets, guards, and what of a generated document is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.operators.outcome import in_scope


def targets(results: DataFrame, mode: str, scope: str = ".") -> DataFrame:
    """Results of the status ``mode`` within a path."""
    return results.filter((F.col("status") == mode) & in_scope(F.col("file_path"), scope))


def guard_targets(found: DataFrame, mode: str, scope: str | None, most: int, replaces: bool = False, judged: bool = True) -> None:
    """Refuses runs that no target, too many, or an unsafe mode would make. Counts no further than needed."""
    if mode == "missing" and scope is None:
        raise ValueError("give a path for missing documentation")
    if replaces and not judged:
        raise ValueError("replacing comments needs a judge")
    n = found.limit(most + 1).count()
    if n == 0 and scope is not None:
        raise ValueError(f"nothing to do under {scope}")
    if n > most:
        raise ValueError(f"more than {most} symbols")


def split_blocked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets to work on, those whose edit is blocked)."""
    blocked = F.col("edit_blocked_reason").isNotNull()
    return found.filter(~blocked), found.filter(blocked)


def match_symbol(symbols: DataFrame, query: Column, canonical: Column) -> DataFrame:
    """Symbols named by id, canonical id, name, or container.name."""
    full = F.concat_ws(".", "container", "name")
    return symbols.filter((F.col("id") == query) | (canonical == query) | (F.col("name") == query) | (full == query))


def ambiguity(matches: DataFrame, by: list[str]) -> DataFrame:
    """For each query: how many symbols it names, and whether that is not exactly one."""
    return matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matches")).withColumn("ambiguous", F.col("matches") > 1)


def emitted(granularity: Column, returns_value: Column, replaces_note: Column) -> Column:
    """struct<detail,params,returns,throws>: the sections that a granularity has."""
    standard, detailed = granularity != "minimal", granularity == "detailed"
    return F.struct(
        (detailed | replaces_note).alias("detail"), standard.alias("params"),
        (standard & returns_value).alias("returns"), detailed.alias("throws"),
    )


def project_document(docs: DataFrame, policy: Column) -> DataFrame:
    """Documents (summary, detail, params map, returns, throws array) with only what the policy emits."""
    return docs.withColumns({
        "detail": F.when(policy["detail"], F.col("detail")), "returns": F.when(policy["returns"], F.col("returns")),
        "params": F.map_filter("params", lambda k, v: policy["params"]), "throws": F.filter("throws", lambda t: policy["throws"]),
    })


def preserved_tags(tags: Column, configured: list[str]) -> Column:
    """Tags (name, known) that a rewrite keeps: unknown ones, and those configured."""
    return F.filter(tags, lambda t: ~t["known"] | t["name"].isin(configured))


def note_replaceable(mode: Column, has_doc: Column, note_eligible: Column) -> Column:
    return (mode == "replace") & ~has_doc & F.coalesce(note_eligible, F.lit(False))
