"""Eligibility, review outcomes, planned edits and attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specdrift.functions.text import body_lines

#: Symbol kinds by the name they have in the configuration.
KIND_NAMES = {"variable-function": "arrow", "type-alias": "typeAlias", "getter": "accessor", "setter": "accessor", "method-signature": "method"}


def eligible(symbols: DataFrame, kinds: list[str], visibility: list[str], least_lines: int = 3, exported_only: bool = True, pragma: str = "@docs-ignore") -> DataFrame:
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in KIND_NAMES.items() for x in p]), F.col("kind")), F.col("kind"))
    keep = kind.isin(kinds) & F.col("visibility").isin(visibility) & (body_lines(F.col("body")) >= least_lines) & ~F.col("is_test")
    for raw in [c for c in ("doc_raw", "note_raw") if c in symbols.columns]:
        keep = keep & ~F.contains(F.coalesce(raw, F.lit("")), F.lit(pragma))
    return symbols.filter(keep & F.col("exported") if exported_only else keep)


def without_ignored(symbols: DataFrame, ignored: DataFrame) -> DataFrame:
    return symbols.join(ignored, ["file", "container"], "left_anti")


def on_surface(symbols: DataFrame, surface: DataFrame) -> DataFrame:
    """Symbols (file, name) that the public surface has."""
    return symbols.join(surface, ["file", "name"], "left_semi")


def in_scope(path: Column, scope: str) -> Column:
    scope = scope.removeprefix("./").rstrip("/")
    return F.lit(True) if scope in ("", ".") else (path == scope) | F.startswith(path, F.lit(scope + "/"))


def resolve_outcomes(generations: DataFrame, judgments: DataFrame) -> DataFrame:
    """(symbol, outcome): skipped, failed, rejected or generated, in this precedence."""
    j = judgments.select("symbol", "accepted", F.col("error").alias("j_error"))
    outcome = (
        F.when(F.col("verdict") == "SKIP", "skipped")
        .when(F.col("error").isNotNull() | F.col("verdict").isNull() | (F.col("verdict") != "OK"), "failed")
        .when(F.col("j_error").isNotNull(), "failed")
        .when(~F.coalesce("accepted", F.lit(False)), "rejected")
        .otherwise("generated")
    )
    return generations.join(j, "symbol", "left").select("symbol", outcome.alias("outcome"))


def judge_pairs(generations: DataFrame, symbols: DataFrame, contexts: DataFrame) -> DataFrame:
    """What a judge is given: accepted generations (symbol, verdict) with their symbol and its context."""
    return generations.filter("verdict = 'OK'").join(symbols, "symbol").join(contexts, "symbol")


def validate(responses: DataFrame) -> DataFrame:
    """Responses (id, wanted_id, verdict, reason, summary, wanted, params) with ``problem``, the first rule that
    one breaks (null: none), and the reason a skip without one gets."""
    summary = F.trim(F.coalesce("summary", F.lit("")))
    ok = F.col("verdict") == "OK"
    problem = (
        F.when(F.col("id") != F.col("wanted_id"), "wrong id").when(~F.col("verdict").isin("OK", "SKIP"), "wrong verdict")
        .when(ok & (summary == ""), "empty summary").when(ok & ~same_keys(F.col("wanted"), F.col("params")), "wrong parameters")
        .when(ok & summary.rlike(r"/\*\*|\*/"), "comment markup")
    )
    reason = F.when((F.col("verdict") == "SKIP") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason given").otherwise(F.trim("reason"))
    return responses.withColumns({"summary": summary, "reason": reason, "problem": problem})


def same_keys(wanted: Column, given: Column) -> Column:
    """Whether two arrays hold the same set of keys."""
    return (F.size(F.array_except(wanted, given)) == 0) & (F.size(F.array_except(given, wanted)) == 0)


def blocked_edits(edits: DataFrame) -> DataFrame:
    """Edits (file, symbol, start, end) that overlap another of their file, or start where it starts."""
    by_start = Window.partitionBy("file").orderBy("start", "end", "symbol")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("start").over(by_start)
    same = F.count(F.lit(1)).over(Window.partitionBy("file", "start")) > 1
    hit = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)) | same
    return edits.withColumn("blocked", hit)


def verify_plan(plan: DataFrame, current: DataFrame) -> DataFrame:
    """(symbol, state): ready, gone, blocked or moved, from the anchor hashes now and when planned."""
    c = current.select("symbol", F.col("anchor").alias("now"), "edit_blocked", F.lit(True).alias("here"))
    state = F.when(F.col("here").isNull(), "gone").when(F.col("edit_blocked"), "blocked").when(F.col("now") != F.col("anchor"), "moved").otherwise("ready")
    return plan.join(c, "symbol", "left").select("symbol", state.alias("state"))


def failfast(attempts: DataFrame, streak: int = 3, order: list[str] | None = None) -> DataFrame:
    """(run, halted_at): the first attempt of a run that stops it: 401, 403 or 404, the last of ``streak``
    consecutive 400 or 422, one marked ``fatal``, or one whose ``wait_ms`` is over a minute (where the
    log has these columns)."""
    w = Window.partitionBy("run").orderBy(*order or ["ord"])
    bad = F.col("status").isin(400, 422).cast("int")
    run_of_bad = F.sum(bad).over(w.rowsBetween(-(streak - 1), 0)) == streak
    halt = F.col("status").isin(401, 403, 404) | run_of_bad
    if "fatal" in attempts.columns:
        halt = halt | F.coalesce("fatal", F.lit(False))
    if "wait_ms" in attempts.columns:
        halt = halt | F.coalesce(F.col("wait_ms") > 60_000, F.lit(False))
    return attempts.withColumn("halt", halt).filter("halt").groupBy("run").agg(F.min("ord").alias("halted_at"))


def pacing(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Adds how many requests of the run fall into the window that ends with each one."""
    w = Window.partitionBy("run").orderBy("at").rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))


def capped(requests: DataFrame, per_run: int, order: list[str]) -> DataFrame:
    """Adds ``refused``: whether the run had sent ``per_run`` requests before this one, in order."""
    return requests.withColumn("refused", F.row_number().over(Window.partitionBy("run").orderBy(*order)) > per_run)
