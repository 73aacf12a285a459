"""Quality rules: a threshold table compiled into one Spark projection, built-in functions only.

Nulls count as empty texts. An empty text has no word and fails ``min_words``. Rows keep every
column they came with; the measures are added under the names in ``MEASURES`` (columns of the same
names are replaced). No row is joined, shuffled or dropped, so hot sources and long texts only cost
their own length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a repeat window.
WINDOW = 5
#: Frequent function words of the supported languages, in lower case.
STOP_WORDS = (
    "the of and to in is that for it with as was on by this are be at or from "
    "der die das und ist nicht zu den von mit ein eine auf sich im dem des für auch "
    "le la les de et un une du des en que qui est pour dans par sur au avec il "
    "el los las y en que un una por con para del se no es al como lo su más o a"
).split()
#: As they stand in texts: lower case or capitalised, bare or before a comma or full stop.
STOP_FORMS = sorted({form + end for w in STOP_WORDS for form in (w, w.capitalize()) for end in ("", ",", ".")})


@dataclass(frozen=True)
class Rule:
    """A document is rejected when ``measure`` is below ``least`` or above ``most``. The rule is for rows
    where the SQL condition ``only`` holds, or for all."""

    measure: str
    least: float | None = None
    most: float | None = None
    only: str | None = None


#: Base rules: too few words, or too many words in repeated windows. Percentages avoid division.
BASE = (Rule("n_words", least=10), Rule("pct_repeat_words", most=20.0))
#: Production thresholds, applied to what passes the base rules.
TABLE = (
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("pct_symbol_chars_per_word", most=30.0),
    Rule("pct_shouted_words", most=30.0),
    Rule("pct_stop_words", least=2.0),
    Rule("pct_dup_lines", most=50.0),
)
#: The table where clean texts must stay: a share of stop words is only expected of 50 words or more, in
#: a language of the list (or an unknown one).
KEEPING = tuple(
    replace(r, only="n_words >= 50 AND coalesce(lower(left(lang, 2)) IN ('en', 'de', 'fr', 'es'), true)") if r.measure == "pct_stop_words" else r
    for r in TABLE
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_stop")


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows whose hash is found twice or more: sort (hash, start), keep the
    starts of runs of equal hashes, and add up the parts of the windows that do not overlap."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    null = F.lit(None).cast("struct<h:bigint,i:int>")
    n = F.size(hashes)
    before = F.slice(F.concat(F.array(null), pairs), 1, n)
    after = F.slice(F.concat(pairs, F.array(null)), 2, n)
    flagged = F.zip_with(
        F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b"))),
        pairs,
        lambda around, own: F.when((around["a"] == own["h"]) | (around["b"] == own["h"]), own["i"]),
    )
    starts = F.array_sort(F.array_compact(flagged))
    # each start covers WINDOW words, less what the next start covers too
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, s: F.struct((acc["sum"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("sum"), s.alias("last")),
        lambda acc: acc["sum"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("bigint")).otherwise(covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (all bigint)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the arrays are columns of their own: lambdas below refer to them once for each element
    split = docs.select(
        *keep,
        body.alias("__body"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD)).alias("__lines"),
    )
    hashed = split.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        "__h", lambda h, i: F.xxhash64(h, *[F.get(F.col("__h"), i + j) for j in range(1, WINDOW)])
    )
    hashed = hashed.withColumn("__windows", F.slice(windows, 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))))
    count = lambda c: F.size(c).cast("bigint")
    return hashed.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES],
        count("__words").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__body", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("__words"), F.col("__windows")).alias("n_repeat_words"),
        count("__lines").alias("n_lines"),
        count(F.filter("__words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))).alias("n_shouted"),
        count(F.filter("__words", lambda w: w.isin(STOP_FORMS))).alias("n_stop"),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * F.col(part), F.col(whole)), F.lit(0.0))


def _ratio(name: str) -> Column:
    return {
        "n_words": F.col("n_words").cast("double"),
        "pct_repeat_words": _share("n_repeat_words", "n_words"),
        "mean_word_chars": _share("word_chars", "n_words") / 100,
        "pct_symbol_chars_per_word": _share("n_symbols", "n_words"),
        "pct_shouted_words": _share("n_shouted", "n_words"),
        "pct_stop_words": _share("n_stop", "n_words"),
        "pct_dup_lines": _share("n_dup_lines", "n_lines"),
    }[name]


def _violates(rule: Rule) -> Column:
    # the two base rules compare integers, so that no rounding decides
    if rule.measure == "pct_repeat_words" and rule.most is not None and float(rule.most).is_integer():
        return 100 * F.col("n_repeat_words") > int(rule.most) * F.col("n_words")
    value, bad = _ratio(rule.measure), F.lit(False)
    if rule.least is not None:
        bad = bad | (value < rule.least)
    if rule.most is not None:
        bad = bad | (value > rule.most)
    return bad


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean expression: true where any rule of the table is violated."""
    bad = F.lit(False)
    for rule in rules:
        violated = _violates(rule)
        bad = bad | (violated if rule.only is None else F.expr(rule.only) & violated)
    return bad


def apply_rules(docs: DataFrame, text: str = "text", base: Sequence[Rule] = BASE, table: Sequence[Rule] = TABLE) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    ``kept`` is false where a base rule fails, else the table's verdict. Repeated rows are judged
    one by one, all alike.
    """
    measured = measure(docs.drop("base_failed", "kept"), text)
    # The partition number is never negative. Being non-deterministic to the optimizer, it keeps a
    # filter on ``kept`` above this projection; pushed below, the filter would repeat the array
    # expressions inside their own lambdas.
    here = F.spark_partition_id() >= 0
    failed = compile_rules(base)
    return measured.select("*", failed.alias("base_failed"), (here & ~failed & ~compile_rules(table)).alias("kept"))
