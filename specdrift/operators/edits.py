"""Edits applied to texts, and the difference that makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdrift.functions.text import let
from specdrift.operators.outcome import blocked_edits

#: Why an edit was not applied.
NO_FILE, OVERLAP, RANGE = "no such file", "edits overlap", "outside the text"


def splice(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, before, after, applied array<symbol>, failed array<struct<symbol, reason>>) from files (file, text) and edits
    (file, symbol, start, end, text); places are characters, from 0, without the end.

    The borders of the edits cut a text to pieces, which are joined again with the replacements between them: one ordered
    aggregate for a file, linear in its text (pieces are cut from a fixed-width encoding). Edits that overlap, or start where
    another starts, are all left out. A null replacement deletes. Files without an edit stay as they are; edits of
    a file that is not there, or has no text, fail.
    """
    one = F.struct("start", "end", "symbol", F.coalesce("text", F.lit("")).alias("text"), "blocked")
    per = blocked_edits(edits).groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    both = files.select("file", F.col("text").alias("before")).join(per, "file", "full")
    size = F.length("before")
    bad = lambda e: F.coalesce((e["start"] < 0) | (e["end"] < e["start"]) | (e["end"] > size), F.lit(True))
    reason = lambda e: F.when(F.col("before").isNull(), NO_FILE).when(e["blocked"], OVERLAP).when(bad(e), RANGE)
    told = both.select("file", "before", F.transform(F.coalesce("edits", F.array().cast(per.schema["edits"].dataType)), lambda e: F.struct(e.alias("e"), reason(e).alias("reason"))).alias("told"))
    good = F.transform(F.filter("told", lambda t: t["reason"].isNull()), lambda t: t["e"])

    def spliced(g: Column, wide: Column) -> Column:
        cut = lambda a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")
        until = lambda i: F.when(i == 0, 0).otherwise(F.element_at(g, F.greatest(i, F.lit(1)))["end"]).cast("int")
        pieces = F.transform(g, lambda e, i: F.concat(cut(until(i), e["start"].cast("int")), e["text"]))
        return F.concat(F.array_join(pieces, ""), cut(until(F.size(g)), size))

    after = let(good, lambda g: let(F.encode("before", "UTF-32"), lambda wide: F.when(F.size(g) == 0, F.col("before")).otherwise(spliced(g, wide))))
    failed = F.transform(F.filter("told", lambda t: t["reason"].isNotNull()), lambda t: F.struct(t["e"]["symbol"].alias("symbol"), t["reason"].alias("reason")))
    return told.select("file", "before", after.alias("after"), F.transform(good, lambda e: e["symbol"]).alias("applied"), failed.alias("failed"))


def _lines(text: Column) -> Column:
    """Lines whatever ends them; a last line end starts no line."""
    return F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), r"\n\z", ""), "\n", -1)


def _alike(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: let(F.array_position(s, False), lambda p: F.when(p == 0, F.size(s)).otherwise(p - 1).cast("int")))


def unified_diff(path: Column, before: Column, after: Column, context: int = 3) -> Column:
    """One hunk from the first to the last line that differs, with ``context`` lines around it; "" for equal texts.
    Linear in both texts. Null is the empty text."""

    def hunk(old: Column, new: Column, head: Column, tail: Column) -> Column:
        start = F.greatest(F.lit(0), head - context)
        to_old, to_new = (F.least(F.size(x), F.size(x) - tail + context) for x in (old, new))
        part = lambda x, a, b, mark: F.transform(F.slice(x, a + 1, F.greatest(b - a, F.lit(0))), lambda line: F.concat(F.lit(mark), line))
        at = F.format_string("@@ -%d,%d +%d,%d @@", start + 1, to_old - start, start + 1, to_new - start)
        lines = F.concat(
            F.array(F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), at), part(old, start, head, " "),
            part(old, head, F.size(old) - tail, "-"), part(new, head, F.size(new) - tail, "+"), part(old, F.size(old) - tail, to_old, " "),
        )
        return F.array_join(lines, "\n")

    def of(old: Column, new: Column) -> Column:
        tail = lambda head: F.least(_alike(F.reverse(old), F.reverse(new)), F.size(old) - head, F.size(new) - head)
        return let(_alike(old, new), lambda head: let(tail(head), lambda t: hunk(old, new, head, t)))

    same = F.coalesce(before, F.lit("")) == F.coalesce(after, F.lit(""))
    return F.when(same, "").otherwise(let(_lines(before), lambda old: let(_lines(after), lambda new: of(old, new))))
