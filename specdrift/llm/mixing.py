"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Of all document rates r (copies, as a fraction) between 0 and ``most`` that give each source its target
number of words, entropy balancing takes those nearest to 1 in Kullback-Leibler divergence:

    minimise  sum_i r_i log r_i - r_i + 1   subject to  sum_{i in s} size_i r_i = target_s,  r_i <= most

The convex dual has one multiplier for each source, and r_i = min(most, exp(lambda_s size_i)): documents
are tilted exponentially by their size. Newton's method finds the multipliers of all sources at once;
each step is one distributed aggregation of gradient and Hessian over the documents, which are first
counted by source and size. A step that leaves the bracket of its source's solution is replaced by
its midpoint. It ends when every constraint holds to ``TOLERANCE``.

Rates become whole copies. Every document gets floor(r) copies; some get one more. A document's place
is a hash of its doc_id, uniform in (0, 1), over the fraction of its rate, so that a place below 1 comes
with just that probability. Documents of a source are split into size classes (powers of two) and
their places into ``BINS``. From the largest class down, a prefix of each class's bins gets the extra copy,
cut where the words taken come nearest to what is due, and the difference is carried to the next
class. So rounding errors of long documents are made good with short ones, and only sums by (source,
class, bin) are shuffled.

Documents are read twice: for their sizes, and for the result. Sums over sources use windows without a
partition, on one row for each source. The table of cuts, up to 32 rows for each source, is joined as
Spark sees fit by its size; nothing is broadcast by force.

Defined results: a null text has size 0; null sources form one source, sorted last; a source of
size 0 has target 0 and no copies; elsewhere a document of size 0 has rate 1; repeated rows of one
doc_id are treated alike; a null doc_id hashes like an empty text; an empty table gives no rows. Reruns
agree, whatever the partitioning. Columns named like the result's are replaced, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specdrift.llm.io import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of places, and how many there are to 1.
BINS, BINS_TO_ONE = 512, 128
#: Relative error of a constraint.
TOLERANCE = 1e-9


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) rows to the same with ``target``.

    Weights repeat over the sources in code point order. The total is shared by weight; a target
    stops at ``most`` times its source's size and the excess is reshared by weight until none is
    above. That is water filling: sources in order of size / weight stop first.
    """
    whole = Window.partitionBy()
    ranked = sizes.withColumn(
        "k", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") + 1))
    ranked = ranked.withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by_stop = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    above = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("spent", F.coalesce(F.sum("stop").over(above), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left_weight"))
        # the first source that does not stop at its level sets the level of all after it
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("stop"))
        .withColumn("final", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
            by_stop.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.when(F.col("final").isNull(), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("final") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


def rate_of(multiplier: Column, size: Column, most: float) -> Column:
    """min(most, exp(multiplier * size)), exactly ``most`` where it is reached; 0 without a multiplier."""
    x = multiplier * size
    return F.when(multiplier.isNull(), F.lit(0.0)).when(x >= math.log(most), F.lit(float(most))).otherwise(F.exp(x))


def multipliers(cells: DataFrame, targets: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, target, multiplier) from cells (source, size, n) of n documents each, and
    targets (source, source_size, target). Null where a target is 0."""
    sized = cells.filter("size > 0").withColumnRenamed("source", "of")
    facts = sized.groupBy("of").agg(F.min("size").cast("double").alias("least"), (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("mean"))
    share = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    found = targets.join(facts, targets["source"].eqNullSafe(facts["of"]), "left").drop("of").withColumn("share", F.when(share > 0, share))
    top, log_share = F.lit(math.log(most)) / F.col("least"), F.log("share")
    full = F.col("share") >= most * (1 - 1e-12)
    state = found.select(
        "source", "source_size", "target",
        F.when(full, top).otherwise(log_share / F.col("mean")).alias("multiplier"),
        F.least(F.lit(0.0), log_share / F.col("least")).alias("lo"), top.alias("hi"), (full | F.col("share").isNull()).alias("done"),
    )
    state = stored(state, "multipliers")
    x = F.col("multiplier") * F.col("size")
    words = F.col("n") * F.col("size") * rate_of(F.col("multiplier"), F.col("size"), most)
    while not state.filter("not done").isEmpty():
        going = state.filter("not done").select(F.col("source").alias("s"), "multiplier")
        sums = sized.join(going, sized["of"].eqNullSafe(going["s"])).groupBy("of").agg(
            F.sum(words).alias("taken"), F.sum(F.when(x < math.log(most), words * F.col("size")).otherwise(0.0)).alias("slope")
        )
        err = F.col("taken") - F.col("target")
        lo, hi = F.when(err < 0, F.col("multiplier")).otherwise(F.col("lo")), F.when(err > 0, F.col("multiplier")).otherwise(F.col("hi"))
        stepped = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left").withColumns({
            "err": err, "low": lo, "high": hi, "step": F.col("multiplier") - F.try_divide(err, F.col("slope")),
        })
        inside = F.coalesce((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.lit(False))
        middle = (F.col("low") + F.col("high")) / 2
        done = (F.abs("err") <= TOLERANCE * F.col("target")) | (middle <= F.col("low")) | (middle >= F.col("high"))
        after = stepped.withColumn("ends", F.col("done") | F.coalesce(done, F.lit(True))).select(
            "source", "source_size", "target",
            F.when(F.col("ends"), F.col("multiplier")).when(inside, F.col("step")).otherwise(middle).alias("multiplier"),
            F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("ends").alias("done"),
        )
        before, state = state, stored(after, "multipliers")
        discard(before)
    return state.select("source", "source_size", "target", "multiplier")


def _place(doc_id: Column, rate: Column) -> Column:
    """The bin of a document's place."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    part = rate - F.floor(rate)
    return F.when(part > 0, F.least(F.lit(BINS - 1), F.floor(hashed / part * BINS_TO_ONE)).cast("int"))


def _class(size: Column) -> Column:
    return F.length(F.bin(size))


def _cuts(cells: DataFrame) -> DataFrame:
    """By source: the size classes, largest first, with what is due in each and the words of its bins."""
    return (
        cells.groupBy("__source", "__class")
        .agg(F.array_sort(F.collect_list(F.struct("__bin", "words"))).alias("bins"), F.sum("due").alias("all"))
        .groupBy("__source")
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("__class", "all", "bins")))).alias("classes"))
    )


def _fold_cuts(by_source: DataFrame) -> DataFrame:
    """(source, size class) with the bin below which documents get the extra copy."""
    start = F.struct(
        F.lit(0.0).alias("due"),
        F.array().cast("array<struct<class:int,cut:int>>").alias("cuts"),
    )

    def bins_taken(due: Column, bins: Column) -> Column:
        """(cut, words): the prefix of bins whose words come nearest to ``due``; the shorter of ties."""
        first = F.struct(
            F.lit(0).alias("cut"), F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("sum")
        )

        def step(acc: Column, one: Column) -> Column:
            total = acc["sum"] + one["words"]
            nearer = F.abs(total - due) < F.abs(acc["words"] - due)
            return F.struct(
                F.when(nearer, one["__bin"] + 1).otherwise(acc["cut"]).alias("cut"),
                F.when(nearer, total).otherwise(acc["words"]).alias("words"),
                total.alias("sum"),
            )

        return F.aggregate(bins, first, step)

    def step(acc: Column, one: Column) -> Column:
        due = acc["due"] + one["all"]
        # a transform over one element binds the inner fold's result to a name
        return F.element_at(
            F.transform(
                F.array(bins_taken(due, one["bins"])),
                lambda got: F.struct(
                    (due - got["words"]).alias("due"),
                    F.concat(
                        acc["cuts"], F.array(F.struct(one["__class"].alias("class"), got["cut"].alias("cut")))
                    ).alias("cuts"),
                ),
            ),
            1,
        )

    folded = by_source.select("__source", F.explode(F.aggregate("classes", start, step)["cuts"]).alias("c"))
    return folded.select("__source", F.col("c.class").alias("__class"), F.col("c.cut").alias("__cut"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``."""
    made = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*[c for c in made if c not in (text, doc_id, source)])
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    size = text_size(F.col(f"`{text}`")).alias("__size")
    sizes = stored(docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{source}`").alias("__source"), size), "sizes")
    cells = stored(sizes.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count("*").alias("n")), "cells")
    by_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    found = multipliers(cells, source_targets(by_source, weights, most), most).withColumnRenamed("source", "__key")

    def rated(rows: DataFrame) -> DataFrame:
        return rows.join(found, rows["__source"].eqNullSafe(found["__key"])).withColumn("rate", rate_of(F.col("multiplier"), F.col("__size"), most))

    with_bin = rated(sizes).select("__source", _class(F.col("__size")).alias("__class"), "__size", "rate", _place(F.col("__id"), F.col("rate")).alias("__bin"))
    part = F.col("rate") - F.floor("rate")
    sums = with_bin.filter("__bin is not null").groupBy("__source", "__class", "__bin").agg(F.sum("__size").alias("words"), F.sum(part * F.col("__size")).alias("due"))
    cuts = stored(_fold_cuts(_cuts(sums)), "cuts").withColumnsRenamed({"__source": "__cut_source", "__class": "__cut_class"})
    discard(sizes, cells)
    rows = rated(docs.select(own, F.col(f"`{source}`").alias("__source"), F.col(f"`{doc_id}`").alias("__id"), size))
    joined = rows.join(cuts, rows["__source"].eqNullSafe(cuts["__cut_source"]) & (_class(F.col("__size")) == F.col("__cut_class")), "left")
    extra = F.coalesce(_place(F.col("__id"), F.col("rate")) < F.col("__cut"), F.lit(False)).cast("int")
    return joined.select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns],
        F.col("__size").alias("size"), "source_size", "target", "rate", (F.floor("rate") + extra).cast("bigint").alias("copies"),
    )
