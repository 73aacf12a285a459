"""Dependency graphs as edge tables (src depends on dst), nodes of any orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specdrift.operators.walks import levels, propagate, strongly_connected  # noqa: F401
from specdrift.plans.shared import discard, stored


def distinct_edges(calls: DataFrame) -> DataFrame:
    return calls.select("src", "dst").distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges between components."""
    a, b = components.withColumnsRenamed({"node": "src", "component": "a"}), components.withColumnsRenamed({"node": "dst", "component": "b"})
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def component_members(components: DataFrame) -> DataFrame:
    """(component, place, node): members of each component in binary order, numbered from 1."""
    return components.select("component", F.row_number().over(Window.partitionBy("component").orderBy("node")).alias("place"), "node")


def call_graph(calls: DataFrame, declarations: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct edges (src, dst): the symbol around each call, and the one it calls. Calls outside any
    symbol, or of names that are not resolved, give no edge."""
    target = resolve_callees(calls, declarations)
    caller = containing(calls.select("file", "point").distinct(), spans)
    met = calls.join(target, "call").withColumnRenamed("symbol", "dst").join(caller.withColumnRenamed("symbol", "src"), ["file", "point"])
    return distinct_edges(met)


def dependency_order(node_levels: DataFrame) -> DataFrame:
    """A reverse topological order: by level, then node. ``position`` counts from 1."""
    per = node_levels.groupBy("level").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("node"))
    return node_levels.withColumn("rank", rank).join(before, "level").select("node", "level", (F.col("before") + F.col("rank")).alias("position"))


def resolve_callees(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """calls (call, file, name, container, static) to (call, symbol): the only declaration of the name in
    the file, else the one of the same container and static-ness."""
    by_name = declarations.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("only"))
    named = calls.join(by_name, ["file", "name"])
    sole = named.filter("n = 1").select("call", F.col("only").alias("symbol"))
    # absent containers are equal to each other
    key = [F.col("file"), F.col("name"), F.coalesce(F.concat(F.lit("."), "container"), F.lit("")).alias("c"), F.coalesce("static", F.lit(False)).alias("s")]
    same = declarations.select(*key, "symbol").groupBy("file", "name", "c", "s").agg(F.min("symbol").alias("symbol"))
    return sole.union(named.filter("n > 1").select(*key, "call").join(same, ["file", "name", "c", "s"]).select("call", "symbol"))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, point, symbols): all spans of the file around each point, outermost first."""
    around = _around(points, spans).groupBy("file", "point").agg(F.array_sort(F.collect_list(F.struct("start", "symbol"))).alias("s"))
    return around.select("file", "point", F.transform("s", lambda x: x["symbol"]).alias("symbols"))


def containing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, point, symbol): the innermost span of the file around each point."""
    return _around(points, spans).groupBy("file", "point").agg(F.max_by("symbol", F.struct("start", "symbol")).alias("symbol"))


def _around(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points with each span around them.

    A span of length up to 2^k touches at most two blocks of 2^k positions. Points look only into their
    own block for each k that a file's spans have, so a file with many spans is not compared as a whole.
    """
    k = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double"))).cast("int").alias("k")
    sized = spans.filter("end > start").select("file", "start", "end", "symbol", k)
    blocks = F.array_distinct(F.array(F.expr("shiftright(start, k)"), F.expr("shiftright(end - 1, k)")))
    dealt = sized.withColumn("block", F.explode(blocks))
    asked = points.join(sized.select("file", "k").distinct(), "file").withColumn("block", F.expr("shiftright(point, k)"))
    return asked.join(dealt, ["file", "k", "block"]).filter((F.col("point") >= F.col("start")) & (F.col("point") < F.col("end")))


def public_surface(exports: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, name) reachable from entry files over re-exports (file, name, to_file, to_name); to_file
    null marks a declaration."""
    seen = stored(exports.join(entries, "file", "left_semi").select("file", "name").distinct(), "seen")
    parts, moved = [seen], seen
    while not moved.isEmpty():
        nxt = moved.join(exports, ["file", "name"]).filter("to_file is not null").select(F.col("to_file").alias("file"), F.col("to_name").alias("name")).distinct()
        moved = stored(nxt.join(seen, ["file", "name"], "left_anti"), "moved")
        seen = stored(seen.union(moved), "seen")
        parts += [moved, seen]
    discard(*parts[:-1])
    return seen.join(exports.filter("to_file is null").select("file", "name"), ["file", "name"], "left_semi")
