"""Walks over dependency graphs (src depends on dst) whose rounds do not follow the longest path.

Two structures keep the rounds few. Nodes are *peeled*: one whose dependencies are all done tells its value over its
own links, once, and those links are read no more. And a node with one link left is a *pointer*: it leaves the
graph, links to it go on to where its chain of pointers ends, and chains are followed by jumps of four at a time, so
a path of n nodes takes log n rounds. Every round is a table in the shared folder; a walk deletes all but its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from specdrift.plans.shared import discard, stored

#: Rounds of peeling before chains are looked for, and the share of nodes that must be pointers then.
PEELED, SHARE = 3, 10


class _Scratch:
    """Tables of one walk."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        discard(*self.tables)
        return out


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


# ------------------------------------------------------------------ values from the leaves up


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level) of an acyclic graph: 0 without a dependency, else one more than the highest of them.

    A cycle is an error. Loops of a node to itself are left out; repeated edges count once; ``nodes`` adds nodes without
    an edge; an empty graph gives no rows.
    """
    links = edges.select("src", "dst").filter("src <> dst").distinct().withColumn("w", F.lit(1))
    all_nodes = _nodes(edges) if nodes is None else _nodes(edges).union(nodes.select("node")).distinct()
    return climb(links, all_nodes.withColumn("least", F.lit(0))).withColumnRenamed("value", "level")


def propagate(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, value, strict): what a node has itself (own: node, value; 0 without a row) plus the greatest value of its
    dependencies, as summaries of callees feed their callers. ``strict`` marks the lowest level, whose nodes depend on nothing."""
    mine = own.groupBy("node").agg(F.max("value").alias("least"))
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    base = _nodes(edges).join(mine, "node", "full").select("node", F.coalesce("least", F.lit(0)).alias("least"))
    weighed = links.join(base.withColumnsRenamed({"node": "src", "least": "w"}), "src")
    lead = links.select(F.col("src").alias("node"), F.lit(False).alias("free")).distinct()
    return climb(weighed, base).join(lead, "node", "left").select("node", "value", F.col("free").isNull().alias("strict"))


def climb(links: DataFrame, base: DataFrame) -> DataFrame:
    """(node, value): the greatest of a node's own ``least`` (base: node, least) and value(dst) + w over its links
    (src, dst, w), which must be distinct and without a cycle."""
    scratch = _Scratch()
    links = scratch.put(links.withColumn("w", F.col("w").cast("bigint")), "links")
    per = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("left"))
    state = base.join(per, "node", "left").select("node", F.col("least").cast("bigint").alias("best"), F.coalesce("left", F.lit(0)).alias("left"))
    done, folded, rounds = [], [], 0
    while True:
        counts = {"ready": F.col("left") == 0, "single": F.col("left") == 1, "waiting": F.col("left") > 0}
        seen = Observation()
        state = scratch.put(state.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]), "state")
        ready, single, waiting = (seen.get.get(n) or 0 for n in counts)
        if rounds % PEELED == PEELED - 1 and single * SHARE >= waiting > 0:
            links, state, pointers = _folded(scratch, links, state, single)
            folded.append(pointers)
            rounds += 1
            continue
        done.append(state.filter("left = 0").select("node", F.col("best").alias("value")))
        if not waiting:
            break
        if not ready:
            raise ValueError("the graph has a cycle")
        told = links.join(done[-1].withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"))
        told = told.agg(F.count("*").alias("n"), F.max(F.col("value") + F.col("w")).alias("told"))
        state = state.filter("left > 0").join(told, "node", "left")
        state = state.select("node", F.greatest("best", "told").alias("best"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"))
        rounds += 1
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    for pointers in reversed(folded):
        found = scratch.put(found, "found")
        ends = found.withColumnsRenamed({"node": "to", "value": "end"})
        found = found.union(pointers.join(ends, "to").select("node", F.greatest("b", F.col("w") + F.col("end")).alias("value")))
    return scratch.result(found, "values")


def _folded(scratch: _Scratch, links: DataFrame, state: DataFrame, single: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, state, pointers) without the nodes that have one link left. value(node) = max(b, value(to) + w)."""
    alive = scratch.put(links.join(state.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w"), "links")
    one = state.filter("left = 1").select("node", F.col("best").alias("b"))
    rows = scratch.put(one.join(alive.withColumnsRenamed({"src": "node", "dst": "to"}), "node").select("node", "to", "w", "b"), "pointers")
    reach = 1
    while True:
        base, first = rows, rows.withColumn("open", F.lit(False))
        for _ in range(3):
            q = base.select(F.col("node").alias("to"), F.col("to").alias("q_to"), F.col("w").alias("q_w"), F.col("b").alias("q_b"))
            first = first.join(q, "to", "left").select(
                "node", F.coalesce("q_to", "to").alias("to"), (F.col("w") + F.coalesce("q_w", F.lit(0))).alias("w"),
                F.greatest("b", F.col("w") + F.col("q_b")).alias("b"), F.col("q_to").isNotNull().alias("open"),
            )
        rows = scratch.put(first, "pointers")
        more = not rows.filter("open").isEmpty()
        rows = rows.drop("open")
        if not more:
            break
        reach *= 4
        if reach > 16 * single:
            raise ValueError("the graph has a cycle")
    on = rows.select(F.col("node").alias("dst"), F.col("to").alias("q_to"), F.col("w").alias("q_w"), F.col("b").alias("q_b"))
    rest = alive.join(rows.select(F.col("node").alias("src")), "src", "left_anti").join(on, "dst", "left")
    moved = rest.groupBy("src", F.coalesce("q_to", "dst").alias("dst")).agg(
        F.max(F.col("w") + F.coalesce("q_w", F.lit(0))).alias("w"), F.max(F.col("w") + F.col("q_b")).alias("told")
    )
    moved = scratch.put(moved, "moved")
    per = moved.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("told").alias("told"))
    after = state.filter("left <> 1").join(per, "node", "left").select("node", F.greatest("best", "told").alias("best"), F.coalesce("n", F.lit(0)).alias("left"))
    return moved.select("src", "dst", "w"), after, rows


# ------------------------------------------------------------------ components


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): component is its least node.

    Nodes without an edge in or out are trimmed: each is a component. Nodes with one edge out are folded into where their
    chain ends, and belong to that node's component if it also reaches them. What is left is coloured by
    the least node that reaches it; within a colour, the nodes that reach its namesake are a component; the
    rest goes round again. No closure is built. Repeated edges count once; an empty graph gives no rows.
    """
    scratch = _Scratch()
    given = scratch.put(edges.select("src", "dst").distinct(), "edges")
    alive, folds, found = given.filter("src <> dst"), [], None
    while True:
        alive, n = _trimmed(scratch, alive)
        if not n:
            break
        out = alive.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"))
        pointers = scratch.put(out.filter("n = 1").select("node", "to"), "pointers")
        single = pointers.count()
        if single * SHARE >= n:
            alive, fold = _contracted(scratch, alive, pointers, single)
            folds.append(fold)
            continue
        part = _coloured(scratch, alive)
        found = part if found is None else found.union(part)
        gone = part.select("node")
        alive = alive.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    if found is None:
        found = given.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    for fold in reversed(folds):
        found = scratch.put(found.union(_unfolded(scratch, found, *fold)), "components")
    # labels are any member; the ends of folded chains have none yet
    ends = found.select(F.col("label").alias("node"), "label").distinct().join(found.select("node"), "node", "left_anti")
    named = scratch.put(found.union(ends), "components")
    least = named.groupBy("label").agg(F.min("node").alias("component"))
    big = named.join(least, "label").select("node", "component")
    return scratch.result(_nodes(given).join(big, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")


def _trimmed(scratch: _Scratch, alive: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have edges in and out, as far as trimming is worth a round; and how many."""
    alive = scratch.put(alive, "edges")
    n = alive.count()
    while n:
        into, out = alive.select(F.col("dst").alias("src")).distinct(), alive.select(F.col("src").alias("dst")).distinct()
        alive = scratch.put(alive.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "edges")
        before, n = n, alive.count()
        if (before - n) * SHARE < before:
            break
    return alive, n


def _hops(rows: DataFrame) -> DataFrame:
    """Pointers (node, to, least) followed four times: (node, a1, a2, a3, to, least, open); a1 to a3 are the pointers met on
    the way, null past the chain's end, least the least node of those left, open whether the last still was a pointer."""
    q = rows.select(F.col("node").alias("at"), F.col("to").alias("q_to"), F.col("least").alias("q_least"))
    met = rows.select("node", F.col("to").alias("at"), "least")
    for i in (1, 2, 3):
        met = met.join(q, "at", "left").select(
            "node", *[f"a{j}" for j in range(1, i)], F.when(F.col("q_to").isNotNull(), F.col("at")).alias(f"a{i}"),
            F.coalesce("q_to", "at").alias("at"), F.least("least", "q_least").alias("least"), F.col("q_to").isNotNull().alias("open"),
        )
    return met.select("node", "a1", "a2", "a3", F.col("at").alias("to"), "least", "open")


def _contracted(scratch: _Scratch, alive: DataFrame, pointers: DataFrame, single: int):
    """Edges without the pointers, and what ``_unfolded`` needs to put these back. Of a ring of pointers the least stays."""
    while True:
        hops, rows, reach, more = [], pointers.withColumn("least", F.col("node")), 1, True
        while more and reach <= single:
            hops.append(scratch.put(_hops(rows), "hops"))
            rows = hops[-1].select("node", "to", "least")
            more, reach = not hops[-1].filter("open").isEmpty(), reach * 4
        ring = rows.join(pointers.select(F.col("node").alias("to")), "to", "left_semi")
        if not more or ring.isEmpty():
            break
        # a pointer this many steps on is on the ring, and has seen all of it
        cut = ring.select("to").distinct().join(rows.select(F.col("node").alias("to"), "least"), "to").select(F.col("least").alias("node")).distinct()
        pointers = scratch.put(pointers.join(cut, "node", "left_anti"), "pointers")
    on = rows.select(F.col("node").alias("dst"), F.col("to").alias("root"))
    rest = scratch.put(alive.join(rows.select(F.col("node").alias("src")), "src", "left_anti").join(on, "dst", "left").select("src", "dst", "root"), "rest")
    moved = rest.select("src", F.coalesce("root", "dst").alias("dst")).filter("src <> dst").distinct()
    return moved, (rows.select("node", F.col("to").alias("root")), rest.filter("root is not null"), hops)


def _unfolded(scratch: _Scratch, found: DataFrame, roots: DataFrame, entries: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(node, label) of folded nodes that their chain's end reaches: edges from its component enter the chain at or before them."""
    label = lambda c, name: found.select(F.col("node").alias(c), F.col("label").alias(name))
    both = entries.join(label("src", "ls"), "src", "left").join(label("root", "lr"), "root", "left")
    seen = scratch.put(both.filter(F.coalesce("ls", "src") == F.coalesce("lr", "root")).select(F.col("dst").alias("node")).distinct(), "seen")
    for hop in hops:
        further = hop.join(seen, "node").select(F.explode(F.array_compact(F.array("a1", "a2", "a3"))).alias("node"))
        seen = scratch.put(seen.union(further).distinct(), "seen")
    return seen.join(roots, "node").join(label("root", "lr"), "root", "left").select("node", F.coalesce("lr", "root").alias("label"))


def _told(moved: DataFrame, edges: DataFrame, *agg: Column) -> DataFrame:
    return moved.join(edges, moved["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(*agg)


def _coloured(scratch: _Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) of one component for each colour."""
    labels = scratch.put(_nodes(edges).withColumn("label", F.col("node")), "labels")
    moved = labels
    while True:
        both = labels.join(_told(moved, edges, F.min("label").alias("new")), "node", "left")
        both = scratch.put(both.select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("fell")), "labels")
        labels, moved = both.select("node", "label"), both.filter("fell").select("node", "label")
        if moved.isEmpty():
            break
    a, b = labels.withColumnsRenamed({"node": "src", "label": "sc"}), labels.withColumnsRenamed({"node": "dst", "label": "dc"})
    back = scratch.put(edges.join(a, "src").join(b, "dst").filter("sc = dc").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
    part = moved = scratch.put(labels.filter("node = label"), "part")
    while True:
        reached = _told(moved, back, F.min("label").alias("label")).join(part.select("node"), "node", "left_anti")
        moved = scratch.put(reached, "moved")
        if moved.isEmpty():
            return part
        part = scratch.put(part.union(moved), "part")


# ------------------------------------------------------------------ what is passed down


def inherited(rows: DataFrame) -> DataFrame:
    """(node, value) from rows (node, parent, own boolean), one for each node: whether a node and all above it are true.

    Parents are followed by jumps of four at a time, and only from nodes that are true so far, so a chain of n takes log n
    rounds. A null ``own`` is false; so is all below a parent that is not there, and a ring of parents.
    """
    scratch = _Scratch()
    now = scratch.put(rows.select("node", F.col("parent").alias("to"), F.coalesce("own", F.lit(False)).alias("ok")), "inherited")
    n, reach = now.count(), 1
    while True:
        q = now.select(F.col("node").alias("to"), F.col("to").alias("q_to"), F.col("ok").alias("q_ok"))
        after = now
        for _ in range(3):
            ok = F.when(F.col("to").isNull(), F.col("ok")).otherwise(F.col("ok") & F.coalesce("q_ok", F.lit(False)))
            after = after.withColumn("to", F.when(F.col("ok"), F.col("to"))).join(q, "to", "left").select("node", F.when(ok, F.col("q_to")).alias("to"), ok.alias("ok"))
        now, reach = scratch.put(after, "inherited"), reach * 4
        if reach > 4 * n or now.filter("to is not null").isEmpty():
            return scratch.result(now.select("node", (F.col("ok") & F.col("to").isNull()).alias("value")), "inherited")
