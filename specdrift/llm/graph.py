"""Connected components of an edge table, in DataFrame rounds with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdrift.plans.shared import discard, stored

#: Edges that one task takes; tables of fewer are worked on without shuffles.
EDGES_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint); root is its component's least node.

    Alternating large-star and small-star rounds: each points neighbourhoods at their least member,
    so the number of edges never grows beyond the input's and hub nodes only cost a grouped minimum.
    Every round is written to the shared folder, and the one before deleted. Nulls and loops link
    nothing; repeated edges count once; no edge gives no row.
    """
    one = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links, digest = stored(one, "links"), None
    tasks = 1 + links.count() // EDGES_A_TASK
    while True:
        # large star: each node's larger neighbours go to its least neighbour (or itself)
        near = links.coalesce(tasks)
        both = near.union(near.select("b", "a")).coalesce(tasks)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "v")
        large = (
            both.join(least, both["a"] == least["v"])
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        # small star: each node and its smaller neighbours go to the least of them
        lower = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        pulled = large.join(lower, large["a"] == lower["v"])
        small = (
            pulled.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lower.select("v", "m"))
            .distinct()
        )
        before, links = links, stored(small, "links")
        discard(before)
        # equal tables have equal digests; a round that changes nothing is the last
        digest, last = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()), digest
        if digest == last:
            break
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
