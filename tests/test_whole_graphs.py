"""The graph queries over all rows: no row is left out, the graphs grow, results by brute force."""

import duckdb
import pytest

from specdrift.operators import graph as G
from specdrift.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "source", "rows"), [
    ("edges_cyc", "events", "count(*)"),
    ("edges_dag", "orders", "count(DISTINCT (greatest(o_orderkey, o_custkey), least(o_orderkey, o_custkey))) FILTER (o_orderkey <> o_custkey)"),
])
def test_every_row_is_an_edge(spark, name, source, rows):
    for sf in (SF, "/root/testdata/sf0.01"):
        want = duckdb.sql(f"SELECT {rows} FROM '{sf}/{source}.parquet'").fetchall()[0][0]
        assert catalog.view(spark, sf, name).count() == want


def test_graphs_grow_with_the_table(spark):
    for name in ("edges_cyc", "edges_dag", "exports"):
        small, large = (catalog.view(spark, sf, name).distinct().count() for sf in (SF, "/root/testdata/sf0.01"))
        assert large >= 5 * small


def test_components_against_brute_force(spark):
    edges = {(r["src"], r["dst"]) for r in catalog.view(spark, SF, "edges_cyc").collect()}
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(node):
        seen, todo = {node}, [node]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    reached = {n: reach(n) for e in edges for n in e}
    want = {n: min(m for m in r if n in reached[m]) for n, r in reached.items()}
    got = {r["node"]: r["component"] for r in catalog.QUERIES["scc"](spark, SF).collect()}
    assert got == want
    dag = catalog.QUERIES["condensed_dag"](spark, SF)
    assert {tuple(r) for r in dag.select("src", "dst").collect()} == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert G.levels(dag).count() == G.nodes_of(dag).count()
