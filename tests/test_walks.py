"""Levels, propagation and components on long chains, rings, stars and random graphs, against plain walks."""

import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from specdrift.operators import walks as W
from specdrift.plans import shared


def components(edges):
    after: dict = {}
    nodes = sorted({n for e in edges for n in e})
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    index, low, stack, on, out, at = {}, {}, [], set(), {}, 0
    for start in nodes:  # an iterative depth-first walk
        if start in index:
            continue
        todo = [(start, iter(sorted(after.get(start, ()))))]
        index[start] = low[start] = at = at + 1
        stack.append(start)
        on.add(start)
        while todo:
            n, rest = todo[-1]
            for m in rest:
                if m not in index:
                    index[m] = low[m] = at = at + 1
                    stack.append(m)
                    on.add(m)
                    todo.append((m, iter(sorted(after.get(m, ())))))
                    break
                if m in on:
                    low[n] = min(low[n], index[m])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[n])
                if low[n] == index[n]:
                    members = []
                    while not members or members[-1] != n:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    out |= dict.fromkeys(members, min(members))
    return out


def heights(edges, own=None):
    after: dict = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
    done: dict = {}
    for start in {n for e in edges for n in e}:
        todo = [start]
        while todo:
            n = todo[-1]
            if later := [m for m in after.get(n, ()) if m not in done]:
                todo += later
                continue
            below = [done[m] for m in after.get(n, ())]
            done[n] = (max(below) + 1 if below else 0) if own is None else own(n) + max(below, default=0)
            todo.pop()
    return done


def table(spark, edges):
    return spark.createDataFrame(list(edges) or [(0, 0)], "src bigint, dst bigint").limit(len(edges))


@pytest.fixture
def rounds(monkeypatch):
    made = []
    real = W.stored
    monkeypatch.setattr(W, "stored", lambda df, name: made.append(name) or real(df, name))
    return made


def shapes():
    r = random.Random(4)
    yield "empty", []
    yield "loop", [(3, 3)]
    yield "random", [(r.randrange(60), r.randrange(60)) for _ in range(100)]
    yield "dense", [(r.randrange(25), r.randrange(25)) for _ in range(120)]
    yield "rings", [(10 * k + i, 10 * k + (i + 1) % 7) for k in range(9) for i in range(7)] + [(10 * k + 2, 10 * k + 15) for k in range(7)] + [(95, 3), (96, 95), (2, 96)]
    yield "ring with tails", [(i, (i + 1) % 40) for i in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(130, 5), (7, 200)] + [(200 + i, 201 + i) for i in range(20)]
    yield "back edges", [(i, i + 1) for i in range(80)] + [(30, 10), (70, 55), (20, 12)]


@pytest.mark.parametrize(("name", "edges"), [pytest.param(n, e, id=n) for n, e in shapes()])
def test_components(spark, name, edges):
    got = {r.node: r.component for r in W.strongly_connected(table(spark, edges + edges[:5])).collect()}
    assert got == components(edges)


@pytest.mark.parametrize("seed", [1, 3])
def test_values_of_random_dags(spark, seed):
    r = random.Random(seed)
    edges = [tuple(sorted((r.randrange(300), r.randrange(300)), reverse=True)) for _ in range(250 * seed)]
    edges += [(400 + i, 399 + i) for i in range(1, 60)] + [(500 + i, 400 + 3 * i) for i in range(12)] + [(399 + 1, 7)]  # chains with branches
    assert {r.node: r.level for r in W.levels(table(spark, edges)).collect()} == heights(edges)
    own = spark.range(0, 600, 2).select(F.col("id").alias("node"), (F.col("id") % 7).alias("value")).join(W._nodes(table(spark, edges)), "node")
    got = {r.node: (r.value, r.strict) for r in W.propagate(table(spark, edges), own).collect()}
    want = heights(edges, lambda n: n % 7 if n % 2 == 0 else 0)
    leads = {a for a, b in edges if a != b}
    assert got == {n: (v, n not in leads) for n, v in want.items()}


def test_long_chain_takes_few_rounds(spark, rounds):
    chain = spark.range(10_000).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    got = W.levels(chain)
    assert got.filter("level <> node").isEmpty() and got.count() == 10_001 and len(rounds) < 20
    rounds.clear()
    got = W.strongly_connected(chain)
    assert got.filter("component <> node").isEmpty() and got.count() == 10_001 and len(rounds) < 30


def test_long_ring_takes_few_rounds(spark, rounds):
    ring = spark.range(10_000).select("id", ((F.col("id") * 7919 + 13) % 10_007).alias("x")).select(F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    got = W.strongly_connected(ring)
    assert got.count() == 10_000 and got.filter("component <> 0").isEmpty() and len(rounds) < 40


def test_star(spark, rounds):
    star = spark.range(1, 10_000).select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"))
    W.levels(star).count()
    began = time.time()
    rounds.clear()
    got = W.levels(star)
    assert {tuple(r) for r in got.groupBy("level").count().collect()} == {(0, 1), (1, 9999)}
    assert len(rounds) <= 5 and time.time() - began < 20


@pytest.mark.parametrize("edges", [[(0, 1), (1, 0)], [(i, (i + 1) % 50) for i in range(50)], [(0, 1), (1, 2), (2, 1), (2, 3), (1, 3)]])
def test_cycle_has_no_levels(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        W.levels(table(spark, edges))


def test_only_the_result_is_left(spark, tmp_path, monkeypatch):
    edges = table(spark, [(i, (i + 1) % 30) for i in range(30)] + [(50 + i, 51 + i) for i in range(30)])
    monkeypatch.setattr(shared, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    W.strongly_connected(edges).count()
    W.levels(edges.filter("src >= 50")).count()
    assert len(os.listdir(tmp_path)) == 2
