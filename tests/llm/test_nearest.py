"""Nearest neighbours on the given table, ties, repeated ids, mixed dimensions, and layouts."""

import numpy as np
import pytest

from specdrift.llm import ann
from specdrift.llm.queries import op2_ann

SF = "/root/testdata/sf0.1"


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = op2_ann(spark, SF).toPandas()
    assert set(got.columns) == {"query_id", "rank", "vec_id", "score"}
    recall = []
    for q, mine in got.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        score = data @ data[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        recall.append(len(set(ids[best]) & set(mine["vec_id"])) / 20)
        at = {v: s for v, s in zip(ids, score, strict=True)}
        assert all(s == pytest.approx(at[v], abs=1e-12) for v, s in zip(mine["vec_id"], mine["score"], strict=True))
        assert mine.sort_values("rank")["score"].is_monotonic_decreasing and sorted(mine["rank"]) == list(range(1, 21))
    assert len(recall) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.95 and min(recall) >= 0.7
    # the share of rows that are verified
    index = ann.BlockIndex(ids, data, float(np.sqrt((data**2).sum(1)).max()), ann.rotations(data.shape[1] + 1))
    found = [len(f) for f in index.search(data[::20] @ ann.rotations(data.shape[1] + 1)[:-1], 20)]
    assert np.mean(found) <= 0.10 * len(ids)


def test_answer_does_not_depend_on_the_layout(spark, monkeypatch):
    base = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    found = []
    for parts in (1, 4, 16):
        dealt = base.repartition(parts)
        rows = ann.search(dealt, dealt.filter("vec_id % 200 = 0"), 20, "embedding", "vec_id").collect()
        found.append({tuple(r) for r in rows})
    assert found[0] == found[1] == found[2]


def test_many_blocks_find_what_one_finds(spark, monkeypatch):
    base = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = base.filter("vec_id % 100 = 0")
    rows = base.collect()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "QUERY_ROWS", 6)
    got = ann.search(base, asked, 20, "embedding", "vec_id").toPandas()
    recall = []
    for q, mine in got.groupby("query_id"):
        score = data @ data[ids == q][0]
        score[ids == q] = -np.inf
        recall.append(len(set(ids[np.argsort(-score)[:20]]) & set(mine["vec_id"])) / 20)
    assert len(recall) == asked.count() and np.mean(recall) >= 0.95


def test_ties_repeated_ids_and_mixed_dimensions(spark):
    e = [1.0, 0.0]
    rows = [(0, e), (7, e), (5, e), (3, [0.5, 0.0]), (3, [0.25, 0.0]), (0, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (None, e), (11, [1e300, 1e300, 0.0])]
    base = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank string")
    got = ann.search(base, base.filter("vec_id = 0"), 20, "embedding", "vec_id").collect()
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in got)[:4]
    assert first == [(1, 5, 1.0), (2, 7, 1.0), (3, 3, 0.5), (4, 3, 0.25)]
    assert all(r["vec_id"] not in (0, 9, 11) for r in got)
    assert {(r["vec_id"], r["score"]) for r in ann.search(base, base.filter("vec_id = 9"), 20, "embedding", "vec_id").collect()} == {(11, 1e300)}
