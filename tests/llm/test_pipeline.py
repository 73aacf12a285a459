"""Each stage of the pipeline against SQL or brute force, on what its predecessor kept."""

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from specdrift.llm import near_dedup
from specdrift.llm.io import tokenizer_path
from specdrift.llm.queries import OP6_SQL

SF = "/root/testdata/sf0.001"


def _near(rows: dict) -> set:
    """Least doc_id of each class, by comparing all pairs."""
    sets = {i: near_dedup.shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i][0]) and len(sets[j][0]) and near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def _cut(rows: dict) -> dict:
    """Kept words by document."""
    first: dict = {}
    for i in sorted(rows):
        w = rows[i].split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in rows.items():
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return {i: w for i, w in out.items() if w}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept.append(docs.toPandas())
        assert name == "bpe" or docs.columns == columns
    rules, near, cut, mixed, coded = kept
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert set(rules["doc_id"]) == {r[0] for r in duck.sql(f"select doc_id from ({OP6_SQL}) where kept").fetchall()}
    text = lambda df: dict(zip(df["doc_id"], df["text"], strict=True))
    assert set(near["doc_id"]) == _near(text(rules))
    want = _cut(text(near))
    assert {i: t.split() for i, t in text(cut).items()} == want
    same = text(near)
    assert all(t == same[i] for i, t in text(cut).items() if t.split() == same[i].split())
    assert (cut["n_chars"] == cut["text"].str.len()).all()
    copies = mixed.groupby("doc_id").size()
    assert copies.max() <= 3 and set(copies.index) <= set(cut["doc_id"])
    taken = sum(len(want[i]) * n for i, n in copies.items())
    assert abs(taken - sum(map(len, want.values()))) <= 0.05 * taken
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert len(coded) == len(mixed)
    for i, n, ids in zip(coded["doc_id"], coded["n_tokens"], coded["ids"], strict=True):
        assert list(ids) == tokenizer.encode(text(cut)[i], add_special_tokens=False).ids and len(ids) == n
