"""The registered queries themselves, on the smallest tables."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from specdrift.llm import queries
from specdrift.llm.io import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert columns == sorted(want.columns) and key(got) == key(want)


def test_op3_digests_are_those_of_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = queries.op3_bpe(spark, SF).toPandas().set_index("doc_id")
    assert list(got.columns) == ["n_tokens", "ids_sha256", "decoded_sha256"] and len(got) == len(docs)
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert tuple(got.loc[i]) == want


def test_op5_takes_what_each_source_is_due(spark, docs):
    got = queries.op5_mixing(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "size", "source_size", "target", "taken"]
    size = {i: len(WORD.findall(t or "")) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    source = dict(zip(docs["doc_id"], docs["source"], strict=True))
    assert all(size[i] == n for i, n in zip(got["doc_id"], got["size"], strict=True))
    assert (got["taken"] <= 3 * got["size"]).all()
    assert got["target"].groupby(got["doc_id"].map(source)).first().sum() == pytest.approx(sum(size.values()))
    for _, mine in got.groupby(got["doc_id"].map(source)):
        assert mine["source_size"].iloc[0] == mine["size"].sum()
        assert abs(mine["taken"].sum() - mine["target"].iloc[0]) <= 0.05 * mine["target"].iloc[0]


def test_op9_removes_what_brute_force_removes(spark, docs):
    got = queries.op9_suffix_dedup(spark, SF).toPandas().set_index("doc_id")
    seen: set = set()
    for i, t in sorted(zip(docs["doc_id"], docs["text"], strict=True)):
        b = (t or "").encode()
        hit = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                hit[k + 1 : k + 101] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~hit[1:-1]].tobytes()
        assert tuple(got.loc[i]) == (len(b), int(hit.sum()), int((np.diff(hit.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
