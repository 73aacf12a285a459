"""Decontamination against a brute force over words, by both ways of meeting the benchmark."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from specdrift.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    own = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                own.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for m in {len(k) for k in own}:
            for i in range(len(w) - m + 1):
                if (met := own.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    ids |= met
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows():
    r = random.Random(5)
    vocabulary = ["Aa", "bÉ", "ç9", "dd", "É", "x", "日本"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "_", "-"]) for _ in range(n))
    items = [(i, text(r.choice([12, 25, 10, 11]))) for i in range(30)] + [(100, "dd dd dd"), (101, "x"), (102, "x É x É"), (103, None), (104, " -- "), (None, "aa aa"), (7, "repeats an id É É É É")]
    items += [(200 + i, items[0][1]) for i in range(40)]  # a passage of many items
    docs = []
    for i in range(60):
        parts = [text(r.randrange(40))] + [it[1] or "" for it in r.sample(items, r.choice([0, 0, 1, 2]))] + [text(r.randrange(30))]
        docs.append((i, " ".join(parts)))
    docs += [(1000 + i, items[0][1].upper() + " end") for i in range(50)]  # a group of copies
    docs += [(2000, None), (2001, ""), (2002, "  \n"), (None, items[3][1]), (5, "repeats an id " + items[4][1]), (2003, text(30_000))]
    return docs, items


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_hits_and_items_equal_brute_force(spark, most):
    docs, items = rows()
    found = decontaminate.find(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), most=most
    )
    got = sorted((tuple(r) for r in found.select("doc_id", *decontaminate.digests(found)).collect()), key=str)
    assert got == brute(docs, items)


def test_spans_are_the_words_hit(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Zero {item}! and {item.upper()} {item}"), (2, " ".join(item.split()[:9])), (3, item[4:] + " twelve")]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([("i", item)], "item_id string, text string"))
    got = {r.doc_id: [tuple(x) for x in r.hits] for r in found.collect()}
    assert got == {1: [(1, 12), (13, 35)], 2: [], 3: [(0, 10)]}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_empty_tables_and_clashing_names(spark, most):
    docs = spark.createDataFrame([(1, "a b", 5, "k", None)], "doc_id bigint, text string, n_words int, seed string, items void")
    items = spark.createDataFrame([(1, "b")], "item_id bigint, text string")
    none = items.filter(F.lit(False))
    (row,) = decontaminate.find(docs, items, most=most).collect()
    assert (row.doc_id, row.n_words, row.seed, row["items"], len(row.hits)) == (1, 2, "k", ["1"], 1)
    (row,) = decontaminate.find(docs, none, most=most).collect()
    assert (row.n_words, row["items"], row.hits) == (2, [], [])
    assert decontaminate.find(docs.filter("doc_id > 1"), items, most=most).count() == 0
