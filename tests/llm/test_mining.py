"""Collocations and ranked search against brute force over words."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from specdrift.llm import collocations, lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------ collocations


def phrases(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    cands = {}
    for key, a in f.items():
        lang, *w = key
        if len(w) > 1 and a >= least:
            cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            cands[key] = (a, left, right, score)
    gone = set()
    for lang, *w in cands:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * f[lang, *w] >= 80 * f[lang, *w[i : i + k]]:
                    gone.add((lang, *w[i : i + k]))
    out = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(w).encode(), le, r) for (x, *w), (a, le, r, s) in cands.items() if x == lang and (x, *w) not in gone)
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(mine[:top])]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "É", "é", "x.y", "a", "日", "und", "(b)"]
    text = lambda n: "".join(r.choices(words, weights=[9, 3, 8, 1, 1, 1, 4, 2, 2, 2])[0] + r.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".."]) for _ in range(n))
    docs = [(r.choice(["en", "de", None, "und"]), text(r.randrange(60))) for _ in range(60)]
    shared = text(150)
    docs += [("en", shared + text(5)) for _ in range(40)]  # copies
    docs += [("en", None), (None, ""), ("fr", " . "), ("de", "lone " * 2000), ("de", "a b " * 400), ("en", "word" * 5000)]
    return docs


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 2000), (2, 3, 25)])
def test_phrases_equal_brute_force(spark, seed, least, top):
    docs = corpus(seed)
    got = collocations.mine(spark.createDataFrame(docs, "lang string, text string").repartition(6), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(docs, least, top)


def test_chunks_are_bounded_and_parsed_once(spark):
    docs = spark.createDataFrame([("en", "same " * 10_000)] * 3 + [("en", "some other words that say little, in two pieces")] * 5, "lang string, text string")
    rows = collocations.dictionary(docs).collect()
    assert max(len(r.own.split()) for r in rows) <= collocations.LONGEST and all(len(r.tail.split()) <= 3 for r in rows)
    assert sum(len(r.own.split()) * r.n for r in rows) == 30_000 + 45
    assert len(rows) < 20


def test_few_bits_change_nothing(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(collocations, "BITS", 0)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # nearly every phrase seems frequent
    got = collocations.mine(spark.createDataFrame(docs, "lang string, text string"), least=5, top=50)
    assert sorted(map(tuple, got.collect())) == phrases(docs, 5, 50)


def test_products_beyond_64_bits(spark):
    big = 10**15
    grams = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big), ("en", "b c", 2, big), ("en", "c", 1, big), ("en", "a b c", 3, 8 * big // 10)], "lang string, phrase string, k int, f bigint")
    scored = collocations.scored(grams)
    assert {(r.phrase, r.score) for r in scored.collect()} == {("a b", 400000), ("b c", 666666), ("a b c", 400000)}
    assert {r.phrase for r in collocations.undominated(scored, grams).collect()} == {"a b c"}


def test_no_text_gives_no_phrase(spark):
    docs = spark.createDataFrame([("en", None, 1), ("en", "a b", 2)], "lang string, text string, phrase int")
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(docs.filter(F.lit(False))).count() == 0


# ------------------------------------------------------------------ ranked search


def ranked(docs, items, top=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, words = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in asked.items():
        found = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n // max(words, 1)
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in q.items() if c[t])
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, i + 1, doc, -s) for i, (s, doc) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "é", "日本", "THE", "the"]
    text = lambda n: " ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(r.choice([3, 20, 60, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # copies, which tie
    docs += [(3000, None), (3001, ""), (None, docs[3][1]), (9, docs[9][1]), (3002, text(20_000))]
    items = [(i, text(r.choice([1, 2, 8, 30]))) for i in range(25)] + [(50, docs[7][1]), (51, None), (52, "nowhere"), (None, "w1"), (3, "w5 w6 w6")]
    return docs, items


@pytest.mark.parametrize(("seed", "block", "bucket"), [(1, 50_000, 2048), (2, 40, 16)])
def test_ranks_equal_brute_force(spark, seed, block, bucket):
    docs, items = texts(seed)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame(items, "item_id bigint, text string"), block=block, bucket=bucket)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == ranked(docs, items)


def test_fewer_than_ten_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "A", 2)], "doc_id bigint, text string, score int")
    items = spark.createDataFrame([("q", "b a a")], "item_id string, text string")
    assert [tuple(r) for r in lexical.search(docs, items).orderBy("rank").collect()] == ranked([(1, "a b"), (2, "A")], [("q", "b a a")])
    assert lexical.search(docs.filter(F.lit(False)), items).count() == 0
    assert lexical.search(docs, items.filter(F.lit(False))).count() == 0
