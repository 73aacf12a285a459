"""Near-duplicates, suffix and substring removal, nearest neighbours, the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from specdrift.llm import ann, near_dedup, substring_dedup, suffix_dedup
from specdrift.llm.suffix_dedup import LoserTree, front_code, front_decode


def _corpus(seed: int, n: int = 40) -> list:
    """Copies, edited copies, shared passages at odd places, periodic and short texts, a null."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(8)]
    texts = []
    for _ in range(n):
        kind, b = rng.random(), rng.choice(base)
        w = b.split(" ")
        if kind < 0.2:
            texts.append(b)
        elif kind < 0.5:
            w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([" ", "\n", " \t"]).join(w))
        elif kind < 0.8:
            i = rng.randrange(len(w) - 15)
            texts.append(" ".join([*(word() for _ in range(rng.randint(0, 20))), *w[i : i + rng.randint(10, 40)], *(word() for _ in range(rng.randint(0, 20)))]))
        else:
            texts.append(rng.choice(["To " * 70, "ab", "", "To " * 90 + b, b + " " + b]))
    return [*enumerate(texts), (n, None), (n + 1, texts[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_words string").repartition(3)
    got = substring_dedup.find(docs, substring_dedup.digest, "n_words bigint, n_removed bigint, kept_sha256 string")
    got = {r["doc_id"]: r for r in got.collect()}
    seen: dict = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 12) if seen[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize(("seed", "chunk"), [(1, 2_000_000), (2, 1), (3, 2_000_000), (3, 1000)])
def test_suffixes_against_brute_force(spark, seed, chunk):
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_spans string").repartition(3)
    got = suffix_dedup.find(docs, suffix_dedup.digest, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", chunk=chunk)
    got = {r["doc_id"]: r for r in got.collect()}
    seen = set()
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                hit[k + 1 : k + 101] = True
            seen.add(s)
        kept = bytes(x for x, h in zip(b, hit[1:], strict=False) if not h)
        spans = int((np.diff(hit.astype(int)) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_loser_tree_merges_and_knows_common_prefixes():
    rng = random.Random(9)
    for streams in (0, 1, 2, 5, 9):
        runs = [sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 30))}) for _ in range(streams)]
        out = list(LoserTree([front_decode(front_code([(k, b"p") for k in run])) for run in runs]))
        keys = [k for k, _, _ in out]
        assert keys == sorted(k for run in runs for k in run)
        for a, (b, shared, _) in zip(keys, out[1:], strict=False):
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert shared == n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_dedup.find(none, substring_dedup.digest, "n_words bigint, n_removed bigint, kept_sha256 string").count() == 0
    assert suffix_dedup.find(none, suffix_dedup.digest, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").count() == 0
    assert near_dedup.classes(none).count() == 0


def test_cleaned_text():
    assert substring_dedup.cleaned("a b\nc  d", np.array([1, 3])) == ("a d",)
    assert substring_dedup.cleaned("a b\nc  d", np.array([2, 4])) == ("a b\n",)
    assert substring_dedup.cleaned(None, np.array([])) == (None,)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join([*passage, *(word() for _ in range(rng.randint(5, 30)))]) for _ in range(15)]
    rows += ["one two", "one two", "", None, "  ", "To " * 50, "To " * 60, rows[0]]
    docs = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(rows)], "doc_id bigint, text string, class_id int")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    sets = [near_dedup.shingles(t) for t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i * 3: find(i) * 3 for i in range(len(rows))}


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    items = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a = (np.sort(items[:45]), rng.integers(1, 5, 45))
    b = (np.sort(items[15:]), rng.integers(1, 5, 45))
    exact = 0.0
    wa, wb = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    for i in wa.keys() & wb.keys():
        exact += 1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in wa.keys() | wb.keys())
    assert near_dedup.probability_jaccard(a, b) == pytest.approx(exact)
    sig = near_dedup.signatures([a, b, (np.empty(0, np.uint64), np.empty(0, np.int64))], 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.035) and (sig[2] == 0).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] * 16), (1005, [])]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(base, base.filter("vec_id % 20 = 0"), 10, "embedding", "vec_id").collect()
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = data @ data[q]
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-score)[:10].tolist()))
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(score[r["vec_id"]]) for r in mine)
    assert hits >= 0.9 * 300 and {r["query_id"] for r in got} == set(range(0, 600, 20))
    few = spark.createDataFrame(rows[:5], base.schema)
    assert ann.search(few, few.filter("vec_id = 0"), 10, "embedding", "vec_id").count() == 4
    assert ann.search(few.limit(0), few.limit(0), 10, "embedding", "vec_id").count() == 0
