"""Near-duplicate classes against a brute force that shares no code with the operator."""

from collections import Counter, defaultdict

import pytest

from specdrift.llm import near_dedup
from specdrift.llm.queries import op8_near_dedup

SF = "/root/testdata/sf0.01"


def _weights(text):
    words = (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def _similarity(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def _pairs(texts):
    """Pairs of different texts at 0.8 or more. The shares that two texts have in common bound their
    similarity from above, so only pairs that have 0.8 of those in common are worked out."""
    weights = {t: _weights(t) for t in texts}
    where, shared = defaultdict(list), defaultdict(float)
    for t, w in weights.items():
        total = sum(w.values())
        for s, n in w.items():
            for other, part in where[s]:
                shared[other, t] += min(part, n / total)
            where[s].append((t, n / total))
    return [(a, b) for (a, b), x in shared.items() if x >= 0.8 - 1e-9 and _similarity(weights[a], weights[b]) >= 0.8]


def test_no_pair_of_the_given_table_is_lost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = op8_near_dedup(spark, SF).toPandas()
    assert len(got) == len(docs)
    of = dict(zip(got["doc_id"], got["class_id"], strict=True))
    by_text = defaultdict(list)
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        by_text[t].append(i)
    pairs = _pairs([t for t in by_text if t])
    lost = [p for p in pairs if of[by_text[p[0]][0]] != of[by_text[p[1]][0]]]
    assert len(pairs) >= 4 and not lost
    root = {i: i for i in docs["doc_id"]}
    find = lambda i: i if root[i] == i else find(root[i])
    links = [(by_text[a][0], by_text[b][0]) for a, b in pairs] + [(x, y) for t, ids in by_text.items() if _weights(t) for x, y in zip(ids, ids[1:], strict=False)]
    for x, y in links:
        a, b = sorted((find(x), find(y)))
        root[b] = a
    assert of == {i: find(i) for i in root}


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, None), (None, long), (None, None), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, "x y z u v w"), (5, "x y z u v w"), (9, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, class_id int")
    got = [tuple(r) for r in near_dedup.classes(docs).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, 1), (2, 1), (3, 3), (5, 5), (6, 5), (7, 5), (9, 9)]
    assert [x for x in got if x[0] is None] == [(None, None)] * 2


@pytest.mark.parametrize("m", [7, 336])
def test_registers_of_chunks_do_not_depend_on_neighbours(m):
    sets = [near_dedup.shingles(" ".join(f"w{i}" for i in range(n, n + 3 * n))) for n in (2, 3, 9, 40)]
    whole = near_dedup.signatures(sets, m)
    for i, one in enumerate(sets):
        assert (near_dedup.signatures([one], m)[0] == whole[i]).all()
