"""Cases at the edges: very long pieces, labels of one class, clashing names, sources at their stop, texts that only share a passage."""

import random

import pytest

from specdrift.llm import bpe, mixing, near_dedup, quality_model
from specdrift.llm.io import tokenizer_path


def test_pieces_of_a_million_characters_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    ours, theirs = bpe.vocabulary(path), Tokenizer.from_file(path)
    random.seed(5)
    for text in ("a" * 1_000_000, "".join(random.choices("etaoinshrdlu", k=1_000_000)), "=" * 1_000_000):
        ids, _ = ours.encode(text)
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == text


def test_quality_of_one_class_repeated_labels_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the lamp of the river.", "s", "p"), (2, "### $$$", "s", "p"), (2, "### $$$", "s", "p"), (3, None, "s", "p")], "doc_id bigint, text string, score string, predicted string")
    x = quality_model.with_statistics(docs)
    for label in (0, 1):
        labels = spark.createDataFrame([(1, label), (1, label), (2, label)], "doc_id bigint, y int")
        model = quality_model.fit(x.select("doc_id", "x").join(labels, "doc_id").select("x", "y"))
        got = quality_model.score_rows(x, model)
        assert sorted(got.columns) == ["doc_id", "predicted", "score", "text"]
        assert [(r["score"], r["predicted"]) for r in got.collect()] == [(float(label), label)] * 4
    assert quality_model.score_rows(x.limit(0), model).count() == 0
    # of repeated labels that disagree, each counts: the same statistics get the share of label 1
    both = x.filter("doc_id = 1").select("x").crossJoin(spark.createDataFrame([(1,), (1,), (1,), (0,)], "y int"))
    assert quality_model.score_rows(x.filter("doc_id = 1"), quality_model.fit(both)).first()["score"] == pytest.approx(0.75)


def test_mixing_stops_at_three_times_a_source_of_long_documents(spark):
    """The last source weighs most and is small: each of its long documents is taken three times, the rest goes to others."""
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(2000)] + [(5000 + i, "w " * 300, "c") for i in range(3)] + [(6000, "w " * 200_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    last = [r for r in got if r["source"] == "c"]
    assert [r["copies"] for r in last] == [3, 3, 3] and all(r["target"] == pytest.approx(2700) for r in last)
    assert all(0 <= r["copies"] <= 3 for r in got)
    for source in ("a", "b"):
        mine = [r for r in got if r["source"] == source]
        target = mine[0]["target"]
        assert target <= 3 * sum(r["size"] for r in mine) and abs(sum(r["copies"] * r["size"] for r in mine) - target) <= max(200_000 if source == "b" else 0, 0.02 * target)


def test_texts_that_share_a_passage_but_do_not_link(spark):
    """Hundreds of members of the same buckets at a similarity near 0.63: none links but the planted near copies."""
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=7))
    passage = " ".join(word() for _ in range(24))
    rows = [(i, passage + " " + " ".join(word() for _ in range(6))) for i in range(300)]
    # one more word at the end: 26 of 27 shingles in common
    rows += [(1000 + i, rows[i][1] + " " + word()) for i in range(0, 300, 10)]
    sets = {i: near_dedup.shingles(t) for i, t in rows}
    assert near_dedup.probability_jaccard(sets[1], sets[2]) < 0.8 <= near_dedup.probability_jaccard(sets[0], sets[1000])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
