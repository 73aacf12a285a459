"""The pipeline on odd rows: nulls, repeats, clashing and unusual columns, long texts, empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

GOOD = "the cat and the dog went to a house in the town and it was good for them all because of the rain on that day near a river"


def _docs(spark):
    other = " ".join(f"the {chr(97 + i % 26)}{i} of" for i in range(40_000))
    rows = [(1, GOOD), (2, GOOD), (3, None), (4, ""), (5, " "), (None, GOOD), (6, other), (7, GOOD + " and then " + " ".join(f"more{i} of" for i in range(30))), (7, GOOD + " and then " + " ".join(f"more{i} of" for i in range(30))), (8, "###")]
    docs = spark.createDataFrame([(i, t, "en", "s" if (i or 0) % 2 else None, len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = {"__had": F.lit("k"), "n_words": F.lit("w"), "size": F.lit("s"), "kept": F.lit("x"), "x": F.lit(1.5), "row": F.lit("r"), "rest": F.lit("t"), "doc": F.lit("d"), "__text": F.lit("u"), "rate": F.array(F.lit(1))}
    return docs.withColumns(names | {"at": F.expr("timestamp_ntz'2024-01-02 03:04:05.123456'"), "when": F.expr("timestamp'2024-01-02 03:04:05.123456'")})


def test_columns_come_out_as_they_went_in(spark):
    docs = _docs(spark)
    one = docs.first()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.count() > 0 and docs.columns == list(one.asDict()), name
        for r in docs.collect():
            for c in docs.columns[5:]:
                assert r[c] == one[c], (name, c)
    kept = [r["doc_id"] for r in docs.collect()]
    assert set(kept) <= {1, None, 6, 7} and 2 not in kept
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(coded) == len(kept) and all(r["n_tokens"] == len(r["ids"]) for r in coded)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in coded if r["doc_id"] != 7)


def test_each_stage_takes_an_empty_table(spark):
    docs = _docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.parametrize("kind", ["substring", "suffix"])
def test_removal_passes_columns_and_rows_through(spark, kind):
    from specdrift.llm import substring_dedup, suffix_dedup

    docs = _docs(spark)
    module, ddl = {
        "substring": (substring_dedup, "n_words bigint, n_removed bigint, kept_sha256 string"),
        "suffix": (suffix_dedup, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"),
    }[kind]
    got = module.find(docs, module.digest, ddl).collect()
    assert len(got) == docs.count()
    rows = [(r["doc_id"], r["n_removed"] > 0) for r in got]
    # the copy goes, the null row is no witness and keeps all, and repeated rows have one fate
    assert sorted((r for r in rows if r[0] is not None), key=str) == sorted([(1, False), (2, True), (3, False), (4, False), (5, False), (6, False), (7, True), (7, True), (8, False)], key=str)
    assert (None, False) in rows
    assert all(r["at"].microsecond == 123456 and r["when"].microsecond == 123456 and r["__had"] == "k" and r["rest"] == "t" for r in got)


def test_rows_of_one_id_with_different_texts(spark):
    from specdrift.llm import substring_dedup, suffix_dedup

    a, b = " ".join(f"word{i}" for i in range(40)), " ".join(f"item{i}" for i in range(17))
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (2, a), (2, "x " + a)], "doc_id bigint, text string")
    got = substring_dedup.find(docs, substring_dedup.digest, "n_words bigint, n_removed bigint, kept_sha256 string").collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 17, 0), (1, 40, 0), (2, 17, 17), (2, 40, 40), (2, 41, 40)]
    got = suffix_dedup.find(docs, suffix_dedup.digest, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - r["n_removed"]) for r in got) == [(1, len(b), len(b)), (1, len(a), len(a)), (2, len(b), 0), (2, len(a), 0), (2, len(a) + 2, 2)]
