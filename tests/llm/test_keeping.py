"""The pipeline's quality stage keeps clean texts in which no listed stop word is to be expected."""

import corpus_pipeline
from specdrift.llm import quality_rules


def test_stop_words_are_expected_of_long_texts_in_known_languages_only(spark):
    words = "harbour engines carry heavy freight across winding rivers toward distant mountain villages".split()
    long = " ".join(f"{w}{chr(97 + i)}" for i in range(6) for w in words)
    rows = [(1, " ".join(words), "en"), (2, long, "en"), (3, long, "it"), (4, long, None), (5, "two words", "en"), (6, "The " + long + " of the", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, "").collect()}
    assert kept == {1, 3, 6}
    # the table of op6_quality_rules, as its SQL has it
    assert {r["doc_id"] for r in quality_rules.apply_rules(docs).filter("kept").collect()} == {6}
