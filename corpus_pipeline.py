"""The corpus pipeline: quality rules, near-duplicates, substrings, mixing, encoding.

Each stage takes the documents that its predecessor kept and returns them with the columns of
``documents``; the last returns doc_id, n_tokens, the token ids and the digest of the text they decode to.

Defined results: null and empty texts fail the quality rules (no words), so none gets further; rows
without a doc_id are judged by the rules, have no near-duplicates and keep their passages; rows that
repeat a doc_id stay or go together, in each stage; of copies the one with the least doc_id stays; empty tables give no rows; other columns, whatever their names,
come out of all stages but the last as they went in. After mixing doc_ids repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specdrift.llm import bpe, mixing, near_dedup, quality_rules, substring_dedup
from specdrift.llm.io import discard, stored, table, tokenizer_path

#: What separates words.
BLANKS = " \t\n\x0b\x0c\r"


def _others(docs: DataFrame) -> Column:
    """All columns but the text as one, so that no operator's own columns can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def _shown(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; short texts and other languages need no stop words."""
    kept = quality_rules.apply_rules(docs.select(_others(docs), "text", "lang"), table=quality_rules.KEEPING).filter("kept")
    return kept.select(*_shown(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least doc_id. Rows without a doc_id stay."""
    classes = near_dedup.classes(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(classes, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that start in a document of smaller doc_id;
    documents of which nothing is left go. Texts that were without a word stay."""

    def finish(text: bytes | None, spans) -> tuple[str | None, int]:
        (rest,) = substring_dedup.cleaned(text, spans)
        return rest, int(len(spans) == 0 or bool((rest or "").strip(BLANKS)))

    cut = substring_dedup.find(docs.select(_others(docs), "doc_id", "text"), finish, "text string, stays int").filter("stays = 1")
    return cut.select(*_shown(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(_others(docs), "doc_id", "text", "source")).filter("copies > 0")
    again = mixed.select("row", "text", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*_shown(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of each text, and the SHA-256 of what they decode to."""
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), tokenizer_path(), decoded_sha256="decoded_sha256")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]
#: Near-duplicate classes and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
