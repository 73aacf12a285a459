"""The queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specdrift.llm import ann, bpe, collocations, decontaminate, language_id, lexical, mixing, near_dedup, quality_model, quality_rules, substring_dedup, suffix_dedup, token_counts
from specdrift.llm.io import remove, shared_dir, stored, table, tokenizer_path


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents' words as flat files of 16-bit ids, counts tokens from those alone, and says of
    which document each count is."""
    path, separator = shared_dir(spark, "tokens"), 65_535
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_counts.write_token_files(token_counts.word_tokens(docs, shards=shards), path, separator, order="key")
    counts = token_counts.count_tokens(spark, path, separator).withColumn("shard", F.regexp_extract("file", "/shard=([0-9]+)/", 1).cast("int"))
    result = stored(token_counts.keyed_counts(counts, token_counts.file_keys(docs, shards)), "counts")
    remove(spark, path)
    return result


OP1_SQL = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, true AS ended
FROM documents
"""


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(base, base.filter("vec_id % 20 = 0"), 20, "embedding", "vec_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_documents(docs, tokenizer_path())


def _fold(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    names, model = language_id.train(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(rows, names, model).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    rows = stored(quality_model.with_statistics(docs).select("doc_id", held_out.alias("held_out"), "x"), "op7")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).filter("y is not null")
    model = quality_model.fit(stored(rows.filter(~held_out).join(labels, "doc_id").select("x", "y"), "op7-train"))
    return quality_model.score_rows(rows, model)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ddl = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return suffix_dedup.find(docs, suffix_dedup.digest, ddl)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.find(docs, substring_dedup.digest, "n_words bigint, n_removed bigint, kept_sha256 string")


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, hash(array_to_string(words[i:i+12], ' ')) AS g
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 12)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
gone AS (
  SELECT doc_id, list_distinct(list(i + j)) AS gone_at
  FROM rep, (SELECT unnest(generate_series(0, 12)) AS j) GROUP BY doc_id),
k AS (
  SELECT w.doc_id, words, coalesce(gone_at, []) AS gone_at FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id),
word AS (
  SELECT doc_id, len(words) AS n, len(gone_at) AS r,
         list_filter(list_zip(words, generate_series(1, len(words))), lambda z: NOT list_contains(gone_at, z[2])) AS kept
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(kept, lambda z: z[1]), ' ')) AS kept_sha256
FROM word
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.digests(found))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
own AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM i, LATERAL (SELECT unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s) WHERE len(w) > 0),
met AS (
  SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g
  FROM d, (SELECT DISTINCT m FROM own) AS sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - m + 1)) AS s)),
hit AS (SELECT doc_id, s, m, g FROM met SEMI JOIN own USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN own USING (m, g)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.w, c.a, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score, i
  FROM c, LATERAL (SELECT unnest(generate_series(1, c.k - 1)) AS i)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_parts AS (
  SELECT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM c, (SELECT unnest([2, 3]) AS m), LATERAL (SELECT unnest(generate_series(1, c.k - m + 1)) AS i) WHERE m < c.k GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inner_parts AS o ON o.lang = low.lang AND o.phrase = low.phrase WHERE o.most IS NULL OR 100 * o.most < 80 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
t AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
m AS (
  SELECT item_id, doc_id,
         CAST(sum(many * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)
OP6_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 4)) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS n_shouted,
         len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         100.0 * word_chars / n_words / 100 < 2 OR 100.0 * word_chars / n_words / 100 > 14
         OR 100.0 * n_symbols / n_words > 30 OR 100.0 * n_shouted / n_words > 30
         OR 100.0 * n_stop / n_words < 2
         OR (CASE WHEN n_lines > 0 THEN 100.0 * n_dup_lines / n_lines ELSE 0 END) > 50) AS kept
FROM b
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ann": op2_ann,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_model": op7_quality_model,
    "op8_near_dedup": op8_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {"op1_token_counts": OP1_SQL, "op6_quality_rules": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_collocations": OP12_SQL, "op13_lexical_search": OP13_SQL}
