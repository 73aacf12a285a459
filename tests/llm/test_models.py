"""Language identification and the quality model: independent versions, registered queries, hostile texts."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specdrift.llm import language_id, quality_model
from specdrift.llm.queries import op4_language_id, op7_quality_model

SF = "/root/testdata/sf0.01"


def _fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def _grams(text):
    """n-grams of one to three folded characters, those of blanks alone left out, without hashing."""
    body = "".join(c.lower() if len(c.lower()) == 1 else c for c in (x if x.isalpha() else " " for x in text))
    return [body[i : i + n] for n in (1, 2, 3) for i in range(len(body) - n + 1) if body[i : i + n].strip(" ")]


def test_language_query_against_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = op4_language_id(spark, SF).toPandas().set_index("doc_id")
    assert list(got.columns) == ["held_out", "lang_pred", "score"] and len(got) == len(docs)
    counts: dict = {}
    for i, t, lang in zip(docs["doc_id"], docs["text"], docs["lang"], strict=True):
        if _fold(i, 4) != 2 and t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(_grams(t))
    names = sorted(counts)
    size = language_id.BUCKETS
    logs = {n: (counts[n], np.log(sum(counts[n].values()) + 0.5 * size)) for n in names}
    same = right = held = 0
    for i, t, lang in zip(docs["doc_id"], docs["text"], docs["lang"], strict=True):
        grams = Counter(_grams(t or ""))
        score = {n: sum(k * (np.log(c[g] + 0.5) - total) for g, k in grams.items()) for n, (c, total) in logs.items()}
        want = max(names, key=lambda n: score[n]) if grams else "und"
        same += got.loc[i, "lang_pred"] == want
        assert got.loc[i, "held_out"] == (_fold(i, 4) == 2) and 0 <= got.loc[i, "score"] <= 1
        if _fold(i, 4) == 2 and lang is not None and grams:
            held += 1
            right += got.loc[i, "lang_pred"] == lang
    assert same >= 0.995 * len(docs) and right >= 0.98 * held > 0


def test_groups_of_languages_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, logp = language_id.train(docs)
    whole = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, names, logp).collect()}
    monkeypatch.setattr(language_id, "GROUP", 1)
    assert whole == {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, names, logp).collect()}


def test_language_passes_other_columns_through(spark):
    docs = spark.sql("SELECT 1 AS a, timestamp'2024-01-02 03:04:05.123456' AS lang_pred, 'der Fluss' AS text, CAST(NULL AS INT) AS n, timestamp'2024-01-02 03:04:05.123456' AS at")
    row = language_id.predict(docs, ["de", "en"], np.log(np.full((2, 1 << 18), 1e-6, np.float32))).first()
    assert row["at"].microsecond == 123456 and row["n"] is None and row["lang_pred"] == "de" and row["score"] == pytest.approx(0.5)


def test_quality_query(spark):
    got = op7_quality_model(spark, SF).toPandas().set_index("doc_id")
    assert list(got.columns) == ["held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().dropna(subset=["quality"])
    assert all(h == (_fold(i, 3) == 1) for i, h in got["held_out"].items())
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    test = [(got.loc[i, "score"], q) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if _fold(i, 3) == 1]
    good, bad = ([s for s, q in test if q == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.95


def test_ridge_against_plain_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    model = quality_model.fit(spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int"))
    z = np.cos(np.clip((x - x.mean(0)) / x.std(0), -6, 6) @ model.weights + model.shift) * np.sqrt(2 / len(model.shift))
    z = np.concatenate((z, np.ones((300, 1))), axis=1)
    want = np.linalg.solve(z.T @ z / 300 + quality_model.RIDGE / 10 * np.eye(z.shape[1]), z.T @ y / 300)
    assert np.allclose(model.raw(x), z @ want, atol=1e-6)
    # isotonic: no monotone function of the bins fits better, by pooling from every start
    n, ones = rng.integers(0, 5, quality_model.BINS).astype(float), np.zeros(quality_model.BINS)
    ones = np.minimum(n, rng.integers(0, 5, quality_model.BINS))
    edges, values = quality_model.isotonic(n, ones)
    some = np.flatnonzero(n)
    mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()
    for i in some[::97]:
        want = max(min(mean(a, b) for b in some if b >= i) for a in some if a <= i)
        assert np.interp((i + 0.5) * 2 / quality_model.BINS - 0.5, edges, values) == pytest.approx(want)


def test_statistics_of_long_words_take_linear_time(spark):
    docs = spark.range(1).select(F.repeat(F.lit("aab"), 700_000).alias("text"))
    began = time.time()
    assert len(quality_model.with_statistics(docs).first()["x"]) == 11
    assert time.time() - began < 5
    row = quality_model.with_statistics(spark.createDataFrame([("the the cat cat the mat at",)], "text string")).first()["x"]
    assert row[6] == pytest.approx(2 / 8)


def test_many_languages_a_few_at_a_time(spark, monkeypatch):
    """Fifty languages, seven in memory at once, as all at once; the driver reads one group's counts at a time."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * i + j, f"{letters[i % 26]}{letters[i // 26]}{letters[i % 26]}{letters[j]} " * 20, f"l{i:02}") for i in range(50) for j in range(3)]
    docs = spark.createDataFrame([*rows, (9000, None, "l00"), (9001, "123", "l01")], "doc_id bigint, text string, lang string").repartition(3)
    names, model = language_id.train(docs)
    assert names == [f"l{i:02}" for i in range(50)]
    shown = lambda: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, names, model).collect())
    whole = shown()
    asked, real = [], language_id.log_probabilities
    monkeypatch.setattr(language_id, "GROUP", 7)
    monkeypatch.setattr(language_id, "log_probabilities", lambda m, n, size: asked.append(len(n)) or real(m, n, size))
    assert shown() == whole and max(asked) == 7 and sum(asked) == 50
    assert np.mean([p == f"l{i // 100:02}" for i, p, _ in whole if i < 9000]) > 0.9 and whole[-2:] == [(9000, "und", 0.0), (9001, "und", 0.0)]
