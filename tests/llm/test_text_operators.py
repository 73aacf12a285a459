"""BPE, language identification, quality rules, mixing, quality model, token counts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specdrift.llm import bpe, language_id, mixing, quality_model, quality_rules, token_counts
from specdrift.llm.io import shared_dir, tokenizer_path

DOCS = "doc_id bigint, text string, source string, size string, rate int"


def test_bpe_equals_tokenizers_library():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    ours, theirs = bpe.vocabulary(path), Tokenizer.from_file(path)
    random.seed(3)
    parts = ["a", "é", "  ", " ", "\n", "\t", "'s", "'ll", "23", "🙂", "the", "ing", "<|endoftext|>", "漢字", "!!", " ", "\r\n", "\x1c", "ttt", "‍", "A"]
    for _ in range(3000):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 20)))
        ids, decimals = ours.encode(s)
        want = theirs.encode(s, add_special_tokens=False).ids
        assert ids.tolist() == want and decimals == ",".join(map(str, want))
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_decodes_broken_utf8_like_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    ours, theirs = bpe.vocabulary(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    for _ in range(500):
        ids = rng.integers(0, 300, rng.integers(0, 12))
        assert ours.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_of_many_texts_equals_the_library_and_encodes_words_together(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    ours, theirs = bpe.Vocabulary(path), Tokenizer.from_file(path)
    random.seed(7)
    parts = ["er", "in", "on", "tion", "ä", "ß", "çê", "ing", "ou", "th", "qu", "zu", "x"]
    ends = [" ", " ", " ", " ", ", ", ".\n", "\n ", "  ", " \t", "'s ", "$$$ ", "7 ", " <|endoftext|> ", "\x1c ", "\u00a0", "漢🙂 "]
    words = ["".join(random.choices(parts, k=random.randint(1, 9))) for _ in range(20_000)] + ["q" * 70, "ab" * 50, "-" * 63, "-" * 64]
    texts = ["", " ", "\n", " a", "a ", "a\n", "\n a", "a  b", "-" * 500] + ["".join(random.choice(words) + random.choice(ends) for _ in range(40)) for _ in range(2000)]
    alone = []
    piece = bpe.Vocabulary.piece
    monkeypatch.setattr(bpe.Vocabulary, "piece", lambda self, data: alone.append(data) or piece(self, data))
    monkeypatch.setattr(bpe, "MEMORY", 3000)  # generations are forgotten on the way
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    got = [found for at in range(0, len(texts), 500) for found in ours.encode_all(texts[at : at + 500])]
    assert [ids.tolist() for ids, _ in got] == want
    assert [decimals for _, decimals in got] == [",".join(map(str, w)) for w in want]
    assert len(ours.memory.young) <= 3000 and len(ours.memory.old) <= 3000
    # by itself goes only what is long, and the last few of each batch
    assert sum(len(p) < bpe.LONG for p in alone) < 200
    # the same texts one by one, whatever the memory holds by now
    assert [ours.encode(t)[0].tolist() for t in texts[:200]] == want[:200]


def test_bpe_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two " * 3000, "x"), (3, "one two " * 3000, "x")], "doc_id bigint, text string, ids string")
    coded = bpe.encode_documents(docs, tokenizer_path())
    back = bpe.decode_documents(coded, tokenizer_path(), text="text").collect()
    assert [r["text"] for r in sorted(back, key=lambda r: r["doc_id"])] == ["", "", "one two " * 3000, "one two " * 3000]
    digests = {r["doc_id"]: r for r in bpe.digest_documents(docs, tokenizer_path()).collect()}
    assert digests[1]["n_tokens"] == 0 and digests[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_rules_measures_and_verdict(spark):
    good = "the cat and the dog went to a house in the town and it was good for them all"
    rows = [(1, None), (2, ""), (3, good), (4, "a b c d e f g h i j a b c d e"), (5, "x y\nx y\n\n \nx y"), (6, "#a $$b"), (7, good.upper()), (3, good)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[1]["base_failed"] and by[2]["n_words"] == 0
    assert by[3]["kept"] and not by[3]["base_failed"]
    assert by[4]["n_repeat_words"] == 10 and by[4]["base_failed"]
    assert by[5]["n_dup_lines"] == 2 and by[5]["n_words"] == 6
    assert by[6]["n_symbols"] == 3 and by[6]["word_chars"] == 5
    assert not by[7]["kept"] and not by[7]["base_failed"]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in quality_rules.apply_rules(frame).filter("kept").collect()} == {3}
    assert quality_rules.apply_rules(frame.limit(0)).count() == 0


def test_repeat_words_against_brute_force(spark):
    random.seed(5)
    texts = [" ".join(random.choice("abcd") for _ in range(random.randint(0, 60))) for _ in range(60)]
    got = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in got:
        w = texts[r["doc_id"]].split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        assert r["n_repeat_words"] == len(hit)


def _targets(sizes: dict, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        level = rest / sum(w[s] for s in names if s not in stopped)
        above = {s for s in names if s not in stopped and level * w[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else level * w[s] for s in names}
        stopped |= above


def test_mixing_targets_and_copies(spark):
    random.seed(2)
    rows = []
    for i in range(900):
        source = random.choice(["a", "b", "b", "b", "c", None, "é"]) if i else "tiny"
        rows.append((i, " ".join(["w"] * int(random.paretovariate(1.1) * 5)) if i % 50 else None, source, "clash", 7))
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = _targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 3 for r in mine)
        smallest = min(r["size"] for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want[s]) <= max(0.02 * want[s], smallest)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_language_id(spark):
    random.seed(4)
    words = {"en": "the and house river mountain with".split(), "de": "der und haus fluss berg nicht".split()}
    rows = [(i, " ".join(random.choices(words[lang], k=12)), lang, 9.0) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(900, None, None, 9.0), (901, "", "en", 9.0), (902, "123 !!", None, 9.0), (903, "und haus " * 200_000, None, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    names, logp = language_id.train(docs.filter("doc_id < 80 or doc_id = 901"))
    assert names == ["de", "en"]
    got = {r["doc_id"]: r for r in language_id.predict(docs, names, logp).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[80:120])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "de" and 0 <= got[903]["score"] <= 1
    none, empty = language_id.train(docs.limit(0))
    assert none == [] and {r["lang_pred"] for r in language_id.predict(docs.limit(3), none, empty).collect()} == {"und"}


def test_language_pieces_do_not_change_counts():
    text = "Ärger über Öl und the river " * 40
    whole = np.sort(np.concatenate(list(language_id._text_buckets(text, 1 << 18))))
    old, language_id.PIECE = language_id.PIECE, 37
    try:
        assert np.array_equal(whole, np.sort(np.concatenate(list(language_id._text_buckets(text, 1 << 18)))))
    finally:
        language_id.PIECE = old


def test_quality_model(spark):
    random.seed(6)
    good = lambda: " ".join(random.choices(["lamp", "river", "stone", "glass", "the", "of"], k=30)) + "."
    bad = lambda: " ".join(random.choices(["LAMP!!", "###", "$$$", "RIVER!!"], k=30))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    x = quality_model.with_statistics(docs)
    model = quality_model.fit(x.filter("doc_id < 200").select("x", "y"))
    got = quality_model.score_rows(x.filter("doc_id >= 200"), model).collect()
    assert np.mean([r["predicted"] == r["y"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = quality_model.with_statistics(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"))
    assert all(0 <= r["score"] <= 1 for r in quality_model.score_rows(odd, model).collect())
    assert quality_model.score_rows(odd, quality_model.fit(x.select("x", "y").limit(0))).first()["score"] == 0.5


def test_isotonic_never_decreases():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 5, quality_model.BINS).astype(float)
    edges, values = quality_model.isotonic(n, np.minimum(n, rng.integers(0, 5, quality_model.BINS)))
    assert (np.diff(values) >= 0).all() and (np.diff(edges) >= 0).all()


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_token_counts_stitch_blocks(spark, block):
    random.seed(block)
    sizes = [0, 5, 0, 0, 12, 1, 30, 2, 0]
    body = b"".join(bytes([7, 1]) * n + b"\xff\xff" for n in sizes)
    files = spark.createDataFrame([("a", body), ("b", body + bytes([7, 1]) * 9), ("c", b"\xff\xff"), ("d", bytes([1, 1]) * 5)], "file string, content binary")
    got = token_counts.documents(token_counts.blocks(files, 65_535, 2, block)).collect()
    of = lambda f: [(r["n_tokens"], r["ended"]) for r in sorted((r for r in got if r["file"] == f), key=lambda r: r["document"])]
    whole = [(n, True) for n in sizes]
    assert of("a") == whole and of("b") == [*whole, (9, False)] and of("c") == [(0, True)] and of("d") == [(5, False)]


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(None,), ("",), ("a b c",), ("x " * 5000,)], "text string")
    path = shared_dir(spark, "tokens")
    token_counts.write_token_files(token_counts.word_tokens(docs), path, 65_535)
    got = token_counts.count_tokens(spark, path, 65_535, block=64).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 3, 5000] and all(r["ended"] for r in got)
    # the blocks of one file are read by several tasks
    one = spark.createDataFrame([("x " * 5000,)] * 3, "text string").coalesce(1)
    path = shared_dir(spark, "tokens")
    token_counts.write_token_files(token_counts.word_tokens(one), path, 65_535)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    scanned = token_counts.scan_ranges(files.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///")), 65_535, block=64, tasks=4)
    assert files.count() == 1 and scanned.select(F.spark_partition_id()).distinct().count() == 4
    assert [r["n_tokens"] for r in token_counts.documents(scanned).collect()] == [5000] * 3
    assert token_counts.count_tokens(spark, path, 65_535, block=1).count() == 3


@pytest.mark.parametrize("ids", [["b", "B", "ä", "10", "9", None, "", "b"], [3, None, 2, 2, None, 7, 8, 9]])
def test_counts_find_their_documents_whatever_the_session_says(spark, ids):
    kind = "string" if isinstance(ids[0], str) else "bigint"
    rows = [(x if i < len(ids) else f"id{i}" if kind == "string" else 100 + i, "w " * (i % 11) if i % 13 else None) for i, x in enumerate(ids * 1 + [0] * 120)]
    docs = spark.createDataFrame(rows, f"`doc id` {kind}, text string").repartition(3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        path = shared_dir(spark, "tokens")
        token_counts.write_token_files(token_counts.word_tokens(docs, shards=3, doc_id="doc id"), path, 65_535, order="key")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    counts = token_counts.count_tokens(spark, path, 65_535).withColumn("shard", F.regexp_extract("file", "/shard=([0-9]+)/", 1).cast("int"))
    keys = token_counts.file_keys(docs, 3, doc_id="doc id")
    got = sorted(((r[0], r[1]) for r in token_counts.keyed_counts(counts, keys).collect()), key=str)
    assert got == sorted(((i, len((t or "").split())) for i, t in rows), key=str)
    with pytest.raises(Exception, match="do not match"):
        token_counts.keyed_counts(counts, keys.filter("document > 0")).collect()


def test_mixing_solves_the_entropy_problem(spark):
    """Rates against the optimality conditions, multipliers against bisection in numpy."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), "abc"[i % 3] if i % 7 else None) for i, n in enumerate(np.maximum(1, rng.lognormal(3, 1, 400)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).toPandas()
    for _, mine in got.groupby(got["source"].fillna("?")):
        size, rate, target = mine["size"].to_numpy(float), mine["rate"].to_numpy(), mine["target"].iloc[0]
        assert (size * rate).sum() == pytest.approx(target, rel=1e-8)
        lo, hi = -5.0, 5.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (size * np.exp(np.minimum(mid * size, np.log(3)))).sum() < target else (lo, mid)
        assert np.allclose(rate, np.exp(np.minimum(lo * size, np.log(3))), rtol=1e-5)
        assert abs((mine["copies"] * size).sum() - target) <= 0.02 * target
        assert ((mine["copies"] >= np.floor(rate)) & (mine["copies"] <= np.ceil(rate))).all()


def test_mixing_keeps_user_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "k"), (1, "a b", "s", "k"), (None, None, None, None)], "doc_id bigint, text string, source string, __size string")
    got = mixing.mix(docs)
    assert got.columns[:4] == docs.columns and sorted(str(r["__size"]) for r in got.collect()) == ["None", "k", "k"]
