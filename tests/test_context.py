"""Truncation, assembly, outlines and wrapping against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from specdrift.functions import text as T
from specdrift.operators import context as X
from specdrift.operators import outcome as O
from specdrift.operators import policy as P
from specdrift.operators import report as R
from specdrift.sources import read_baseline, read_cases, write_baseline

MARK = "\n… [elided]"


def _count(text):
    return sum(max(1, -(-len(t.encode()) // 4)) for t in re.findall(r"\w+|[^\s\w]", text))


def _cut(text, most):
    if most <= 0:
        return ""
    if _count(text) <= most:
        return text
    if _count(MARK) >= most:
        return ""
    n = max(i for i in range(len(text) + 1) if _count(text[:i]) <= most - _count(MARK))
    return text[:n].rstrip() + MARK


def _texts(seed, n=60):
    rng = random.Random(seed)
    parts = ["word", "a", "longerword", "é", "übergrößen", " ", "\n", "  ", ".", "(x)", "漢字漢字", "1234567890", "\t"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_truncation(spark):
    rows = [(i, t, m) for i, t in enumerate(_texts(1)) for m in (-1, 0, 5, 6, 7, 9, 12, 40)]
    got = spark.createDataFrame(rows, "i int, t string, m int").select("t", "m", T.truncate(F.col("t"), F.col("m")).alias("c")).collect()
    assert all(r["c"] == _cut(r["t"], r["m"]) for r in got)


def _wrapped(text, first, following, width, most):
    words, lines, prefix, i = text.split(), [], first, 0
    while i < len(words):
        rest = " ".join(words[i:])
        if len(prefix) + len(rest) <= most:
            return [*lines, prefix + rest]
        line, i = prefix + words[i], i + 1
        while i < len(words) and len(line) + 1 + len(words[i]) <= width:
            line, i = f"{line} {words[i]}", i + 1
        lines.append(line)
        prefix = following
    return lines or [first.rstrip()]


def test_wrapping(spark):
    rng = random.Random(2)
    texts = [" ".join("x" * rng.randint(1, 14) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.wrap_words(F.col("t"), "/** ", " * ", 20, 26).alias("w")).collect()
    assert all(r["w"] == _wrapped(r["t"], "/** ", " * ", 20, 26) for r in got)


def test_assembly(spark):
    rng = random.Random(3)
    owners = [(o, "SYMBOL: f#s\nSIGNATURE: " + "x " * rng.choice([1, 5, 60])) for o in range(20)]
    texts = [t for t in _texts(4, 200) if t.strip()]
    rows = [(o, rng.randrange(8), f"{i:03}", rng.choice(["ownBody", "gitSubject", "callSite"]), rng.choice(texts)) for o in range(19) for i in range(rng.randint(0, 8))]
    rows = [(*r, r[3] != "gitSubject") for r in rows]
    got = X.assemble(spark.createDataFrame(owners, "owner int, header string"), spark.createDataFrame(rows, "owner int, rank int, ord string, source string, text string, truncatable boolean"), 50)
    got = {r["owner"]: r for r in got.collect()}
    for o, header in owners:
        mine = sorted((r for r in rows if r[0] == o), key=lambda r: r[1:3])
        left, texts, taken, omitted, cut = 50 - _count(header), [header], [], [], False
        if left < 0:
            texts, omitted, cut = [_cut(header, 50)], [r[3] for r in mine], True
        else:
            for r in mine:
                if _count(r[4]) <= left:
                    left -= _count(r[4])
                    texts.append(r[4]), taken.append(r[3])
                elif r[5] and left >= 8 and _cut(r[4], left):
                    texts.append(_cut(r[4], left)), taken.append(r[3])
                    left, cut = 0, True
                else:
                    omitted.append(r[3])
        want = ("\n\n".join(texts), taken, omitted, cut)
        assert (got[o]["text"], got[o]["included"], got[o]["omitted"], got[o]["truncated"]) == want
        assert got[o]["tokens"] == _count(want[0]) <= 50


def test_outline(spark):
    rows = [
        ("a", 1, "Shape", "interface", None, "interface Shape", "size: number\ncolour: string"), ("a", 2, "size", "method-signature", "Shape", "size", ""),
        ("a", 3, "Big", "enum", None, "enum Big", "m " * 40), ("a", 4, "part", "method", "Big", "part()", ""), ("a", 5, "last", "class", None, "x " * 60, ""), ("a", 6, "never", "class", None, "never", ""),
        ("b", 1, "x", "class", None, "y " * 90, ""),
    ]
    symbols = spark.createDataFrame(rows, "file string, start int, name string, kind string, container string, signature string, body string")
    none = X.outline(symbols.filter("file = 'b'"), 30, 24).first()
    assert none["text"] == "" and none["tokens"] == 0
    got = {r["file"]: r for r in X.outline(symbols, 90, 24).collect()}
    assert "[elided]" in got["b"]["text"] and got["b"]["declared"] == []
    text = got["a"]["text"]
    assert text.startswith("MODULE: a\n") and "- interface Shape {\n    size: number\n    colour: string\n  }" in text and "- Shape.size" not in text
    assert "- enum Big" in text and "[elided]" in text and "- Big.part()" in text and "- never" not in text and got["a"]["declared"] == ["Shape"]


def test_baseline_files(spark, tmp_path):
    entry = {"symbolHash": "s", "doc_hash": "d", "startLine": 3}
    (tmp_path / "one.json").write_text(json.dumps({"schemaVersion": 2, "symbols": {"a.ts#f": entry, "b": {**entry, "filePath": "z", "project": "p"}}}, indent=2))
    got = {r["id"]: r for r in read_baseline(spark, f"file://{tmp_path}/one.json").collect()}
    assert (got["a.ts#f"]["file_path"], got["a.ts#f"]["start_line"], got["b"]["project"]) == ("a.ts", 3, "p")
    assert read_baseline(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "old.json").write_text('{"schemaVersion": 1, "symbols": {}}')
    with pytest.raises(ValueError, match="version 1"):
        read_baseline(spark, f"file://{tmp_path}/old.json")
    (tmp_path / "bad.json").write_text('{"schemaVersion": 2, "symbols": {"x": {"symbolHash": "s"}}}')
    with pytest.raises(ValueError, match="invalid"):
        read_baseline(spark, f"file://{tmp_path}/bad.json")
    write_baseline(read_baseline(spark, f"file://{tmp_path}/one.json"), f"file://{tmp_path}/kept")
    assert spark.read.parquet(f"file://{tmp_path}/kept").count() == 2
    (tmp_path / "cases.json").write_text('{"repo": "a"}\n{"repo": "a"}\n')
    assert read_cases(spark, f"file://{tmp_path}/cases.json", "repo string", 2).count() == 2
    with pytest.raises(ValueError):
        read_cases(spark, f"file://{tmp_path}/cases.json", "repo string", 2, "repo", 2)


def test_guards(spark):
    rows = spark.createDataFrame([("a", "missing", "src/a"), ("b", "missing", "lib/b")], "id string, status string, file_path string")
    assert [r["id"] for r in P.targets(rows, "missing", "src").collect()] == ["a"]
    P.guard_targets(rows, "missing", "src", 5)
    for given in ({"scope": None}, {"most": 1}, {"replaces": True, "judged": False}):
        with pytest.raises(ValueError):
            P.guard_targets(rows, "missing", **{"scope": "src", "most": 5, **given})
    with pytest.raises(ValueError):
        P.guard_targets(rows.limit(0), "drifted", "src", 5)


def test_sarif_stands_around_results():
    head = R.sarif_head()
    assert head["version"] == "2.1.0" and [r["id"] for r in head["runs"][0]["tool"]["driver"]["rules"]] == ["drifted", "missing", "orphaned"]


def test_globs_and_paths(spark):
    for glob, path, want in (("**/*.{test,spec}.ts", "a/b/c.test.ts", True), ("**/*.{test,spec}.ts", "c.spec.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/**", "src/a/b.ts", True), ("a?.ts", "ab.ts", True), ("a.ts", "axts", False)):
        assert bool(re.match(T.glob_pattern(glob), path)) is want
    row = spark.range(1).select(T.normalized_path(F.lit("a/./b/../../../c")).alias("a"), T.normalized_path(F.lit("/x/..")).alias("b"), T.posix_path(F.lit("")).alias("c")).first()
    assert tuple(row) == ("../c", "/", ".")


def test_waves_and_windows(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "p"), (4, "p"), (5, "q")], "id int, prefix string")
    assert {r["id"]: r["wave"] for r in X.request_waves(rows, ["id"]).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 6)], "file string, line int, content string")
    sites = spark.createDataFrame([("f", 1), ("f", 4)], "file string, line int")
    assert {r["line"]: r["text"] for r in X.source_window(lines, sites, 1).collect()} == {1: "l1\nl2", 4: "l3\nl4\nl5"}


def test_failure_classes_and_waits(spark):
    rows = spark.createDataFrame([("Sign in first", "login", True), ("quota exhausted", "quota", True), ("schema", "exit-code", False), ("credit", "exit-code", False), ("model m unavailable", "model", True)], "t string, c string, f boolean")
    assert all((r["x"]["class"], r["x"]["fatal"]) == (r["c"], r["f"]) for r in rows.withColumn("x", T.failure_class(F.col("t"))).collect())
    log = spark.createDataFrame([(1, 1, 200, False, 70_000), (2, 1, 200, True, 0), (3, 1, 200, None, None)], "run int, ord int, status int, fatal boolean, wait_ms int")
    assert {r["run"] for r in O.failfast(log).collect()} == {1, 2}
