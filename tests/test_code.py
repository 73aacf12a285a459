"""Edits, differences, scans, comments, notes, positions, rendering, answers: against plain Python."""

import json
import random
import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from specdrift.functions import answers as A
from specdrift.functions import comments as D
from specdrift.functions import text as T
from specdrift.operators import classify as C
from specdrift.operators import edits as E
from specdrift.operators import intervals as I
from specdrift.operators import source as S
from specdrift.operators import walks as W
from specdrift.sources.scan import scan

# ------------------------------------------------------------------ intervals


def test_intervals_touch_as_in_brute_force(spark):
    r = random.Random(1)
    spans = lambda n, most: [(r.choice("abc"), s := r.randrange(300), s + r.choice([0, 1, 2, 7, 60, most]) - 1) for _ in range(n)]
    left, right = spans(150, 90), spans(12, 40)
    got = I.touching(*(spark.createDataFrame([*x, (None, 1, 2), ("a", None, 3)], "path string, start bigint, end bigint") for x in (left, right)))
    want = {a for a in left if a[1] <= a[2] and any(a[0] == b[0] and b[1] <= b[2] and a[1] <= b[2] and a[2] >= b[1] for b in right)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_hunks_of_one_file(spark):
    hunks = spark.range(100_000).select(F.lit("f").alias("path"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 2).alias("end"))
    rows = spark.range(100_000).select(
        F.lit("f").alias("file_path"), (F.col("id") * 10 + F.col("id") % 8).alias("start_line"), (F.col("id") * 10 + F.col("id") % 8).alias("end_line"), F.lit("drifted").alias("status"), "id",
    )
    odd = spark.createDataFrame([("f", 3, None, "drifted", -1), ("g", 3, None, "drifted", -2), ("f", 5, 5, "orphaned", -3), ("g", 5, 5, "orphaned", -4), ("f", 3, 8, "missing", -5)], rows.schema)
    began = time.time()
    got = {x.id for x in C.changed_since(rows.union(odd), hunks).select("id").collect()}
    assert got == {i for i in range(100_000) if i % 8 <= 2} | {-1, -3} and time.time() - began < 60


# ------------------------------------------------------------------ edits and differences


def test_splice(spark):
    r = random.Random(2)
    files, edits, want = [], [], {}
    for i in range(40):
        text = "".join(r.choice("aé日\n\r b") for _ in range(r.randrange(60)))
        at, mine = 0, []
        while at < len(text) + 3:
            start = at + r.randrange(1, 9)
            end = start + r.choice([0, 0, 1, 4])
            mine.append([i, len(mine), start, end, r.choice(["", "X\r\n", "日本", None])])
            at = end if r.random() > 0.15 else start - 2  # sometimes the next one overlaps
        hit = lambda a, b: a is not b and (a[2] == b[2] or (a[2] < b[3] and b[2] < a[3]))
        state = [E.OVERLAP if any(hit(a, b) for b in mine) else E.RANGE if a[3] > len(text) or a[2] < 0 else None for a in mine]
        after = text
        for a in sorted((a for a, s in zip(mine, state, strict=True) if s is None), key=lambda a: -a[2]):
            after = after[: a[2]] + (a[4] or "") + after[a[3] :]
        want[i] = (after, {a[1] for a, s in zip(mine, state, strict=True) if s is None}, {(a[1], s) for a, s in zip(mine, state, strict=True) if s})
        files.append((i, text))
        edits += mine
    files += [(100, None), (101, "no edit")]
    edits += [(100, 1, 0, 0, "x"), (999, 2, 0, 0, "x")]
    want |= {100: (None, set(), {(1, E.NO_FILE)}), 101: ("no edit", set(), set()), 999: (None, set(), {(2, E.NO_FILE)})}
    got = E.splice(spark.createDataFrame(files, "file int, text string"), spark.createDataFrame(edits, "file int, symbol int, start int, end int, text string")).collect()
    assert {x.file: (x.after, set(x.applied), {tuple(f) for f in x.failed}) for x in got} == want


def diff(path, before, after):
    if before == after:
        return ""
    old, new = (re.sub(r"\n\Z", "", t.replace("\r\n", "\n")).split("\n") for t in (before, after))
    head = next((i for i, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
    most = min(len(old), len(new)) - head
    tail = next((i for i in range(most) if old[-1 - i] != new[-1 - i]), most)
    a, b, c = max(0, head - 3), min(len(old), len(old) - tail + 3), min(len(new), len(new) - tail + 3)
    body = [" " + x for x in old[a:head]] + ["-" + x for x in old[head : len(old) - tail]] + ["+" + x for x in new[head : len(new) - tail]] + [" " + x for x in old[len(old) - tail : b]]
    return "\n".join([f"--- a/{path}", f"+++ b/{path}", f"@@ -{a + 1},{b - a} +{a + 1},{c - a} @@", *body])


def test_differences(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("ab") + r.choice(["\n", "\n", "\r\n"]) for _ in range(n))
    rows = [("", ""), ("", "a"), ("a", ""), ("a\n", "a"), ("a\r\nb", "a\nb"), ("x\n" * 20, "x\n" * 19), ("a\n\n", "a\n")]
    for _ in range(120):
        t = text(r.randrange(14))
        i = r.randrange(len(t) + 1)
        rows.append((t, t[:i] + text(r.randrange(3)) + t[i + r.randrange(5) :]))
    frame = spark.createDataFrame([(b, a) for b, a in rows], "b string, a string")
    for x in frame.select("b", "a", E.unified_diff(F.lit("p/q"), F.col("b"), F.col("a")).alias("d")).collect():
        assert x.d == diff("p/q", x.b, x.a)


# ------------------------------------------------------------------ sources


def test_scan(spark, tmp_path):
    files = {"src/a.ts": "a\nb", "src/a b+c.ts": "plus", "src/a.d.ts": "no", "src/deep/x.tsx": "x", "dist/a.ts": "no", "src/build/b.ts": "no", "node_modules/m/i.js": "no", "out/o.ts": "no", "src/read.md": "no", "test/t.ts": "t", "packages/sub/s.ts": "s"}
    for name, body in files.items():
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(body)
    root = f"file://{tmp_path}/root"
    rows = lambda **kw: {(x.project, x.path, x.text) for x in scan(spark, {"p": root}, **kw).collect()}
    every = {("p", n, b) for n, b in files.items() if b != "no"}
    assert rows(out_dir="out") == every
    assert rows() == every | {("p", "out/o.ts", "no")}
    assert rows(include=["src/**"], exclude=["**/*.tsx"]) == {("p", "src/a.ts", "a\nb"), ("p", "src/a b+c.ts", "plus")}
    both = scan(spark, {"p": root, "sub": f"{root}/packages/sub"}, include=["packages/**", "*.ts"])
    whole = both.select(F.when(F.col("project") == "sub", F.concat(F.lit("packages/sub/"), "path")).otherwise(F.col("path")).alias("file"), "project")
    assert [tuple(x) for x in C.ownership_conflicts(whole).collect()] == [("packages/sub/s.ts", 2)]


def test_comments(spark):
    source = "/** old\n * @param x no */ f;\n/*** banner */ /**/\n  /** Adds.\r\n   *\r\n   *   Much.\r\n   * @param {number=} [a.b=1] first\r\n   * goes on\r\n   * @returns  both\r\n   * @weird-tag x@y.z\r\n   */\nfunction"
    frame = spark.createDataFrame([(source,), ("// none",), (None,), ("/** one */",), ("/** @internal */",)], "s string")
    got = [x.c for x in frame.select(D.doc_comment(F.col("s")).alias("c")).collect()]
    assert got[0].description == "Adds.\n\n  Much." and got[0].raw.startswith("/** Adds.") and got[0].raw.endswith("*/")
    assert [(t.name, t.text, t.parameter, t.known) for t in got[0].tags] == [("param", "first\ngoes on", "a.b", True), ("returns", "both", None, True), ("weird-tag", "x@y.z", None, False)]
    assert got[1] is None and got[2] is None and (got[3].description, got[3].tags) == ("one", [])
    assert got[4].description == "" and [(t.name, t.text) for t in got[4].tags] == [("internal", "")]


def test_notes(spark):
    notes = ["// a\n//b", "/// ref\n// eslint-disable", "// Copyright X\n  // @ts-ignore", "// All rights reserved", "//  two  ", None]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, n string")
    got = [x.n for x in frame.select("i", D.note(F.col("n")).alias("n")).orderBy("i").collect()]
    assert [n and n.blocked_by for n in got] == [None, "triple-slash", "directive", "license", None, None]
    assert [n and (n.text, n.eligible) for n in got[:1] + got[4:]] == [("a\nb", True), ("two", True), None]
    lines = spark.createDataFrame([("f", 1, "x"), ("f", 2, " // one"), ("f", 3, "// two"), ("f", 4, "fn"), ("f", 5, "fn2")], "file string, line bigint, content string")
    anchors = spark.createDataFrame([("f", 4), ("f", 5)], "file string, anchor bigint")
    assert [tuple(x) for x in S.source_notes(lines, anchors).collect()] == [("f", 4, 2, " // one\n// two", "one\ntwo", True, None)]


def test_exports_go_down_any_depth(spark):
    r = random.Random(5)
    rows = [(i, None if i % 50 == 0 else i - 1 - r.randrange(min(3, i % 50)), r.random() > 0.2, r.choice(["public"] * 30 + ["private"])) for i in range(400)]
    rows += [(1000, 1001, True, "public"), (1001, 1000, True, "public"), (1002, 5000, True, "public"), (1003, None, None, None)] + [(2000 + i, 1999 + i if i else None, True, "public") for i in range(300)]
    want = {}
    for i, parent, exported, visibility in rows:
        own = bool(exported) if parent is None else visibility == "public"
        want[i] = own and (parent is None or want.get(parent, False))
    got = S.exported_members(spark.createDataFrame(rows, "symbol int, container int, exported boolean, visibility string"))
    assert {x.symbol: x.exported for x in got.collect()} == want
    assert W.inherited(spark.createDataFrame([], "node int, parent int, own boolean")).count() == 0


def test_offsets(spark):
    texts = ["", "\n", "a\nbc\n\nd", "é日\n" * 30, "no end"]
    frame = spark.createDataFrame([(t, o) for t in texts for o in range(-2, len(t) + 3)], "t string, o int")
    for x in frame.select("t", "o", D.line_at(D.line_starts(F.col("t")), F.col("o")).alias("line")).collect():
        assert x.line == x.t[: max(x.o, 0)].count("\n")


# ------------------------------------------------------------------ rendering


def wrapped(text, first, following, width, most):
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


def body(text, width, most):
    out, fenced = [], False
    for line in text.replace("*/", "*\\/").split("\n"):
        fence = bool(re.match(r"\s*```", line))
        if fence or fenced or line == "" or line[0].isspace():
            out.append(" *" + (f" {line}" if line else ""))
            fenced ^= fence
        else:
            marker = m.group() if (m := re.match(r"(?:[-*+]|\d+[.)])\s+", line)) else ""
            out += wrapped(line[len(marker) :], f" * {marker}", " * " + " " * len(marker), width, most)
    return out


def test_rendering(spark):
    r = random.Random(6)
    line = lambda: r.choice(["", "```", "  code  here", "- item ", "12) item ", ""]) + " ".join(r.choice(["a", "wor*/d", "longer-word", "é"]) for _ in range(r.randrange(25)))
    rows = [("\n".join(line() for _ in range(r.randrange(1, 6))), line().strip() if r.random() > 0.4 else None, line(), r.choice([None, "the sum"])) for _ in range(60)]
    frame = spark.createDataFrame(rows, "s string, d string, p string, r string")
    doc = D.rendered(
        F.col("s"), F.col("d"), F.array(F.struct(F.lit("x").alias("name"), F.col("p").alias("text"))), F.col("r"), F.array(F.struct(F.lit("E").alias("type"), F.col("p").alias("when"))),
        F.array(F.struct(F.lit(" * @odd a */ b \n   *  more").alias("raw"))), width=44, most=52, indent="  ", eol="\r\n",
    )
    for x in frame.select("*", doc.alias("doc")).collect():
        lines = ["/**", *body(x.s, 42, 50)]
        lines += [] if x.d is None else [" *", *body(x.d, 42, 50)]
        for head, text in ((" * @param x", x.p), (" * @returns", x.r), (" * @throws E", x.p)):
            lines += [] if text is None else wrapped(text.replace("*/", "*\\/"), head + " ", " *   ", 42, 50)
        assert x.doc == "\r\n  ".join([*lines, " * @odd a */ b", " *  more", " */"])


def test_folds_are_linear(spark):
    text = textwrap.fill("word " * 100_000, 80)
    frame = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    (x,) = frame.select(T.wrap_words(F.col("t"), "/** ", " * ", 80, 100).alias("w"), T.truncate(F.col("t"), F.lit(60_000)).alias("c"), F.size(D.line_starts(F.col("t"))).alias("n")).collect()
    assert x.w == wrapped(text, "/** ", " * ", 80, 100) and x.n == text.count("\n") + 1
    assert x.c.count("word") == 60_000 - 5 and time.time() - began < 40


# ------------------------------------------------------------------ answers and schemas


def answer(v, depth=0):
    if depth > 6 or not isinstance(v, (dict, list)):
        return json.loads(v[v.index("{") : v.rindex("}") + 1]) if isinstance(v, str) and "{" in v else None
    if isinstance(v, dict):
        if isinstance(v.get("id"), str) and isinstance(v.get("verdict"), str):
            return v
        v = [v.get(f) for f in A.TEXT_FIELDS] + [v[k] for k in sorted(v)]
    return next((found for x in v if (found := answer(x, depth + 1)) is not None), None)


def test_answers(spark):
    r = random.Random(7)

    def value(depth):
        kind = r.randrange(7 if depth < 9 else 3)
        if kind < 2:
            return r.choice([1, None, "text", True])
        if kind == 2:
            return r.choice(['so {"q": 1} it', "plain"])
        if kind == 3:
            return {"id": r.choice(["i", 5]), "verdict": "OK"}
        if kind == 4:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return {r.choice(["zeta", "alpha", "message", "result", "content"]): value(depth + 1) for _ in range(r.randrange(4))}

    rows = [(i, json.dumps({"b": value(1), "text": value(1)})) for i in range(250)]
    got = {x.k: x.answer and json.loads(x.answer) for x in A.salvaged(spark.createDataFrame(rows, "k int, o string"), "k", "o").collect()}
    assert got == {k: answer(json.loads(o)) for k, o in rows}
    lines = [(1, 'x\n{"id":"a","verdict":"OK"}\n{"id":"b","verdict":"OK"}\nend'), (2, '{"n":1}\n{"m":[]}'), (3, None), (4, ""), (5, '[{"id":"a","verdict":"OK"}]')]
    got = {x.k: x.answer for x in A.salvaged(spark.createDataFrame(lines, "k int, o string"), "k", "o").collect()}
    assert got == {1: '{"id":"b","verdict":"OK"}', 2: None, 3: None, 4: None, 5: None}


def portable(v):
    if isinstance(v, list):
        return [portable(x) for x in v]
    return {k: portable(v[k]) for k in sorted(v) if k not in A.OMITTED} if isinstance(v, dict) else v


@pytest.mark.parametrize("empty", [False, True])
def test_schemas(spark, empty):
    rows = [
        (1, {"$schema": "x", "type": "object", "properties": {"a": {"minLength": 1, "e": {}}, "minLength": {"y": 1}, 'q"u,o\n': [1, {"propertyNames": 1, "z": None}, [], [[2]]]}}),
        (2, []), (3, "x"), (4, {"deep": {"deep": {"deep": {"deep": [{"minLength": {"a": 1}, "ok": True}]}}}}), (5, [*range(12)]),
    ]
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [(6, "{bad"), (7, None)], "k int, s string").filter(F.lit(not empty))
    got = {x.k: x.schema and json.loads(x.schema) for x in A.portable_schemas(frame, "k", "s").collect()}
    assert got == ({} if empty else {k: portable(v) for k, v in rows} | {6: None, 7: None})
