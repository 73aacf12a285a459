"""Column functions that read comments and line positions in source texts, and write documentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specdrift.functions.text import let, wrap_words

#: Tags that documentation is made of; all others are foreign to it.
KNOWN_TAGS = ("deprecated", "example", "internal", "param", "returns", "return", "see", "throws", "typeParam")
#: Fixed patterns: notes that are orders to a tool, and notes of ownership.
DIRECTIVE = r"(?i)(?:@ts-|eslint|prettier|biome|istanbul|c8\s+ignore|v8\s+ignore|coverage\s+ignore)"
LICENSE = r"(?i)(?:copyright|spdx-license-identifier|@license|licensed under|all rights reserved)"
#: Tags whose first word is a parameter's name.
PARAMETER_TAGS = ("param", "arg", "argument")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# ------------------------------------------------------------------ reading


def doc_comment(source: Column) -> Column:
    """struct<description, tags array<struct<name, text, parameter, raw, known>>, raw> of the last block comment in a text that
    starts with two stars; null if there is none. Lines lose their leading star; a line that starts with a tag's name begins a tag,
    which lasts until the next; what comes before the first is the description."""
    raw = F.try_element_at(F.regexp_extract_all(source, F.lit(r"/\*\*(?![*/])[\s\S]*?\*/"), F.lit(0)), F.lit(-1))

    def parsed(block: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(block, r"^/\*\*[ \t]?", ""), r"[ \t]*\*/$", "")
        lines = F.transform(F.split(inner, r"\r?\n", -1), lambda line, i: F.when(i == 0, line).otherwise(F.regexp_replace(line, r"^[ \t]*\*? ?", "")))
        parts = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), r"\n(?=[ \t]*@[A-Za-z])", -1)
        return let(parts, lambda p: F.struct(
            trimmed(F.element_at(p, 1)).alias("description"), F.transform(F.slice(p, 2, F.size(p)), doc_tag).alias("tags"), block.alias("raw"),
        ))

    return F.when(raw.isNotNull(), let(raw, parsed))


def doc_tag(part: Column) -> Column:
    """struct<name, text, parameter, raw, known> of a tag with what follows it."""
    name = F.regexp_extract(part, r"^\s*@([A-Za-z][\w-]*)", 1)
    rest = F.regexp_replace(part, r"^\s*@[A-Za-z][\w-]*[ \t]*", "")
    named = name.isin(*PARAMETER_TAGS)
    head = r"^\s*(?:\{[^}]*\}\s*)?\[?([\w$.]+)(?:\s*=[^\]]*)?\]?"
    return F.struct(
        name.alias("name"), trimmed(F.when(named, F.regexp_replace(rest, head, "")).otherwise(rest)).alias("text"),
        F.when(named, F.regexp_extract(rest, head, 1)).alias("parameter"), trimmed(part).alias("raw"), name.isin(*KNOWN_TAGS).alias("known"),
    )


def note(raw: Column) -> Column:
    """struct<text, eligible, blocked_by> of line comments that stand together: their words, and whether documentation may take
    their place. A reference (three slashes), an order to a tool, a licence, in this order and anywhere among them, forbid it."""
    lines = F.transform(F.filter(F.split(raw, r"\r?\n", -1), lambda x: x != ""), lambda x: F.regexp_replace(x, r"^\s+", ""))

    def judged(x: Column) -> Column:
        blocked = (
            F.when(F.exists(x, lambda line: F.startswith(line, F.lit("///"))), "triple-slash")
            .when(F.exists(x, lambda line: line.rlike(DIRECTIVE)), "directive")
            .when(F.exists(x, lambda line: line.rlike(LICENSE)), "license")
        )
        text = trimmed(F.array_join(F.transform(x, lambda line: F.regexp_replace(line, r"^///?\s?", "")), "\n"))
        return F.struct(text.alias("text"), blocked.isNull().alias("eligible"), blocked.alias("blocked_by"))

    return F.when(raw.isNotNull(), let(lines, judged))


# ------------------------------------------------------------------ positions


def line_starts(text: Column) -> Column:
    """array<bigint>: the offset, in characters, at which each line starts."""
    ends = F.filter(F.transform(F.split(text, "", -1), lambda c, i: F.when(c == "\n", i + 1)), lambda x: x.isNotNull())
    return F.concat(F.array(F.lit(0).cast("bigint")), F.transform(ends, lambda x: x.cast("bigint")))


def line_at(starts: Column, offset: Column) -> Column:
    """Which line, from 0, holds an offset: the last that starts at it or before, by halving. Offsets before the first line belong to
    the first, those past the end to the last."""
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    further = lambda at, step: (at + step < F.size(starts)) & (F.try_element_at(starts, at + step + 1) <= offset)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


# ------------------------------------------------------------------ writing


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("*/"), F.lit("*\\/"))


def _body(text: Column, width: int, most: int) -> Column:
    """Lines of free text: code (fenced or indented) and empty lines as they are, list items wrapped under their marker."""
    lines = F.split(_safe(text), r"\r?\n", -1)
    fence = lambda line: line.rlike(r"^\s*```")
    begin = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<line:string,code:boolean>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        code = acc["open"] | fence(line) | (line == "") | line.rlike(r"^\s")
        return F.struct((acc["open"] != fence(line)).alias("open"), F.concat(acc["out"], F.array(F.struct(line.alias("line"), code.alias("code")))).alias("out"))

    def shown(x: Column) -> Column:
        marker = F.regexp_extract(x["line"], r"^(?:[-*+]|\d+[.)])\s+", 0)
        plain = F.array(F.when(x["line"] == "", " *").otherwise(F.concat(F.lit(" * "), x["line"])))
        indent = F.repeat(F.lit(" "), F.length(marker))
        rest = F.substring(x["line"], F.length(marker) + 1, F.length(x["line"]))
        return F.when(x["code"], plain).otherwise(wrap_words(rest, F.concat(F.lit(" * "), marker), F.concat(F.lit(" * "), indent), width, most))

    return F.flatten(F.transform(F.aggregate(lines, begin, step)["out"], shown))


def _tag(head: Column, text: Column, width: int, most: int) -> Column:
    return wrap_words(_safe(text), F.concat(head, F.lit(" ")), F.lit(" *   "), width, most)


def rendered(
    summary: Column, detail: Column, params: Column, returns: Column, throws: Column, tags: Column,
    width: int = 100, most: int = 120, indent: str = "", eol: str = "\n",
) -> Column:
    """A documentation comment: summary, detail, then a tag for each of params (array<struct<name,text>>), returns, throws
    (array<struct<type,when>>), and last the tags (array<struct<raw>>) that are kept as they are.

    Sections are one array of lines in order. Text is wrapped at ``width`` characters, indentation included (a paragraph's end may run
    to ``most``); an end of comment in it is escaped. A null section is left out; a null summary is an empty line.
    """
    width, most = width - len(indent), max(width, most) - len(indent)
    none = F.array().cast("array<string>")
    tag_lines = lambda raw: F.transform(F.split(raw, r"\r?\n", -1), lambda line: F.rtrim(F.concat(F.lit(" * "), F.regexp_replace(F.regexp_replace(line, r"^\s*/\*\*?\s?", ""), r"^\s*\*/?\s?", ""))))
    each = lambda items, body: F.when(items.isNull(), none).otherwise(F.flatten(F.transform(items, body)))
    lines = F.concat(
        F.array(F.lit("/**")), _body(summary, width, most),
        F.when(detail.isNull(), none).otherwise(F.concat(F.array(F.lit(" *")), _body(detail, width, most))),
        each(params, lambda p: _tag(F.concat(F.lit(" * @param "), p["name"]), p["text"], width, most)),
        F.when(returns.isNull(), none).otherwise(_tag(F.lit(" * @returns"), returns, width, most)),
        each(throws, lambda t: _tag(F.concat(F.lit(" * @throws "), t["type"]), t["when"], width, most)),
        each(tags, lambda t: tag_lines(t["raw"])), F.array(F.lit(" */")),
    )
    return F.array_join(lines, eol + indent)
