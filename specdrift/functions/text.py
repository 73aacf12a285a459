"""Column functions of the drift model: fingerprints, ids, token estimates, templates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SHA-256 of the empty string: the documentation hash of an undocumented symbol.
EMPTY_DOC_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Fixed estimate: a run of word characters or one other visible character, a token for each four bytes.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Fixed marker of what was cut off.
ELIDED = "\n… [elided]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_text(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def normalize_doc(description: Column, raw_tags: Column | None = None) -> Column:
    """Description and raw tags by line, white space folded; null gives ""."""
    parts = F.coalesce(description, F.lit(""))
    if raw_tags is not None:
        parts = F.concat_ws("\n", parts, F.array_join(F.coalesce(raw_tags, F.array().cast("array<string>")), "\n"))
    return F.trim(F.regexp_replace(parts, r"\s+", " "))


def _joined_by_nul(*parts: Column) -> Column:
    # concat_ws would skip nulls and shift the parts
    return F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts])


def symbol_code(canonical: Column, signature: Column, body: Column, asynchronous: Column) -> Column:
    fallback = F.to_json(F.array(signature, body, asynchronous.cast("string")))
    return F.coalesce(canonical, fallback)


def hash_symbol(code: Column, note: Column, recipe: str, prompt: str, config: str) -> Column:
    return F.sha2(_joined_by_nul(code, note, F.lit(recipe), F.lit(prompt), F.lit(config)), 256)


def anchor_hash(code: Column, raw_doc: Column, raw_note: Column) -> Column:
    """Fingerprint that an edit's target must still have."""
    return F.sha2(_joined_by_nul(code, raw_doc, raw_note), 256)


def symbol_id(path: Column, name: Column, container: Column | None = None, suffix: Column | None = None) -> Column:
    """``path#container.name`` and an optional suffix, without line numbers."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    inner = name if container is None else F.concat_ws(".", container, name)
    return F.concat(clean, F.lit("#"), inner, F.lit("") if suffix is None else F.coalesce(suffix, F.lit("")))


def file_of(symbol: Column) -> Column:
    return F.substring_index(symbol, "#", 1)


def token_count(text: Column) -> Column:
    """Conservative token estimate of a text."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.aggregate(
        runs, F.lit(0).cast("bigint"),
        lambda n, run: n + F.greatest(F.lit(1), F.ceil(F.octet_length(run) / F.lit(4))).cast("bigint"),
    )


def limit_lines(text: Column, most: int) -> Column:
    lines = F.split(text, "\n", -1)
    return F.when(F.size(lines) <= most, text).otherwise(
        F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(ELIDED))
    )


def body_lines(body: Column) -> Column:
    """Lines of the trimmed body; 0 for an empty one."""
    trimmed = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "\r?\n", -1)))


def retry_wait_ms(attempt: Column, retry_after: Column | None = None, base: int = 250, cap: int = 60_000) -> Column:
    """base * 2^attempt, or what the server asked for, cut at the cap."""
    own = F.lit(base) * F.pow(F.lit(2), attempt)
    wait = own if retry_after is None else F.coalesce(retry_after.cast("double"), own)
    return F.least(wait, F.lit(float(cap))).cast("bigint")


def is_retryable(status: Column, network: Column | None = None) -> Column:
    by_status = status.isin(408, 409, 429) | (status >= 500)
    return F.coalesce(by_status, F.lit(False)) if network is None else network | F.coalesce(by_status, F.lit(False))


def retry_after_ms(header: Column, body: Column, now: Column) -> Column:
    """Milliseconds to wait: finite seconds or an HTTP date in the header, else ``"retryDelay":"Ns"`` in the
    body; null if none. Never below 0."""
    given = F.trim(header)
    seconds = F.when(F.lower(given).rlike(r"nan|inf"), F.lit(None)).otherwise(given.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(given, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(date) - F.unix_micros(now)) / 1000
    delay = F.nullif(F.regexp_extract(body, r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', 1), F.lit("")).try_cast("double")
    wait = F.coalesce(seconds * 1000, until, delay * 1000)
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


#: What a failure's text is searched for, in this order, and whether it ends the run.
FAILURES = (
    ("turn-limit", r"(?i)\"stop_reason\"\s*:\s*\"tool_use\"|max(?:imum)? turns?", False),
    ("schema", r"(?i)error_max_structured_output_retries", False),
    ("login", r"(?i)login|log in|not authenticated|unauthori[sz]ed|sign in", True),
    ("quota", r"(?i)rate limit|usage limit|quota|exhaust|too many requests", True),
    ("model", r"(?i)unknown model|model .*(not found|not supported|unavailable)", True),
)


def failure_class(text: Column, reports_turns: Column | None = None) -> Column:
    """struct<class,fatal> of what a command-line provider reports; the first pattern that matches decides.
    Turn limits are only looked for where the tool ``reports_turns``."""
    out = None
    for name, pattern, fatal in FAILURES:
        hit = text.rlike(pattern)
        if name == "turn-limit" and reports_turns is not None:
            hit = hit & reports_turns
        one = F.struct(F.lit(name).alias("class"), F.lit(fatal).alias("fatal"))
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return out.otherwise(F.struct(F.lit("exit-code").alias("class"), F.lit(False).alias("fatal")))


def one_line(text: Column, most: int) -> Column:
    """White space folded, cut to ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)


def _run_tokens(run: Column) -> Column:
    return F.when(run.rlike(r"^\s"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.octet_length(run) / F.lit(4)))).cast("bigint")


def truncate(text: Column, most: Column) -> Column:
    """The text if it has ``most`` tokens at most; else its longest prefix that leaves room for the marker,
    right-trimmed, and the marker; "" if not even the marker fits.

    One fold over the runs of the text: whole runs while they fit, then the part of a word of which
    the tokens are left.
    """
    marker_tokens = 5  # of ELIDED: an ellipsis, two brackets, and two for a word of 6 bytes
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]|\s+"), F.lit(0))
    limit = most - marker_tokens
    start = F.struct(F.lit(0).alias("kept"), limit.cast("bigint").alias("left"), F.lit(True).alias("open"))

    def step(acc: Column, run: Column) -> Column:
        cost = _run_tokens(run)
        fits = acc["open"] & (cost <= acc["left"])
        part = F.size(F.filter(F.split(run, ""), lambda c, i: (c != "") & (F.octet_length(F.substring(run, F.lit(1), i + 1)) <= acc["left"] * 4)))
        return F.struct(
            F.when(fits, acc["kept"] + F.length(run)).when(acc["open"] & (acc["left"] > 0), acc["kept"] + part).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["left"] - cost).otherwise(acc["left"]).alias("left"), fits.alias("open"),
        )

    kept = F.substring(text, F.lit(1), F.aggregate(runs, start, step)["kept"])
    cut = F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit(ELIDED))
    return F.when(most <= 0, "").when(token_count(text) <= most, text).when(most <= marker_tokens, "").otherwise(cut)


def wrap_words(text: Column, first: Column | str, following: Column | str, width: int, most: int) -> Column:
    """array<string>: lines filled greedily up to ``width`` characters, prefix included; what is left goes on
    one line if that has ``most`` at most. Words are never split; no word gives the bare first prefix.

    A fold over the words' lengths finds the word each line starts with; lines are then cut from the array of words, so
    work is linear in the text.
    """
    first, following = (F.lit(p) if isinstance(p, str) else p for p in (first, following))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def lines(words: Column) -> Column:
        total = F.aggregate(words, F.lit(-1), lambda n, w: n + F.length(w) + 1)
        begin = F.struct(F.array().cast("array<int>").alias("at"), F.lit(-1).alias("line"), total.alias("left"), F.lit(0).alias("i"), F.lit(False).alias("rest"))

        def step(acc: Column, word: Column) -> Column:
            size = F.length(word)
            goes_on = acc["rest"] | ((acc["line"] >= 0) & (acc["line"] + 1 + size <= width))
            prefix = F.length(F.when(F.size(acc["at"]) == 0, first).otherwise(following))
            return F.struct(
                F.when(goes_on, acc["at"]).otherwise(F.concat(acc["at"], F.array(acc["i"]))).alias("at"),
                F.when(goes_on, acc["line"] + 1 + size).otherwise(prefix + size).alias("line"),
                (acc["left"] - size - 1).alias("left"), (acc["i"] + 1).alias("i"),
                (acc["rest"] | (~goes_on & (prefix + acc["left"] <= most))).alias("rest"),
            )

        def cut(at: Column) -> Column:
            until = lambda j: F.coalesce(F.get(at, j + 1), F.size(words))
            return F.transform(at, lambda a, j: F.concat(F.when(j == 0, first).otherwise(following), F.array_join(F.slice(words, a + 1, until(j) - a), " ")))

        found = F.aggregate(words, begin, step, lambda acc: acc["at"])
        return F.when(F.size(words) == 0, F.array(F.rtrim(first))).otherwise(let(found, cut))

    return let(words, lines)


def parameter_names(parameters: Column) -> Column:
    """Names by position; a destructured parameter (in braces or brackets) is root<index>."""
    return F.transform(parameters, lambda p, i: F.when(p.rlike(r"^\s*[\[{]"), F.concat(F.lit("root"), i.cast("string"))).otherwise(F.regexp_extract(p, r"^\s*(?:\.\.\.)?([^\s:?=]*)", 1)))


def indentation(source: Column, line: Column) -> Column:
    """White space at the head of a line (from 1) of a source."""
    return F.regexp_extract(F.coalesce(F.get(F.split(source, "\n", -1), line - 1), F.lit("")), r"^\s*", 0)


def end_of_line(source: Column) -> Column:
    return F.when(F.contains(source, F.lit("\r\n")), "\r\n").otherwise("\n")


def posix_path(path: Column) -> Column:
    """Forward slashes; an empty path is "."."""
    clean = F.regexp_replace(path, r"\\", "/")
    return F.when(clean == "", ".").otherwise(clean)


def normalized_path(path: Column) -> Column:
    """A path without "." segments and with ".." taken out against the segment before."""
    steps = F.filter(F.split(posix_path(path), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def workspace_id(project: Column, symbol: Column) -> Column:
    """A project-relative symbol id as one of the workspace; without a "#" it stays."""
    file, rest = F.substring_index(symbol, "#", 1), F.regexp_extract(symbol, r"(?s)#.*$", 0)
    return F.when(F.contains(symbol, F.lit("#")), F.concat(normalized_path(F.concat(posix_path(project), F.lit("/"), file)), rest)).otherwise(symbol)


def project_id(project: Column, symbol: Column) -> Column:
    """The inverse: the id without its project's path, where it has that."""
    prefix = F.concat(normalized_path(project), F.lit("/"))
    return F.when(F.startswith(symbol, prefix), F.substring(symbol, F.length(prefix) + 1, F.length(symbol))).otherwise(symbol)


def glob_pattern(glob: str) -> str:
    """A path glob (``**``, ``*``, ``?``, ``{a,b}``) as a regular expression for whole paths."""
    out, at, deep = "", 0, 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if glob.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        c = glob[at]
        deep += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and deep else c if c.isalnum() or c in "/_" else "\\" + c)
        at += 1
    return f"^{out}$"


def config_fingerprint(config: dict) -> str:
    """Of the settings that shape what is documented, as compact JSON."""
    return hashlib.sha256(json.dumps(config, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def salvage_json(output: Column, schema: str = "id string, verdict string, reason string") -> Column:
    """The last answer in a provider's output: the whole text, else its last line that is one JSON object
    with an id and a verdict, else the widest {...} in it; null if there is none."""
    lines = F.reverse(F.split(output, r"\r?\n"))
    embedded = F.regexp_extract(output, r"(?s)\{.*\}", 0)
    tried = F.concat(F.array(output), lines, F.array(embedded))
    parsed = F.transform(tried, lambda t: F.from_json(F.trim(t), schema, {"mode": "PERMISSIVE"}))
    return F.get(F.filter(parsed, lambda x: x["id"].isNotNull() & x["verdict"].isNotNull()), F.lit(0))


def six_places(value: Column, ties_to_even: bool = False) -> Column:
    """A double's exact value to six places; what lies in the middle goes up, or to the even digit.

    Java's formats round the shortest digits that name a double instead, which are others from about 10^10 on; only
    from 2^125 on they are used.
    """

    def part(digits: Column) -> Column:
        # the fraction in steps of 2^-78, of which 10^6 / 2^78 = 15625 / 2^72 makes millionths
        first, second = digits["first"] * 15625, digits["second"] * 15625
        high, low = first + F.shiftright(second, 39), second.bitwiseAND(2**39 - 1)
        return F.struct(digits["whole"].alias("whole"), F.shiftright(high, 33).alias("n"), high.bitwiseAND(2**33 - 1).alias("rest"), (low > 0).alias("more"))

    def text(p: Column) -> Column:
        odd = p["n"] % 2 == 1 if ties_to_even else F.lit(True)
        up = (p["rest"] > 2**32) | ((p["rest"] == 2**32) & (p["more"] | odd))
        return let(p["n"] + up.cast("int"), lambda n: F.concat((p["whole"] + F.floor(n / 1_000_000)).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0")))

    def exact(x: Column) -> Column:
        # scaling by powers of two and taking off the whole part lose nothing
        top = F.floor(x / 2.0**62)
        left = x - top * 2.0**62
        scaled = (left - F.floor(left)) * 2.0**39
        whole = top.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + F.floor(left).cast("decimal(19,0)")
        digits = F.struct(whole.alias("whole"), F.floor(scaled).alias("first"), F.floor((scaled - F.floor(scaled)) * 2.0**39).alias("second"))
        return let(let(digits, part), text)

    sized = F.when(F.abs(value) < 2.0**125, F.concat(F.when(value < 0, "-").otherwise(""), let(F.abs(value), exact)))
    return sized.when(value.isNotNull(), F.format_string("%.6f", value))


def format_cost(basis: Column, cost: Column, ties_to_even: bool = False) -> Column:
    """Fixed phrases for each basis; dollars to six places."""
    return (
        F.when(basis == "usd", F.concat(F.lit("$"), six_places(F.coalesce(cost, F.lit(0.0)), ties_to_even)))
        .when(basis == "subscription", "subscription allowance (no monetary cost available)")
        .when(basis == "none", "no model calls")
        .otherwise("cost unavailable")
    )
