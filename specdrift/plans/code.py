"""Registered queries over source texts: edits, differences, comments, notes, exports, rendered documentation.

They register in ``catalog``; documents stand for source files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from specdrift.functions import answers as A
from specdrift.functions.comments import doc_comment, line_at, line_starts, rendered
from specdrift.operators import edits as E
from specdrift.operators import source as S
from specdrift.plans.catalog import query, table
from specdrift.plans.shared import shared_dir
from specdrift.sources.scan import scan

# ------------------------------------------------------------------ edits and differences

_EDITS = """e AS (SELECT doc_id AS file, k AS symbol, k * 40 + (doc_id + k) % 3 * 15 AS start, k * 40 + (doc_id + k) % 3 * 15 + (k * 7 + doc_id) % 45 AS "end", length(text) AS size
 FROM documents, LATERAL (SELECT unnest(generate_series(0, length(text) // 40 - 1)) AS k)),
b AS (SELECT DISTINCT e.file, e.symbol FROM e JOIN e AS o ON o.file = e.file AND o.symbol BETWEEN e.symbol - 3 AND e.symbol + 3 AND o.symbol <> e.symbol
 WHERE o.start = e.start OR (o.start < e."end" AND e.start < o."end")),
g AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY file ORDER BY start) AS until FROM e ANTI JOIN b USING (file, symbol) WHERE "end" <= size),
p AS (SELECT file, count(*) AS n, max("end") AS last, string_agg(text[until + 1:start] || '[' || symbol || ']', '' ORDER BY start) AS head
 FROM g JOIN documents ON doc_id = file GROUP BY file)"""


@query("apply_edits", f"""WITH {_EDITS} SELECT d.doc_id AS file, coalesce(head || d.text[last + 1:], d.text) AS after, coalesce(n, 0) AS applied,
 (SELECT count(*) FROM e WHERE e.file = d.doc_id) - coalesce(n, 0) AS failed FROM documents d LEFT JOIN p ON p.file = d.doc_id""")
def apply_edits(spark, sf):
    docs = table(spark, sf, "documents")
    numbers = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.length("text") / 40).cast("int"), F.lit(1)) - 1), lambda k: (k + 1) * 40 <= F.length("text")))
    k = docs.select(F.col("doc_id").alias("file"), numbers.alias("symbol"))
    start = F.col("symbol") * 40 + (F.col("file") + F.col("symbol")) % 3 * 15
    edits = k.select("file", "symbol", start.alias("start"), (start + (F.col("symbol") * 7 + F.col("file")) % 45).alias("end"), F.format_string("[%d]", "symbol").alias("text"))
    done = E.splice(docs.select(F.col("doc_id").alias("file"), "text"), edits)
    return done.select("file", "after", F.size("applied").cast("bigint").alias("applied"), F.size("failed").cast("bigint").alias("failed"))


_VERSIONS = """v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS before,
 CASE WHEN doc_id % 4 = 0 THEN text ELSE replace(text, 'tion', 'TION') END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'added' ELSE '' END AS after FROM documents)"""


@query("unified_diff", rf"""WITH {_VERSIONS},
l AS (SELECT *, string_split(regexp_replace(replace(before, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS o,
 string_split(regexp_replace(replace(after, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS n FROM v),
h AS (SELECT *, CASE WHEN list_position(list_transform(list_zip(o, n), lambda x: coalesce(x[1] = x[2], false)), false) IS NULL THEN greatest(len(o), len(n))
  ELSE list_position(list_transform(list_zip(o, n), lambda x: coalesce(x[1] = x[2], false)), false) - 1 END AS p,
 coalesce(list_position(list_transform(list_zip(list_reverse(o), list_reverse(n)), lambda x: coalesce(x[1] = x[2], false)), false) - 1, greatest(len(o), len(n))) AS q FROM l),
s AS (SELECT *, least(q, len(o) - p, len(n) - p) AS t, greatest(0, p - 3) AS c FROM h)
SELECT doc_id, CASE WHEN before = after THEN '' ELSE array_to_string(list_concat(list_concat(list_concat(list_concat(
 ['--- a/' || doc_id, '+++ b/' || doc_id, '@@ -' || (c + 1) || ',' || (least(len(o), len(o) - t + 3) - c) || ' +' || (c + 1) || ',' || (least(len(n), len(n) - t + 3) - c) || ' @@'],
 list_transform(o[c + 1:p], lambda x: ' ' || x)), list_transform(o[p + 1:len(o) - t], lambda x: '-' || x)), list_transform(n[p + 1:len(n) - t], lambda x: '+' || x)),
 list_transform(o[len(o) - t + 1:least(len(o), len(o) - t + 3)], lambda x: ' ' || x)), chr(10)) END AS diff FROM s""")
def unified_diff(spark, sf):
    body = _VERSIONS.removeprefix("v AS (").removesuffix(")").replace("FROM documents", "FROM {d}")
    versions = spark.sql(body, d=table(spark, sf, "documents"))
    return versions.select("doc_id", E.unified_diff(F.col("doc_id").cast("string"), F.col("before"), F.col("after")).alias("diff"))


# ------------------------------------------------------------------ files, comments, notes, exports


@query("scan_sources", """SELECT CASE WHEN doc_id % 2 = 0 THEN 'app' ELSE 'lib' END AS project, CASE WHEN doc_id % 5 = 0 THEN 'src' ELSE 'test/unit' END AS folder, sha256(coalesce(text, '')) AS hash
FROM documents WHERE doc_id % 5 IN (0, 3)""")
def scan_sources(spark, sf):
    """Writes the documents as files of two projects, in folders of which some are no source, and scans them."""
    root = shared_dir(spark, "sources")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    projects = {"app": f"{root}/app", "lib": f"{root}/lib"}
    for i, path in enumerate(projects.values()):
        for k, folder in enumerate(("src", "dist", "src/gen", "test/unit", "lib/node_modules/x")):
            mine = docs.filter((F.col("doc_id") % 2 == i) & (F.col("doc_id") % 5 == k)).select("text")
            mine.write.option("lineSep", "\x1e").option("maxRecordsPerFile", 50).text(f"{path}/{folder}")
    found = scan(spark, projects, include=["src/**", "dist/**", "test/**"], exclude=["**/gen/**"], extensions=("txt",))
    ends = found.select("project", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.split("text", "\x1e", -1).alias("t"))
    each = ends.select("project", "folder", F.explode(F.slice("t", 1, F.size("t") - 1)).alias("text"))
    return each.select("project", "folder", F.sha2("text", 256).alias("hash"))


@query("doc_comments", r"""WITH l AS (SELECT doc_id, string_split(replace(translate(text, '@=]' || chr(13), '(()'), '*/', '* /'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, ls, i, (i // 3) % 3 AS k, regexp_replace(array_to_string(ls[i + 1:i + 3], chr(10)), '^\s+|\s+$', '', 'g') AS body FROM l, LATERAL (SELECT unnest(generate_series(1, len(ls) - 1, 3)) AS i)),
j AS (SELECT doc_id, string_agg(CASE k WHEN 0 THEN 'see::true:' WHEN 1 THEN 'param:p' || i || ':true:' ELSE 'custom-x::false:' END || body, chr(10) ORDER BY i) AS tags FROM t GROUP BY doc_id)
SELECT l.doc_id, regexp_replace(ls[1], '^\s+|\s+$', '', 'g') AS description, coalesce(tags, '') AS tags FROM l LEFT JOIN j ON j.doc_id = l.doc_id""")
def doc_comments(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null")
    lines = F.split(F.replace(F.translate("text", "@=]\r", "(()"), F.lit("*/"), F.lit("* /")), "\n", -1)
    kind = lambda i: F.when(i % 3 != 1, "").when(F.floor(i / 3) % 3 == 0, "@see ").when(F.floor(i / 3) % 3 == 1, F.format_string("@param {T} p%d ", i)).otherwise("@custom-x ")
    block = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit(" * "), kind(i), x)), "\n")
    source = F.concat(F.lit("/** earlier\n * @see nothing */\ncode();\n/**"), F.substring(block, F.lit(3), F.length(block)), F.lit("\n */\nfunction f() {}"))
    shown = lambda t: F.concat_ws(":", t["name"], F.coalesce(t["parameter"], F.lit("")), t["known"].cast("string"), t["text"])
    return docs.withColumn("c", doc_comment(source)).select("doc_id", "c.description", F.array_join(F.transform("c.tags", shown), "\n").alias("tags"))


_NOTES = """l AS (SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line, CASE WHEN doc_id % 3 = 0 THEN 'code'
 WHEN doc_id % 11 = 0 THEN '  // ESLint-disable' WHEN doc_id % 11 = 1 THEN '/// <reference>' WHEN doc_id % 11 = 2 THEN '// Copyright X' WHEN doc_id % 11 = 3 THEN '//@ts-ignore'
 ELSE '// plain ' || doc_id END AS content FROM documents)"""


@query("note_eligibility", rf"""WITH {_NOTES}, c AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM l WHERE ltrim(content) LIKE '//%'),
i AS (SELECT file, g, max(line) AS last, bool_or(ltrim(content) LIKE '///%') AS r, bool_or(content ILIKE '%eslint%' OR content ILIKE '%@ts-%') AS d, bool_or(content ILIKE '%copyright%') AS o,
 trim(string_agg(regexp_replace(ltrim(content), '^///?\s?', ''), chr(10) ORDER BY line)) AS text FROM c GROUP BY file, g)
SELECT l.file, l.line AS anchor, i.text, NOT (r OR d OR o) AS eligible, CASE WHEN r THEN 'triple-slash' WHEN d THEN 'directive' WHEN o THEN 'license' END AS blocked_by
FROM l JOIN i ON l.file = i.file AND i.last = l.line - 1 WHERE l.content = 'code'""")
def note_eligibility(spark, sf):
    lines = spark.sql(f"WITH {_NOTES.replace('FROM documents', 'FROM {d}')} SELECT file, CAST(line AS BIGINT) AS line, content FROM l", d=table(spark, sf, "documents"))
    return S.source_notes(lines, lines.filter("content = 'code'").select("file", F.col("line").alias("anchor"))).select("file", "anchor", "text", "eligible", "blocked_by")


_MEMBERS = """m AS (SELECT doc_id AS symbol, CASE WHEN doc_id % 40 <> 0 THEN doc_id - 1 END AS container, doc_id % 120 <> 0 AS exported,
 CASE WHEN doc_id % 29 = 5 THEN 'private' WHEN doc_id % 37 = 9 THEN 'protected' ELSE 'public' END AS visibility FROM documents)"""


@query("exported_members", f"""WITH RECURSIVE {_MEMBERS}, x AS (SELECT symbol FROM m WHERE container IS NULL AND exported UNION ALL
 SELECT m.symbol FROM x JOIN m ON m.container = x.symbol WHERE m.visibility = 'public') SELECT symbol, symbol IN (SELECT symbol FROM x) AS exported FROM m""")
def exported_members(spark, sf):
    return S.exported_members(spark.sql(f"WITH {_MEMBERS.replace('FROM documents', 'FROM {d}')} SELECT * FROM m", d=table(spark, sf, "documents")))


@query("offset_lines", """WITH l AS (SELECT doc_id, i, string_split(text, chr(10)) AS ls FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)),
s AS (SELECT doc_id, i - 1 AS line, coalesce(sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
o AS (SELECT doc_id, unnest(generate_series(-5, length(text) + 40, 97)) AS p FROM documents)
SELECT o.doc_id, p AS "at", CAST(coalesce(line, 0) AS INT) AS line, CAST(p - coalesce(start, 0) AS BIGINT) AS place FROM o ASOF LEFT JOIN s ON o.doc_id = s.doc_id AND o.p >= s.start""")
def offset_lines(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", line_starts(F.col("text")).alias("starts"), F.length("text").alias("n"))
    asked = docs.select("doc_id", "starts", F.explode(F.sequence(F.lit(-5), F.col("n") + 40, F.lit(97))).alias("at"))
    found = asked.withColumn("line", line_at(F.col("starts"), F.col("at")))
    return found.select("doc_id", F.col("at").cast("bigint").alias("at"), "line", (F.col("at") - F.get("starts", F.col("line"))).alias("place"))


# ------------------------------------------------------------------ rendered documentation


@query("rendered_docs", r"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn, role, text) AS k, replace(replace(replace(text, '```', ''), '*/', '*\/'), chr(13) || chr(10), chr(10)) AS t FROM conversations),
x AS (SELECT k, i AS b, s[i] AS line FROM (SELECT k, string_split(t, chr(10)) AS s FROM c), LATERAL (SELECT unnest(generate_series(1, len(s))) AS i)),
sec AS (SELECT k, 1 AS a, b, CASE WHEN line = '' THEN ' *' WHEN regexp_matches(line, '^\s') THEN ' * ' || line END AS whole, line[length(m) + 1:] AS t, ' * ' || m AS first, ' * ' || repeat(' ', length(m)) AS following
  FROM (SELECT *, regexp_extract(line, '^(?:[-*+]|\d+[.)])\s+') AS m FROM x)
 UNION ALL SELECT k, 2, 0, NULL, t, ' * @param q ', ' *   ' FROM c
 UNION ALL SELECT k, 3, 0, NULL, role, ' * @returns ', ' *   ' FROM c WHERE turn % 3 = 0
 UNION ALL SELECT k, 4, 0, ' * @custom x' || chr(10) || ' * y', NULL, NULL, NULL FROM c),
s AS (SELECT *, row_number() OVER (ORDER BY k, a, b) AS sid, regexp_extract_all(coalesce(t, ''), '[^\s]+') AS ws FROM sec),
w AS (SELECT sid, 0 AS pos, CAST([] AS VARCHAR[]) AS lines, CAST(NULL AS VARCHAR) AS line FROM s WHERE whole IS NULL
 UNION ALL SELECT sid,
  CASE WHEN line IS NULL AND length(p) + length(array_to_string(ws[pos + 1:], ' ')) <= 60 THEN len(ws) ELSE pos + 1 END,
  CASE WHEN line IS NULL AND length(p) + length(array_to_string(ws[pos + 1:], ' ')) <= 60 THEN list_append(lines, p || array_to_string(ws[pos + 1:], ' '))
       WHEN line IS NOT NULL AND length(line) + 1 + length(ws[pos + 1]) > 50 THEN CASE WHEN length(following) + length(array_to_string(ws[pos + 1:], ' ')) <= 60 THEN list_append(list_append(lines, line), following || array_to_string(ws[pos + 1:], ' ')) ELSE list_append(lines, line) END ELSE lines END,
  CASE WHEN line IS NULL AND length(p) + length(array_to_string(ws[pos + 1:], ' ')) <= 60 THEN NULL WHEN line IS NULL THEN p || ws[pos + 1]
       WHEN length(line) + 1 + length(ws[pos + 1]) <= 50 THEN line || ' ' || ws[pos + 1]
       WHEN length(following) + length(array_to_string(ws[pos + 1:], ' ')) <= 60 THEN '' ELSE following || ws[pos + 1] END
 FROM (SELECT w.*, ws, following, CASE WHEN len(lines) = 0 THEN first ELSE following END AS p FROM w JOIN s USING (sid) WHERE w.pos < len(ws) AND (w.line IS NULL OR w.line <> '')) w),
done AS (SELECT s.sid, array_to_string(CASE WHEN len(ws) = 0 THEN [rtrim(first)] WHEN line IS NULL OR line = '' THEN lines ELSE list_append(lines, line) END, chr(10)) AS text
 FROM w JOIN s USING (sid) QUALIFY row_number() OVER (PARTITION BY s.sid ORDER BY pos DESC, len(lines) DESC) = 1),
doc AS (SELECT s.k, '/**' || chr(10) || string_agg(coalesce(whole, text), chr(10) ORDER BY s.a, s.b) || chr(10) || ' */' AS doc FROM s LEFT JOIN done ON done.sid = s.sid GROUP BY s.k)
SELECT conv_id, turn, role, doc FROM c JOIN doc USING (k)""".replace("\\\\", "\\"))
def rendered_docs(spark, sf):
    plain = F.replace("text", F.lit("```"), F.lit(""))
    doc = rendered(
        plain, F.lit(None).cast("string"), F.array(F.struct(F.lit("q").alias("name"), plain.alias("text"))), F.when(F.col("turn") % 3 == 0, F.col("role")),
        F.array().cast("array<struct<type:string,when:string>>"), F.array(F.struct(F.lit("@custom x\n * y").alias("raw"))), width=50, most=60,
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", doc.alias("doc"))


# ------------------------------------------------------------------ answers and schemas


@query("salvage_nested", """SELECT doc_id, CASE WHEN doc_id % 7 IN (4, 5) THEN NULL WHEN doc_id % 7 = 6 THEN '{"id":"later","verdict":"OK"}' ELSE '{"id":"' || doc_id || '","reason":"' || lang || '","verdict":"OK"}' END AS answer FROM documents""")
def salvage_nested(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("OK").alias("verdict"), F.col("lang").alias("reason"))).alias("a"))
    said = F.to_json(F.struct(F.concat(F.lit("so: "), "a", F.lit(" as asked")).alias("result")))
    deep = F.concat(F.repeat(F.lit('{"x":'), 7), F.col("a"), F.repeat(F.lit("}"), 7))
    k = F.col("doc_id") % 7
    output = (
        F.when(k == 0, F.col("a")).when(k == 1, said).when(k == 2, F.concat(F.lit("thinking {\n"), "a", F.lit("\ndone")))
        .when(k == 3, F.concat(F.lit('{"n":1,"list":[2,[{"inner":'), "a", F.lit('}]],"z":"none"}'))).when(k == 4, deep).when(k == 5, "no { answer")
        .otherwise(F.concat(F.lit('{"a":'), "a", F.lit(',"text":"{\\"id\\":\\"later\\",\\"verdict\\":\\"OK\\"}"}')))
    )
    return A.salvaged(docs.withColumn("output", output), "doc_id", "output")


@query("portable_schema", """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE '{"properties":{"a' || p_size || '":{"enum":["' || p_brand || '",{"x":' || p_size || '}],"type":"string"},"none":{}},"required":["a' || p_size || '"],"type":"object"}' END AS schema FROM part""")
def portable_schema(spark, sf):
    schema = F.format_string(
        '{"$schema":"s","type":"object","properties":{"minLength":{"type":"x"},"a%1$d":{"type":"string","minLength":%1$d,"enum":["%2$s",{"propertyNames":[],"x":%1$d}]},"none":{"minLength":0}},"required":["a%1$d"]}',
        "p_size", "p_brand",
    )
    broken = F.when(F.col("p_partkey") % 50 == 0, F.substring(schema, F.lit(1), F.length(schema) - 1)).otherwise(schema)
    return A.portable_schemas(table(spark, sf, "part").select("p_partkey", broken.alias("schema")), "p_partkey", "schema")
