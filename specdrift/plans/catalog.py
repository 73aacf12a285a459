"""Every registered query of the drift operators, with its SQL.

The given tables are read as the model's tables through a few projections (``VIEWS``): documents stand
for symbols and their recorded baseline, events and orders for call edges, line items for call sites,
labels for evaluation cases. The projections are SQL that Spark and DuckDB read alike, so a query and
its oracle start from the same rows. Graphs are made of all rows, with keys that grow with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specdrift.functions import text as T
from specdrift.operators import classify as C
from specdrift.operators import context as X
from specdrift.operators import graph as G
from specdrift.operators import metrics as M
from specdrift.operators import outcome as O

EMPTY = T.EMPTY_DOC_HASH
VIEWS = {
    "cur": f"""SELECT source || '#' || CAST(doc_id AS STRING) AS id, sha2(text, 256) AS symbol_hash,
        CASE WHEN doc_id % 5 <> 0 THEN sha2(CAST(n_chars AS STRING), 256) ELSE '{EMPTY}' END AS doc_hash,
        doc_id % 5 <> 0 AS has_doc, doc_id AS start_line, doc_id + 3 AS end_line, lang AS project
        FROM documents WHERE doc_id % 13 <> 0""",
    "lock": f"""SELECT source || '#' || CAST(doc_id AS STRING) AS id,
        CASE WHEN doc_id % 7 = 0 THEN sha2('old' || text, 256) ELSE sha2(text, 256) END AS symbol_hash,
        CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN '{EMPTY}' WHEN doc_id % 17 = 0 THEN sha2('old', 256)
             ELSE sha2(CAST(n_chars AS STRING), 256) END AS doc_hash,
        source AS file_path, doc_id AS start_line, lang AS project
        FROM documents WHERE doc_id % 11 <> 0""",
    "known": "SELECT source || '#' || CAST(doc_id AS STRING) AS id FROM documents WHERE doc_id % 13 = 0 AND doc_id % 3 = 0",
    "hunks": "SELECT source AS path, min(doc_id) + 20 AS start, min(doc_id) + 420 AS `end` FROM documents GROUP BY source",
    "edges_cyc": "SELECT user_id AS src, (user_id * 7 + event_id) % (SELECT count(*) FROM events) AS dst FROM events",
    "edges_dag": """SELECT DISTINCT greatest(o_orderkey, o_custkey) AS src, least(o_orderkey, o_custkey) AS dst FROM orders
        WHERE o_orderkey <> o_custkey""",
    "exports": """SELECT DISTINCT 'f' || CAST(o_custkey AS STRING) AS file, 'n' || CAST(o_orderkey % 9 AS STRING) AS name,
        CASE WHEN o_orderkey % 3 > 0 THEN 'f' || CAST((o_orderkey * 31 + o_custkey) % (SELECT max(o_custkey) + 1 FROM orders) AS STRING) END AS to_file,
        CASE WHEN o_orderkey % 3 > 0 THEN 'n' || CAST((o_orderkey + o_custkey) % 9 AS STRING) END AS to_name FROM orders""",
    "entry_files": "SELECT DISTINCT 'f' || CAST(o_custkey AS STRING) AS file FROM orders WHERE o_custkey % 10 = 1",
    "sites": """SELECT l_partkey AS callee, l_suppkey AS module, l_orderkey AS k1, l_linenumber AS k2, l_quantity AS k3,
        l_extendedprice AS k4, l_tax AS k5, l_discount AS k6 FROM lineitem""",
    "cases": "SELECT quality = 1 AS human_useful, CASE WHEN toxic = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM labels",
    "usage": """SELECT o_orderpriority AS run, o_orderkey AS input_tokens, o_custkey AS output_tokens, o_orderkey % 50 <> 0 AS token_counts_available,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'usd' WHEN o_orderstatus = 'O' THEN 'none' WHEN o_orderpriority LIKE '2%' THEN 'usd'
             WHEN o_orderstatus = 'F' THEN 'subscription' ELSE 'usd' END AS cost_basis,
        CAST(o_totalprice AS DECIMAL(18, 2)) AS cost_usd FROM orders""",
    "attempts": """SELECT user_id AS run, event_id AS ord, CAST(CASE WHEN event_id % 31 = 0 THEN 401 WHEN event_id % 3 = 0 THEN 422
        WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN 400 ELSE 200 END AS INT) AS status, event_id % 6 AS attempt FROM events""",
}
SITE_ORDER = ["k1", "k2", "k3", "k4", "k5", "k6", "module"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = next(t for t in ("documents", "events", "orders", "lineitem", "labels") if f"FROM {t}" in VIEWS[name])
    return spark.sql(VIEWS[name].replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _duck(name: str) -> str:
    body = VIEWS[name].replace("`", '"')
    body = re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", body).replace("AS STRING", "AS VARCHAR")
    return body


def _with(names: str, body: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_duck(n)})" for n in names.split()) + "\n" + body


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# ------------------------------------------------------------------ snapshot diff

_CLASSIFIED = f"""both_sides AS (
  SELECT coalesce(c.id, l.id) AS id,
    CASE WHEN c.id IS NULL THEN 'orphaned' WHEN NOT has_doc THEN 'missing'
         WHEN l.symbol_hash <> c.symbol_hash AND l.doc_hash = c.doc_hash THEN 'drifted' ELSE 'unchanged' END AS status,
    CASE WHEN c.id IS NULL THEN l.file_path ELSE split_part(c.id, '#', 1) END AS file_path,
    CASE WHEN c.id IS NULL THEN l.start_line ELSE c.start_line END AS start_line,
    c.id IS NULL AND (l.doc_hash = '{EMPTY}' OR l.id IN (SELECT id FROM known)) AS spared
  FROM cur c FULL OUTER JOIN lock l ON c.id = l.id),
classified AS (SELECT id, status, file_path, start_line FROM both_sides WHERE NOT spared)"""


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(
        view(spark, sf, "cur").select("id", "symbol_hash", "doc_hash", "has_doc", "start_line"),
        view(spark, sf, "known"),
        view(spark, sf, "lock").select("id", "symbol_hash", "doc_hash", "file_path", "start_line"),
    )


def _sql_classified(body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_duck(n)})" for n in ("cur", "lock", "known")) + ", " + _CLASSIFIED + "\n" + body


@query("classify_status", _sql_classified("SELECT * FROM classified"))
def classify_status(spark, sf):
    return _classified(spark, sf)


@query("classify_orphans", _sql_classified("SELECT id, file_path, start_line FROM classified WHERE status = 'orphaned'"))
def classify_orphans(spark, sf):
    return _classified(spark, sf).filter("status = 'orphaned'").select("id", "file_path", "start_line")


@query("status_summary", _sql_classified("""SELECT count(*) FILTER (status = 'unchanged') AS unchanged,
 count(*) FILTER (status = 'drifted') AS drifted, count(*) FILTER (status = 'missing') AS missing,
 count(*) FILTER (status = 'orphaned') AS orphaned FROM classified"""))
def status_summary(spark, sf):
    return C.status_summary(_classified(spark, sf))


@query("report_issues", _sql_classified("SELECT id, status, file_path, start_line FROM classified WHERE status IN ('drifted', 'orphaned')"))
def report_issues(spark, sf):
    return C.ordered(C.reportable(_classified(spark, sf)))


@query("since_overlap", _sql_classified(f""", h AS ({_duck("hunks")})
SELECT id, status FROM classified r WHERE EXISTS (SELECT 1 FROM h WHERE h.path = r.file_path
 AND (r.status = 'orphaned' OR (r.start_line <= h."end" AND r.start_line + 3 >= h.start)))""").replace("\n, h AS", ", h AS"))
def since_overlap(spark, sf):
    rows = _classified(spark, sf).withColumn("end_line", F.col("start_line") + 3)
    return C.changed_since(rows, view(spark, sf, "hunks")).select("id", "status")


@query("scope_lock", _with("lock", "SELECT id, project FROM lock WHERE project IN ('de', 'fr')"))
def scope_lock(spark, sf):
    projects = table(spark, sf, "documents").filter("lang in ('de', 'fr')").select(F.col("lang").alias("project")).distinct()
    return C.scope_baseline(view(spark, sf, "lock"), projects).select("id", "project")


@query("lock_merge", _with("cur lock", """SELECT id, symbol_hash, doc_hash, split_part(id, '#', 1) AS file_path, start_line FROM cur WHERE start_line % 3 = 0
UNION ALL SELECT id, symbol_hash, doc_hash, file_path, start_line FROM lock WHERE id NOT IN (SELECT id FROM cur WHERE start_line % 3 = 0)"""))
def lock_merge(spark, sf):
    fresh = C.baseline_entries(view(spark, sf, "cur").filter("start_line % 3 = 0"))
    return C.merge_baseline(view(spark, sf, "lock").drop("project"), fresh)


@query("diff_parse", """WITH lines AS (
  SELECT conv_id AS diff, turn * 3 + j AS ord, CASE j WHEN 0 THEN '+++ b/' || role || '.ts'
    WHEN 1 THEN '@@ -1 +' || length(text) || CASE WHEN turn % 2 = 0 THEN ',' || (turn % 4) ELSE '' END || ' @@'
    ELSE '--- a/x' || turn || '.ts' END AS line
  FROM conversations, (SELECT unnest([0, 1, 2]) AS j)),
f AS (SELECT *, last_value(nullif(regexp_extract(line, '^(?:--- a|\\+\\+\\+ b)/(.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY diff ORDER BY ord) AS path,
  TRY_CAST(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1) AS INT) AS s,
  regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+\\d+,(\\d+)', 1) AS c FROM lines)
SELECT diff, path, greatest(1, s) AS start, greatest(1, s + greatest(1, CASE WHEN c = '' THEN 1 ELSE CAST(c AS INT) END) - 1) AS "end"
FROM f WHERE s IS NOT NULL AND path IS NOT NULL""".replace("\\\\", "\\"))
def diff_parse(spark, sf):
    conv = table(spark, sf, "conversations").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    count = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(","), (F.col("turn") % 4).cast("string"))).otherwise("")
    line = (
        F.when(F.col("j") == 0, F.concat(F.lit("+++ b/"), "role", F.lit(".ts")))
        .when(F.col("j") == 1, F.concat(F.lit("@@ -1 +"), F.length("text").cast("string"), count, F.lit(" @@")))
        .otherwise(F.concat(F.lit("--- a/x"), F.col("turn").cast("string"), F.lit(".ts")))
    )
    lines = conv.select(F.col("conv_id").alias("diff"), (F.col("turn") * 3 + F.col("j")).alias("ord"), line.alias("line"))
    return C.parse_diff(lines)


@query("ownership_conflict", "SELECT p_brand AS file, count(DISTINCT p_size) AS projects FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def ownership_conflict(spark, sf):
    return C.ownership_conflicts(table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("project")))


# ------------------------------------------------------------------ fingerprints and scalars


@query("doc_hash", r"""SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS doc_hash FROM documents""")
def doc_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.hash_text(T.normalize_doc(F.col("text"))).alias("doc_hash"))


@query("symbol_hash", """SELECT doc_id, sha256(coalesce(text, '') || chr(0) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END || chr(0) || '3' || chr(0) || '4:4' || chr(0) || 'cfg') AS symbol_hash FROM documents""")
def symbol_hash(spark, sf):
    note = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", T.hash_symbol(F.col("text"), note, "3", "4:4", "cfg").alias("symbol_hash"))


@query("anchor_hash", """SELECT doc_id, sha256(coalesce(text, '') || chr(0) || coalesce(lang, '') || chr(0)) AS anchor_hash FROM documents""")
def anchor_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.anchor_hash(F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("anchor_hash"))


@query("symbol_ids", r"""SELECT p_partkey, regexp_replace(replace(p_type, '\', '/'), '^\./', '') || '#' || p_brand || '.' || p_name AS id FROM part""")
def symbol_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.symbol_id(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("id"))


@query("token_count", r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'),
 lambda x: greatest(1, CAST(ceil(octet_length(encode(x)) / 4.0) AS BIGINT)))), 0) AS BIGINT) AS tokens FROM documents""")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("limit_lines", r"""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) <= 5 THEN text ELSE array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10) || '… [elided]' END AS text FROM documents""")
def limit_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.limit_lines(F.col("text"), 5).alias("text"))


@query("file_hashes", "SELECT url AS file, sha256(html) AS hash FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY html) = 1")
def file_hashes(spark, sf):
    pages = X.first_by_key(table(spark, sf, "pages"), "url", ["html"])
    return M.file_hashes(pages.select(F.col("url").alias("file"), F.col("html").alias("content")))


@query("retry_backoff", _with("attempts", "SELECT ord, CAST(least(250 * pow(2, attempt), 60000) AS BIGINT) AS wait_ms, (status IN (408, 409, 429) OR status >= 500) AS retryable FROM attempts"))
def retry_backoff(spark, sf):
    return view(spark, sf, "attempts").select("ord", T.retry_wait_ms(F.col("attempt")).alias("wait_ms"), T.is_retryable(F.col("status")).alias("retryable"))


# ------------------------------------------------------------------ graphs

_CLOSURE = """, e AS (SELECT DISTINCT src, dst FROM edges_cyc),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
scc AS (SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component FROM n
  LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.node GROUP BY n.node)
"""


def _cyc_sql(body: str) -> str:
    return f"WITH RECURSIVE edges_cyc AS ({_duck('edges_cyc')})" + _CLOSURE + body


@query("distinct_edges", _with("edges_cyc", "SELECT DISTINCT src, dst FROM edges_cyc"))
def distinct_edges(spark, sf):
    return G.distinct_edges(view(spark, sf, "edges_cyc"))


@query("reverse_edges", _with("edges_dag", "SELECT dst AS src, src AS dst FROM edges_dag"))
def reverse_edges(spark, sf):
    return G.reverse_edges(view(spark, sf, "edges_dag"))


@query("scc", _cyc_sql("SELECT node, component FROM scc"))
def scc(spark, sf):
    return G.strongly_connected(view(spark, sf, "edges_cyc"))


@query("condensed_dag", _cyc_sql("SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN scc a ON e.src = a.node JOIN scc b ON e.dst = b.node WHERE a.component <> b.component"))
def condensed_dag(spark, sf):
    edges = view(spark, sf, "edges_cyc")
    return G.condense(G.distinct_edges(edges), G.strongly_connected(edges))


_LEVELS = f"""WITH RECURSIVE d AS ({_duck("edges_dag")}),
walk AS (SELECT node, 0 AS level FROM (SELECT src AS node FROM d UNION SELECT dst FROM d) UNION SELECT d.src, w.level + 1 FROM walk w JOIN d ON d.dst = w.node),
lv AS (SELECT node, CAST(max(level) AS INT) AS level FROM walk GROUP BY node)
"""


@query("topo_levels", _LEVELS + "SELECT node, level FROM lv")
def topo_levels(spark, sf):
    return G.levels(view(spark, sf, "edges_dag"))


@query("dependency_order", _LEVELS + "SELECT node, level, row_number() OVER (ORDER BY level, node) AS position FROM lv")
def dependency_order(spark, sf):
    return G.dependency_order(G.levels(view(spark, sf, "edges_dag")))


@query("callee_resolve", """WITH d AS (SELECT p_brand AS file, p_size AS name, p_type AS container, p_partkey % 2 = 0 AS st, p_partkey AS symbol FROM part),
c AS (SELECT p_partkey AS call, p_brand AS file, p_size AS name, p_type AS container, p_partkey % 2 = 0 AS st FROM part),
m AS (SELECT c.call, d.symbol, count(*) OVER (PARTITION BY c.call) = 1 AS one, c.container = d.container AND c.st = d.st AS same FROM c JOIN d ON c.file = d.file AND c.name = d.name)
SELECT call, min(symbol) AS symbol FROM m WHERE one OR same GROUP BY call""")
def callee_resolve(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_brand").alias("file"), F.col("p_size").alias("name"), F.col("p_type").alias("container"),
        (F.col("p_partkey") % 2 == 0).alias("static"), F.col("p_partkey").alias("symbol"),
    )
    return G.resolve_callees(part.withColumnRenamed("symbol", "call"), part)


_SPANS = """s AS (SELECT source AS file, doc_id AS symbol, doc_id * 10 AS start, doc_id * 10 + 5 + n_chars % 700 AS "end" FROM documents),
p AS (SELECT DISTINCT source AS file, doc_id * 10 + 3 AS point FROM documents)"""


@query("caller_containment", f"""WITH {_SPANS}
SELECT file, point, arg_max(symbol, start) AS symbol FROM p JOIN s USING (file) WHERE point >= start AND point < "end" GROUP BY file, point""")
def caller_containment(spark, sf):
    docs = table(spark, sf, "documents")
    spans = docs.select(F.col("source").alias("file"), F.col("doc_id").alias("symbol"), (F.col("doc_id") * 10).alias("start"), (F.col("doc_id") * 10 + 5 + F.col("n_chars") % 700).alias("end"))
    return G.containing(docs.select(F.col("source").alias("file"), (F.col("doc_id") * 10 + 3).alias("point")).distinct(), spans)


@query("public_surface", _with("exports entry_files", "").rstrip() + """, seen AS (SELECT file, name FROM exports WHERE file IN (SELECT file FROM entry_files)
 UNION SELECT x.to_file, x.to_name FROM seen s JOIN exports x ON s.file = x.file AND s.name = x.name WHERE x.to_file IS NOT NULL)
SELECT DISTINCT s.file, s.name FROM seen s JOIN exports x ON s.file = x.file AND s.name = x.name WHERE x.to_file IS NULL""")
def public_surface(spark, sf):
    return G.public_surface(view(spark, sf, "exports"), view(spark, sf, "entry_files"))


# ------------------------------------------------------------------ context


@query("callsite_sample_diverse", _with("sites", f"""SELECT callee, module, k1, k2, pick FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY lead DESC, {", ".join(SITE_ORDER)}) AS pick
FROM (SELECT *, row_number() OVER (PARTITION BY callee, module ORDER BY {", ".join(SITE_ORDER)}) = 1 AS lead FROM sites)) WHERE pick <= 5"""))
def callsite_sample_diverse(spark, sf):
    return X.sample_sites(view(spark, sf, "sites"), 5, SITE_ORDER).select("callee", "module", "k1", "k2", F.col("pick").cast("bigint").alias("pick"))


@query("callsite_sample_first", _with("sites", f"""SELECT callee, module, k1, k2, pick FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY {", ".join(SITE_ORDER)}) AS pick FROM sites) WHERE pick <= 5"""))
def callsite_sample_first(spark, sf):
    return X.sample_sites(view(spark, sf, "sites"), 5, SITE_ORDER, diverse=False).select("callee", "module", "k1", "k2", F.col("pick").cast("bigint").alias("pick"))


def _pack_sql(stop: bool) -> str:
    over = "done OR NOT fits" if stop else "false"
    return f"""WITH RECURSIVE c AS (SELECT conv_id AS owner, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS ord, CAST(length(text) % 97 AS BIGINT) AS cost FROM conversations),
w AS (SELECT DISTINCT owner, 0 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS INT[]) AS taken, false AS done FROM c
 UNION ALL SELECT owner, pos, CASE WHEN fits THEN used + price ELSE used END, CASE WHEN fits THEN list_append(taken, pos) ELSE taken END, {over}
 FROM (SELECT w.owner, c.ord AS pos, w.used, w.taken, w.done, c.cost + CASE WHEN len(w.taken) = 0 THEN 0 ELSE 2 END AS price,
   NOT w.done AND w.used + c.cost + CASE WHEN len(w.taken) = 0 THEN 0 ELSE 2 END <= 120 AS fits FROM w JOIN c ON c.owner = w.owner AND c.ord = w.pos + 1))
SELECT owner, array_to_string(taken, ',') AS taken, used FROM w QUALIFY row_number() OVER (PARTITION BY owner ORDER BY pos DESC) = 1"""


def _candidates(spark, sf):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("owner"), rank.alias("ord"), (F.length("text") % 97).alias("cost"))


@query("knapsack_pack", _pack_sql(False))
def knapsack_pack(spark, sf):
    return X.pack(_candidates(spark, sf), 120, 2).withColumn("taken", F.array_join("taken", ","))


@query("outline_pack", _pack_sql(True))
def outline_pack(spark, sf):
    return X.pack(_candidates(spark, sf), 120, 2, stop=True).withColumn("taken", F.array_join("taken", ","))


@query("request_waves", """SELECT doc_id, CASE WHEN p IS NULL OR row_number() OVER (PARTITION BY p ORDER BY doc_id) = 1 THEN 0 ELSE 1 END AS wave
FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS p FROM documents)""")
def request_waves(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("prefix"))
    return X.request_waves(rows, ["doc_id"]).select("doc_id", "wave")


@query("first_by_key", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1")
def first_by_key(spark, sf):
    return X.first_by_key(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "role")


@query("test_refs", """SELECT l_partkey AS symbol, l_suppkey AS file, l_returnflag || '>' || l_linestatus AS names, min(l_linenumber) AS line FROM lineitem GROUP BY ALL""")
def test_refs(spark, sf):
    refs = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("file"), F.array("l_returnflag", "l_linestatus").alias("names"), F.col("l_linenumber").alias("line")
    )
    return X.test_references(refs).withColumn("names", F.array_join("names", ">"))


@query("callee_bodies", _with("edges_dag", """SELECT src, dst, rank, text AS body FROM (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS INT) AS rank FROM edges_dag)
JOIN documents ON dst = doc_id WHERE rank <= 2 AND trim(text) <> ''"""))
def callee_bodies(spark, sf):
    bodies = table(spark, sf, "documents").select(F.col("doc_id").alias("symbol"), F.col("text").alias("body"))
    return X.callee_bodies(view(spark, sf, "edges_dag"), bodies)


@query("shared_outline_targets", "SELECT source AS file, count(*) AS targets FROM documents WHERE doc_id % 5 = 0 GROUP BY source HAVING count(*) >= 2")
def shared_outline_targets(spark, sf):
    return M.outline_targets(table(spark, sf, "documents").filter("doc_id % 5 = 0").select(F.col("source").alias("file")))


# ------------------------------------------------------------------ policy and outcomes

_SYMBOLS = """s AS (SELECT doc_id AS symbol, source AS file, lang AS container, text AS body, doc_id % 4 <> 0 AS exported, doc_id % 19 = 0 AS is_test,
  CASE doc_id % 5 WHEN 0 THEN 'getter' WHEN 1 THEN 'variable-function' WHEN 2 THEN 'class' WHEN 3 THEN 'type-alias' ELSE 'enum' END AS kind,
  CASE doc_id % 3 WHEN 0 THEN 'private' ELSE 'public' END AS visibility FROM documents)"""


def _symbols(spark, sf):
    body = _SYMBOLS.split("AS (", 1)[1].rstrip(")").replace("FROM documents", ", cast(null as string) AS doc_raw FROM {d}")
    return spark.sql(body, d=table(spark, sf, "documents"))


@query("eligible_symbols", rf"""WITH {_SYMBOLS}
SELECT symbol, kind FROM s WHERE exported AND NOT is_test AND visibility = 'public' AND kind IN ('getter', 'variable-function', 'class')
 AND len(string_split(regexp_replace(body, '^\s+|\s+$', '', 'g'), chr(10))) >= 3 AND regexp_matches(body, '\S')""")
def eligible_symbols(spark, sf):
    return O.eligible(_symbols(spark, sf), ["accessor", "arrow", "class"], ["public"]).select("symbol", "kind")


@query("ignored_container_anti", f"WITH {_SYMBOLS} SELECT symbol FROM s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 50 = 1 AND d.source = s.file AND d.lang = s.container)")
def ignored_container_anti(spark, sf):
    ignored = table(spark, sf, "documents").filter("doc_id % 50 = 1").select(F.col("source").alias("file"), F.col("lang").alias("container")).distinct()
    return O.without_ignored(_symbols(spark, sf), ignored).select("symbol")


@query("outcome_resolve", """WITH g AS (SELECT doc_id AS symbol, CASE WHEN doc_id % 11 = 0 THEN 'SKIP' WHEN doc_id % 7 = 0 THEN NULL ELSE 'OK' END AS verdict, CASE WHEN doc_id % 7 = 0 THEN 'timeout' END AS error FROM documents),
j AS (SELECT doc_id AS symbol, max(quality) = 1 AS accepted, max(CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'bad' END) AS error FROM labels GROUP BY doc_id)
SELECT g.symbol, CASE WHEN verdict = 'SKIP' THEN 'skipped' WHEN g.error IS NOT NULL OR verdict IS NULL OR verdict <> 'OK' THEN 'failed'
 WHEN j.error IS NOT NULL THEN 'failed' WHEN NOT coalesce(accepted, false) THEN 'rejected' ELSE 'generated' END AS outcome FROM g LEFT JOIN j ON g.symbol = j.symbol""")
def outcome_resolve(spark, sf):
    d = F.col("doc_id")
    g = table(spark, sf, "documents").select(d.alias("symbol"), F.when(d % 11 == 0, "SKIP").when(d % 7 != 0, "OK").alias("verdict"), F.when(d % 7 == 0, "timeout").alias("error"))
    j = table(spark, sf, "labels").groupBy(d.alias("symbol")).agg(
        (F.max("quality") == 1).alias("accepted"), F.max(F.when((F.col("toxic") == 1) & (d % 2 == 0), "bad")).alias("error")
    )
    return O.resolve_outcomes(g, j)


@query("param_key_check", """WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS w, list(DISTINCT CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END) AS g FROM orders GROUP BY 1)
SELECT k, list_sort(w) = list_sort(list_filter(g, lambda x: x IS NOT NULL)) AS same FROM a""")
def param_key_check(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.collect_set("o_orderstatus").alias("w"), F.collect_set(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus"))).alias("g")
    )
    return rows.select("k", O.same_keys(F.col("w"), F.col("g")).alias("same"))


@query("edit_overlap", """WITH e AS (SELECT source AS file, doc_id AS symbol, doc_id * 37 AS start, doc_id * 37 + n_chars % 900 AS "end" FROM documents)
SELECT symbol, EXISTS (SELECT 1 FROM e o WHERE o.file = e.file AND o.symbol <> e.symbol AND (o.start = e.start OR (o.start < e."end" AND e.start < o."end"))) AS blocked FROM e""")
def edit_overlap(spark, sf):
    d = table(spark, sf, "documents")
    edits = d.select(F.col("source").alias("file"), F.col("doc_id").alias("symbol"), (F.col("doc_id") * 37).alias("start"), (F.col("doc_id") * 37 + F.col("n_chars") % 900).alias("end"))
    return O.blocked_edits(edits).select("symbol", "blocked")


@query("plan_resolve", """SELECT doc_id AS symbol, CASE WHEN doc_id % 6 = 0 THEN 'gone' WHEN doc_id % 5 = 0 THEN 'blocked' WHEN doc_id % 7 = 0 THEN 'moved' ELSE 'ready' END AS state FROM documents""")
def plan_resolve(spark, sf):
    d = table(spark, sf, "documents")
    hashed = d.select(F.col("doc_id").alias("symbol"), F.sha2("text", 256).alias("anchor"))
    moved = F.when(F.col("symbol") % 7 == 0, F.sha2("anchor", 256)).otherwise(F.col("anchor"))
    current = hashed.filter("symbol % 6 <> 0").select("symbol", moved.alias("anchor"), (F.col("symbol") % 5 == 0).alias("edit_blocked"))
    return O.verify_plan(hashed, current)


@query("failfast_streak", _with("attempts", """SELECT run, min(ord) AS halted_at FROM (SELECT *, sum(CASE WHEN status IN (400, 422) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ord ROWS 2 PRECEDING) = 3 AS streak FROM attempts)
WHERE status IN (401, 403, 404) OR streak GROUP BY run"""))
def failfast_streak(spark, sf):
    return O.failfast(view(spark, sf, "attempts"))


@query("pacing_window", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def pacing_window(spark, sf):
    e = table(spark, sf, "events")
    # a time without a zone is taken as it is, whatever the session's zone
    zoned = dict(e.dtypes)["ts"] == "timestamp"
    micros = F.unix_micros("ts") if zoned else F.expr("CAST(1000000 * CAST(CAST(ts - TIMESTAMP_NTZ'1970-01-01' AS INTERVAL SECOND) AS DECIMAL(20, 6)) AS BIGINT)")
    # to the nearest second, halves to the even one
    rows = e.select("event_id", F.col("user_id").alias("run"), F.rint(micros / 1_000_000).cast("bigint").alias("at"))
    return O.pacing(rows, 3600).select("event_id", "in_window")


# ------------------------------------------------------------------ metrics


@query("judge_metrics", _with("cases", """, m AS (SELECT count(*) AS t, count(*) FILTER (verdict = 'ACCEPT') AS k, count(*) FILTER (human_useful) AS u,
 count(*) FILTER (verdict = 'ACCEPT' AND NOT human_useful) AS fk, count(*) FILTER (human_useful AND verdict = 'REJECT') AS fr FROM cases)
SELECT t AS total, k AS kept, round(coalesce(k / nullif(t, 0), 0), 6) AS keep_rate, fk AS false_keeps, round(coalesce(fk / nullif(k, 0), 0), 6) AS false_keep_rate,
 fr AS false_rejects, round(coalesce(fr / nullif(u, 0), 0), 6) AS false_reject_rate FROM m""").replace("\n, m", ", m"))
def judge_metrics(spark, sf):
    m = M.judge_metrics(view(spark, sf, "cases"))
    return m.select(*[F.round(c, 6).alias(c) if c.endswith("rate") else c for c in m.columns])


@query("ablation_metrics", """SELECT count(*) AS total, round(avg(1 + quality + toxic), 6) AS signature_only_mean, round(avg(1 + 3 * quality + toxic), 6) AS full_context_mean,
 round(avg(1 + 3 * quality + toxic) - avg(1 + quality + toxic), 6) AS mean_improvement FROM labels""")
def ablation_metrics(spark, sf):
    low, high = F.col("quality") + F.col("toxic") + 1, F.col("quality") * 3 + F.col("toxic") + 1
    m = M.ablation_metrics(table(spark, sf, "labels").select(low.alias("signature_only_score"), high.alias("full_context_score")))
    return m.select("total", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("promotion_metrics", """WITH c AS (SELECT quality = 1 AS useful, doc_id % 3 > 0 AS accepted, doc_id % 4 > 0 AS retained, toxic = 0 AS safe FROM labels)
SELECT count(*) AS total, round(count(*) FILTER (useful AND accepted AND retained) / count(*) FILTER (useful), 6) AS intent_retention_rate,
 round(count(*) FILTER (accepted AND NOT safe) / count(*) FILTER (accepted), 6) AS unsafe_promotion_rate,
 round(count(*) FILTER (NOT useful AND NOT accepted) / count(*) FILTER (NOT useful), 6) AS noise_rejection_rate FROM c""")
def promotion_metrics(spark, sf):
    d = F.col("doc_id")
    cases = table(spark, sf, "labels").select(
        F.when(F.col("quality") == 1, "intent").otherwise("todo").alias("kind"), (d % 3 > 0).alias("accepted"),
        (d % 4 > 0).alias("retained_intent"), (F.col("toxic") == 0).alias("safe_claim"),
    )
    m = M.promotion_metrics(cases)
    return m.select("total", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("stage_totals", """SELECT l_returnflag AS stage, CAST(sum(l_linenumber) AS BIGINT) AS requests, CAST(sum(l_orderkey % 7) AS BIGINT) AS failed FROM lineitem GROUP BY 1""")
def stage_totals(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_linenumber").alias("requests"), (F.col("l_orderkey") % 7).alias("failed"))
    return M.stage_totals(rows, ["requests", "failed"], ["stage"])


@query("usage_merge", _with("usage", """, u AS (SELECT run, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, bool_and(token_counts_available) AS a,
 count(DISTINCT nullif(cost_basis, 'none')) AS n, max(nullif(cost_basis, 'none')) AS b, sum(cost_usd) AS c FROM usage GROUP BY run)
SELECT run, i AS input_tokens, o AS output_tokens, a AS token_counts_available, CASE n WHEN 0 THEN 'none' WHEN 1 THEN b ELSE 'unknown' END AS cost_basis,
 CAST(CASE WHEN n = 1 AND b = 'usd' THEN c END AS DOUBLE) AS cost_usd FROM u""").replace("\n, u", ", u"))
def usage_merge(spark, sf):
    return M.merge_usage(view(spark, sf, "usage"), ["run"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("cost_price", "SELECT o_orderkey, round((o_orderkey * 2.5 + o_custkey * 10.0) / 1000000, 10) AS usd FROM orders")
def cost_price(spark, sf):
    usd = M.cost(F.col("o_orderkey"), F.col("o_custkey"), F.lit(2.5), F.lit(10.0))
    return table(spark, sf, "orders").select("o_orderkey", F.round(usd, 10).alias("usd"))


@query("cached_cost", "SELECT event_id, round(((event_id + user_id * 1.25 + (event_id % 9) * 2.0 + (event_id % 100) * 0.1) * 3.0 + user_id * 15.0) / 1000000, 10) AS usd FROM events")
def cached_cost(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    usd = M.cached_cost(e, u, e % 9, e % 100, u, F.lit(3.0), F.lit(15.0))
    return table(spark, sf, "events").select("event_id", F.round(usd, 10).alias("usd"))


@query("run_estimate", """SELECT c_nationkey AS run, count(*) AS n, count(*) * (least(2000, 4100 + c_nationkey * 100 - 4096) + 300) + count(*) * (least(2000, 4100 + c_nationkey * 100 - 4096) + 800) AS input_tokens,
 count(*) * 380 AS output_tokens FROM customer GROUP BY c_nationkey""")
def run_estimate(spark, sf):
    runs = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.count("*").alias("n"))
    runs = runs.withColumn("budget", F.lit(2000)).withColumn("usable", F.lit(4100) + F.col("run") * 100 - 4096)
    return M.run_estimate(runs).select("run", "n", "input_tokens", "output_tokens")


@query("price_lookup", """WITH p AS (SELECT min(p_partkey) AS ord, split_part(p_type, ' ', 1) AS pattern, min(p_size) AS price FROM part GROUP BY 2)
SELECT p_partkey AS k, arg_min(p.price, p.ord) AS input_price FROM part LEFT JOIN p ON starts_with(part.p_type, p.pattern) GROUP BY p_partkey""")
def price_lookup(spark, sf):
    part = table(spark, sf, "part")
    prices = part.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("pattern")).agg(
        F.min("p_partkey").alias("ord"), F.min("p_size").alias("input_price"), F.min("p_size").alias("output_price")
    )
    return M.price_lookup(part.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("model")), prices).select("k", "input_price")
