"""Queries of the index build and of reports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import module
from codeloom.operators import flows, impact, index, reports, resolve
from codeloom.plans.catalogue import _RISK, _RUNS, _query, _runs
from codeloom.sources.starschema import Graph, table

# index


def _nodes(g: Graph) -> DataFrame:
    """Parsed nodes; every seventh class is missing, so that its methods have an unknown parent."""
    return g.nodes().where("NOT (kind = 'class' AND id % 7 = 3)").select("*", F.col("file").alias("path"), module(F.col("qname")).alias("module"))


_NODES = "k AS (SELECT * FROM nodes WHERE NOT (kind = 'class' AND id % 7 = 3))"
#: Customers and what they extend, by the form in which the base is written.
_BASES = """b AS (SELECT c.file AS path, c.qname AS source, c.module, t.qname AS tq, t.module AS tm, c.ck, t.ck AS tk FROM customers c JOIN customers t ON t.ck = c.ck // 10 WHERE c.ck > 0),
stars AS (SELECT source, target FROM imports WHERE CAST(split_part(target, '.n', 2) AS INTEGER) % 2 = 0)"""


def _bases(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Bases as full names, plain names, imported names, names behind an imported module and unknown ones; and the imports that they need."""
    c = g.customers().where("ck > 0").withColumn("up", F.expr("ck DIV 10"))
    t = g.customers().selectExpr("ck AS up", "qname AS tq", "module AS tm")
    b = c.join(t, "up").selectExpr("file AS path", "module", "qname AS cls", "ck", "tm", "up", "CASE ck % 5 WHEN 0 THEN tq WHEN 1 THEN concat('C', up) "
                                   "WHEN 2 THEN concat('B', ck) WHEN 3 THEN concat('m', ck, '.C', up) ELSE concat('Gone', ck) END AS base")
    named = b.where("ck % 5 = 2").selectExpr("path", "module", "concat('B', ck) AS local", "tm AS target_module", "concat('C', up) AS target_name", "false AS is_star", "1 AS ord")
    earlier = b.where("ck % 5 = 2").selectExpr("path", "module", "concat('B', ck) AS local", "'ext.lib' AS target_module", "'X' AS target_name", "false AS is_star", "0 AS ord")
    whole = b.where("ck % 5 = 3").selectExpr("path", "module", "concat('m', ck) AS local", "tm AS target_module", "CAST(NULL AS STRING) AS target_name", "false AS is_star", "0 AS ord")
    files = g.nations().selectExpr("module", "file AS path")
    # nations are a fixed list of 25
    stars = g.imports().where("try_cast(substring_index(target, '.n', -1) AS INT) % 2 = 0").join(F.broadcast(files), F.col("source") == F.col("module")).selectExpr(
        "path", "module", "'*' AS local", "target AS target_module", "'*' AS target_name", "true AS is_star", "0 AS ord")
    return b.select("path", "module", "cls", "base"), named.unionByName(earlier).unionByName(whole).unionByName(stars)


@_query(f"+ {_NODES} SELECT qname, CASE WHEN parent IN (SELECT qname FROM k) THEN parent END AS parent, 1 AS ids FROM k")
def index_nodes(spark, d):
    """Nodes with the parent that their parent_id leads to, and how many nodes share an id."""
    n = flows.saved(index.number_nodes(_nodes(Graph(spark, d)).drop("id")))
    up = n.select(F.col("id").alias("parent_id"), F.col("qname").alias("up"))
    ids = n.groupBy("id").agg(F.count("*").cast("int").alias("ids"))
    return n.join(up, "parent_id", "left").join(ids, "id").select("qname", F.col("up").alias("parent"), "ids")


@_query(f"""+ {_NODES}, e AS (SELECT file AS path, coalesce(parent, CASE WHEN contains(qname, '::') THEN split_part(qname, '::', 1) END) AS source, qname AS target FROM k)
SELECT *, 'contains' AS kind, CASE WHEN source IN (SELECT qname FROM k) THEN 'resolved' ELSE 'unresolved' END AS resolution FROM e WHERE source IS NOT NULL""")
def index_contains(spark, d):
    return index.contains_edges(_nodes(Graph(spark, d)))


@_query(f"""+ {_BASES}, i AS (SELECT path, module AS source, tm AS target FROM b WHERE ck % 5 IN (2, 3) UNION ALL SELECT path, module, 'ext.lib' FROM b WHERE ck % 5 = 2
  UNION ALL SELECT file, source, target FROM stars JOIN nations ON module = source)
SELECT *, 'import' AS kind, CASE WHEN target = 'ext.lib' THEN 'unresolved' ELSE 'resolved' END AS resolution FROM i""")
def index_imports(spark, d):
    g = Graph(spark, d)
    return index.import_edges(_bases(g)[1], g.nodes())


@_query(f"""+ {_BASES}, e AS (SELECT path, source, CASE WHEN ck % 5 IN (0, 2, 3) OR (ck % 5 = 1 AND (module = tm OR EXISTS (SELECT 1 FROM stars s WHERE s.source = b.module AND s.target = tm))) THEN tq
  WHEN ck % 5 = 1 THEN 'C' || tk ELSE 'Gone' || ck END AS target FROM b)
SELECT *, 'extends' AS kind, CASE WHEN contains(target, '::') THEN 'resolved' ELSE 'unresolved' END AS resolution FROM e""")
def index_inherits(spark, d):
    g = Graph(spark, d)
    bases, imports = _bases(g)
    return index.inherit_edges(bases, imports, _nodes(g).unionByName(g.nodes().where("kind = 'class' AND id % 7 = 3").select("*", F.col("file").alias("path"), module(F.col("qname")).alias("module"))))


@_query(f"""+ {_BASES}, gone AS (SELECT qname FROM customers JOIN nations USING (module) WHERE ck % 7 = 1 AND nk % 3 = 0), n2 AS (SELECT * FROM nodes WHERE qname NOT IN (FROM gone)),
e AS (SELECT path, source, CASE ck % 5 WHEN 0 THEN tq WHEN 1 THEN 'C' || tk WHEN 2 THEN 'B' || ck WHEN 3 THEN 'm' || ck || '.C' || tk ELSE 'Gone' || ck END AS base, tq,
  tq NOT IN (FROM gone) AND (ck % 5 IN (0, 2, 3) OR (ck % 5 = 1 AND (module = tm OR EXISTS (SELECT 1 FROM stars s WHERE s.source = b.module AND s.target = tm)))) AS found FROM b WHERE source NOT IN (FROM gone)),
c AS (SELECT file AS path, coalesce(parent, CASE WHEN contains(qname, '::') THEN split_part(qname, '::', 1) END) AS source, qname AS target FROM n2)
SELECT path, source, CASE WHEN found THEN tq ELSE base END AS target, 'extends' AS kind, CASE WHEN found THEN 'resolved' ELSE 'unresolved' END AS resolution FROM e
UNION ALL SELECT *, 'contains', CASE WHEN source IN (SELECT qname FROM n2) THEN 'resolved' ELSE 'unresolved' END FROM c WHERE source IS NOT NULL""")
def index_update_edges(spark, d):
    """Contains and inherit edges after classes of some files vanished, brought up to date from the index as it was; the oracle builds them anew."""
    g = Graph(spark, d)
    # parsed tables are there as such, so what stands for them is made once
    bases, imports = [flows.saved(x) for x in _bases(g)]
    n = flows.saved(g.nodes().select("*", F.col("file").alias("path"), module(F.col("qname")).alias("module")).drop("id"))
    files = g.nations().where("nk % 3 = 0").selectExpr("file AS path")
    gone = g.customers().where("ck % 7 = 1").selectExpr("qname", "file AS path").join(F.broadcast(files), "path", "left_semi").select("qname")
    calls = spark.createDataFrame([], "path string, source string, module string, receiver string, name string, form string, line int")
    ir = {"nodes": n, "bases": bases, "imports": imports, "calls": calls, "types": spark.createDataFrame([], "scope string, receiver string, type string")}
    nodes = flows.saved(index.number_nodes(n))
    old = {"nodes": nodes, "edges": flows.saved(index.edges_of(ir, nodes)), "degrees": None, "flows": None}
    now = ir | {"nodes": n.join(gone, "qname", "left_anti"), "bases": bases.join(gone.toDF("cls"), "cls", "left_anti")}
    edges = index.update(old, now, files)[0]["edges"]
    return edges.where("kind <> 'import'").select("path", "source", "target", "kind", "resolution")


@_query("""+ n AS (SELECT module, 'C' || ck % 20 AS name, module || '::G' || ck % 3 || '.C' || ck % 20 AS qname, file, ck FROM customers)
SELECT module, name, arg_max(qname, (file, ck, qname)) AS qname FROM n GROUP BY 1, 2""")
def index_module_symbols(spark, d):
    c = Graph(spark, d).customers()
    return index.module_symbols(c.selectExpr("module", "concat(module, '::G', ck % 3, '.C', ck % 20) AS qname", "file AS path", "ck AS start_line", "'class' AS kind"))


@_query("""+ c AS (SELECT DISTINCT concat_ws(':', l_orderkey, l_linenumber, pk) AS call, l_linenumber AS n, o.qname AS source, o.parent, 'parts.' || split_part(p.module, '.', 2) || '::p' || pk AS part
  FROM lineitem JOIN ords o ON ok = l_orderkey JOIN parts p ON pk = l_partkey)
SELECT call, source, CASE WHEN n IN (1, 2) THEN part WHEN n = 3 THEN source WHEN n = 5 THEN parent END AS target,
CASE WHEN n IN (1, 2, 3, 5) THEN 'resolved' WHEN n = 4 THEN 'dynamic' ELSE 'unresolved' END AS resolution FROM c""")
def index_calls(spark, d):
    """Calls in seven forms: an imported name, a member of an imported module, one of self, of an unknown receiver, a local class, another form, a missing import."""
    g = Graph(spark, d)
    # equal calls are one; rows are dealt out once for that and for the joins
    one = lambda rows, key: rows.repartition(key).distinct()
    lines = one(g.t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    orders, parts = one(g.orders().selectExpr("ok", "qname AS source", "module"), "ok"), one(g.parts().selectExpr("pk", "module AS pm"), "pk")
    # calls and imports read the lines
    x = flows.saved(lines.join(orders, F.col("ok") == F.col("l_orderkey")).join(parts, F.col("pk") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "ok", "pk", "pm", "source", "module"))
    calls = x.selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, pk) AS call", "source", "module", "element_at(array(NULL, concat('m_', pm), 'self', 'x', NULL, NULL, NULL), CAST(l_linenumber AS INT)) AS receiver",
        "element_at(array(concat('p', pk), concat('p', pk), concat('o', ok), 'run', substring_index(substring_index(source, '::', -1), '.', 1), 'f()', concat('q', pk)), CAST(l_linenumber AS INT)) AS name",
        "element_at(array('simple', 'attribute', 'attribute', 'attribute', 'simple', 'other', 'simple'), CAST(l_linenumber AS INT)) AS form")
    bind = lambda local, name: f"named_struct('local', {local}, 'target_module', pm, 'target_name', {name}, 'ord', 1)"
    # a row for each name that a module imports: the part, its module, the missing one
    imports = x.select("module", "pm", "pk").distinct().selectExpr("module", f"""inline(array({bind("concat('p', pk)", "concat('p', pk)")}, {bind("concat('q', pk)", "concat('q', pk)")}))""").unionByName(
        x.select("module", "pm").distinct().selectExpr("module", f"""inline(array({bind("concat('m_', pm)", "CAST(NULL AS STRING)")}))"""))
    types = g.nations().selectExpr("module AS scope", "module AS receiver", "module AS type").where("false")
    return resolve.resolve_calls(calls, g.nodes(), imports, types).select("call", "source", "target", "resolution")


@_query("""SELECT qname, CAST(split_part(file, '/', 2) = 'r1' OR split_part(file, '/', 3) LIKE 'n2%' OR regexp_full_match(regexp_extract(qname, '([^.:]*)$', 1), 'p1.*')
OR len(list_filter(decorators, lambda d: d LIKE '2-%')) > 0 AS INTEGER) AS is_test, CAST(contains(file, 'parts/') AS INTEGER) AS excluded FROM nodes""")
def index_test_tags(spark, d):
    n = Graph(spark, d).nodes()
    tag = index.is_test(F.col("file"), F.col("qname"), F.col("decorators"), ["src/r1/*", "*/n2*"], ["p1*"], ["2-*"])
    return n.select("qname", tag.alias("is_test"), index.path_match(F.col("file"), ["*/parts/*"]).cast("int").alias("excluded"))


# reports


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).cast("decimal(18,6)").alias(c) if c in columns else c for c in df.columns])


def _dec(e: str, name: str) -> str:
    return f"CAST(round({e}, 6) AS DECIMAL(18, 6)) AS {name}"


@_query(f"""SELECT lang AS mode, count(*) AS runs, {_dec('avg(1 + n_chars % 2 + CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END)', 'mean_tool_calls')},
{_dec('avg(CASE WHEN n_chars % 2 = 1 OR n_chars % 3 = 0 THEN 1.0 ELSE 0.0 END)', 'adoption_rate')}, {_dec('avg(CASE WHEN n_chars % 2 = 1 THEN 1.0 ELSE 0.0 END)', 'search_rate')},
{_dec('avg(CASE WHEN n_chars % 3 = 0 THEN 1.0 ELSE 0.0 END)', 'graph_rate')} FROM documents GROUP BY 1""", graph_sql=False)
def tool_adoption(spark, d):
    runs = table(spark, d, "documents").selectExpr(
        "lang AS mode", "concat(array('read'), IF(n_chars % 2 = 1, array('t__search'), array()), IF(n_chars % 3 = 0, array('t__graph'), array())) AS tool_calls")
    return _shown(reports.adoption(runs, "t__", ["search", "graph"]), "mean_tool_calls", "adoption_rate", "search_rate", "graph_rate")


@_query(f"""SELECT d.lang AS mode, count(*) AS runs, count(*) FILTER (toxic = 0) AS successful_runs, count(*) FILTER (toxic <> 0) AS provider_failures,
{_dec('sum(CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars * 0.25::DOUBLE END)', 'total_cost_usd')}, {_dec('avg(CASE WHEN n_chars % 4 = 0 THEN 0 ELSE n_chars * 0.25::DOUBLE END)', 'mean_cost_usd')},
{_dec('avg(CAST(n_chars AS DOUBLE))', 'mean_elapsed_ms')} FROM documents d JOIN labels USING (doc_id) GROUP BY 1""", graph_sql=False)
def mode_costs(spark, d):
    runs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr(
        "lang AS mode", "toxic = 0 AS success", "IF(n_chars % 4 = 0, NULL, n_chars * 0.25D) AS cost_usd", "CAST(n_chars AS DOUBLE) AS elapsed_ms")
    return _shown(reports.mode_report(runs, ["elapsed_ms"]), "total_cost_usd", "mean_cost_usd", "mean_elapsed_ms")


@_query(f"""SELECT lang AS mode, count(DISTINCT source) AS cases, CAST(max(n_chars) AS BIGINT) AS max_characters, {_dec('avg(CAST(n_chars AS DOUBLE))', 'mean_characters')}, {_dec('avg(CAST(n_chars % 7 AS DOUBLE))', 'mean_files')},
(SELECT count(*) FROM lineitem) AS symbol_count, (SELECT {_dec("avg(CASE WHEN l_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END)", "r")} FROM lineitem) AS symbol_found_rate FROM documents GROUP BY 1""", graph_sql=False)
def preflight_contexts(spark, d):
    contexts = table(spark, d, "documents").selectExpr("source AS case_id", "lang AS mode", "CAST(n_chars AS BIGINT) AS characters", "n_chars % 7 AS files")
    symbols = table(spark, d, "lineitem").selectExpr("l_orderkey AS case_id", "l_partkey AS qname", "l_partkey % 3 = 0 AS found")
    return _shown(reports.preflight(contexts, symbols), "mean_characters", "mean_files", "symbol_found_rate")


@_query(f"""WITH {_RUNS}, w AS (SELECT case_id, mode FROM (SELECT DISTINCT case_id FROM runs), (VALUES ('en'), ('fr'), ('none')) v(mode) WHERE mode <> 'none'),
n AS (SELECT w.case_id, w.mode, count(f1) AS n FROM w LEFT JOIN runs r ON r.case_id = w.case_id AND r.mode = w.mode GROUP BY 1, 2)
SELECT case_id, min(n) AS least, max(n) AS most FROM n GROUP BY 1 HAVING min(n) = 0 OR min(n) <> max(n)""", graph_sql=False)
def coverage_gaps(spark, d):
    runs = _runs(spark, d)
    return reports.coverage_gaps(runs, runs, ["en", "fr"])


_DELTAS = f"""{_RUNS}, m AS (SELECT case_id, count(*) FILTER (mode = 'en') AS repetitions, coalesce(avg(f1) FILTER (mode = 'fr'), 0) - coalesce(avg(f1) FILTER (mode = 'en'), 0) AS fr_delta,
coalesce(avg(f1) FILTER (mode = 'de'), 0) - coalesce(avg(f1) FILTER (mode = 'en'), 0) AS de_delta, max(toxic * 50 + length(mode) * 10) AS max_risk FROM runs GROUP BY 1)"""


def _deltas(spark, d) -> DataFrame:
    runs = _runs(spark, d)
    return reports.route_deltas(runs, runs.selectExpr("case_id", "toxic * 50 + length(mode) * 10 AS risk"), "en", ["fr", "de"])


@_query(f"WITH {_DELTAS} SELECT case_id, repetitions, {_dec('fr_delta', 'fr_delta')}, {_dec('de_delta', 'de_delta')}, CAST(max_risk AS BIGINT) AS max_risk FROM m", graph_sql=False)
def route_deltas(spark, d):
    return _shown(_deltas(spark, d).withColumn("max_risk", F.col("max_risk").cast("long")), "fr_delta", "de_delta")


@_query(f"""WITH {_DELTAS} SELECT risk_group, count(case_id) AS n, {_dec('coalesce(avg(fr_delta), 0)', 'mean_fr_delta')}, {_dec('coalesce(avg(de_delta), 0)', 'mean_de_delta')}, count(*) FILTER (fr_delta > 0) AS positive
FROM (VALUES ('high_risk'), ('low_risk')) g(risk_group) LEFT JOIN m ON risk_group = CASE WHEN max_risk >= 60 THEN 'high_risk' ELSE 'low_risk' END GROUP BY 1""", graph_sql=False)
def risk_groups(spark, d):
    return _shown(reports.risk_groups(_deltas(spark, d), ["fr", "de"]), "mean_fr_delta", "mean_de_delta")


@_query("SELECT status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('missing')) s(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY 1", graph_sql=False)
def status_counts(spark, d):
    return reports.status_counts(table(spark, d, "orders").selectExpr("o_orderstatus AS status"), ["F", "O", "P", "missing"])


@_query("""WITH g AS (SELECT l_orderkey AS case_id, l_linenumber AS gold, l_partkey % 10 AS file, (l_partkey + 1) % 10 AS alt, l_suppkey % 5 AS lo FROM lineitem)
SELECT DISTINCT CAST(l.l_orderkey AS VARCHAR) AS run, l_linenumber AS pred, gold FROM lineitem l JOIN g ON g.case_id = l_orderkey AND l_suppkey % 10 IN (file, alt)
AND (gold % 2 = 0 OR l_linenumber BETWEEN lo AND lo + 2) AND (gold % 3 <> 0 OR contains(lower(l_returnflag || l_linestatus), 'no'))""", graph_sql=False)
def findings_met(spark, d):
    t = table(spark, d, "lineitem")
    golds = t.selectExpr("l_orderkey AS case_id", "l_linenumber AS gold", "l_partkey % 10 AS file", "array((l_partkey + 1) % 10) AS alternates", "IF(l_linenumber % 2 = 0, NULL, l_suppkey % 5) AS line_start",
                         "IF(l_linenumber % 2 = 0, NULL, l_suppkey % 5 + 2) AS line_end", "IF(l_linenumber % 3 = 0, array('no'), CAST(array() AS ARRAY<STRING>)) AS keywords")
    text = lambda x: x.select(*[F.col(c) if c not in ("file", "alternates") else F.col(c).cast("string" if c == "file" else "array<string>").alias(c) for c in x.columns])
    found = t.selectExpr("CAST(l_orderkey AS STRING) AS run", "l_orderkey AS case_id", "l_linenumber AS pred", "l_suppkey % 10 AS file", "l_linenumber AS line", "concat(l_returnflag, l_linestatus) AS title", "CAST(NULL AS STRING) AS description")
    return reports.findings_met(text(found), text(golds))


@_query("""WITH c AS (SELECT o_custkey % 5 AS repo, o_orderkey AS k, 'src/a' || o_custkey % 40 || '.py' AS primary_ FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, primary_ ORDER BY k) > 1 AS late FROM c)
SELECT repo, 'c' || k AS "commit", primary_ AS "primary", row_number() OVER (PARTITION BY repo ORDER BY late, k) AS place FROM r""", graph_sql=False)
def history_candidates(spark, d):
    """A log of one commit an order, read back: merges have two parents, and every third commit changes no test."""
    o = table(spark, d, "orders").selectExpr("o_custkey % 5 AS repo", "o_orderkey AS k", "o_custkey % 40 AS a")
    lines = o.select("repo", F.posexplode(F.array(
        F.concat(F.lit("@@@c"), "k", F.when(F.col("k") % 2 == 0, "|p1|").otherwise("|p1 p2|"), F.lit("2020-01-01|subject | more")), F.lit(""),
        F.concat(F.lit("src/a"), "a", F.lit(".py")), F.when(F.col("k") % 3 == 0, "docs/x.md").otherwise("tests/t.py"))).alias("i", "line"), "k")
    history = reports.read_history(lines.select("repo", (F.col("k") * 10 + F.col("i")).alias("ord"), "line"))
    return reports.commit_candidates(history, "src/", "tests/", ".py")


@_query("""WITH r AS (SELECT l_suppkey AS "group", l_orderkey AS item, count(*) AS n_gold FROM lineitem GROUP BY 1, 2), n AS (SELECT "group", count(*) AS n FROM r GROUP BY 1),
p AS (SELECT "group", item, row_number() OVER (PARTITION BY "group" ORDER BY n_gold DESC, item) AS place FROM r)
SELECT "group", item, place, greatest(s_nationkey * 5 - n, 0) AS short FROM p JOIN n USING ("group") JOIN supplier ON s_suppkey = "group" WHERE place <= s_nationkey * 5""", graph_sql=False)
def quota_selection(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("group"), F.col("l_orderkey").alias("item")).agg(F.count("*").alias("n_gold"))
    return reports.quota(rows, table(spark, d, "supplier").selectExpr("s_suppkey AS group", "CAST(s_nationkey * 5 AS BIGINT) AS wanted"))


@_query("""+ a AS (SELECT DISTINCT file, start_line AS line FROM ords), h AS (SELECT DISTINCT file, start FROM hunks),
n AS (SELECT a.file, line, start, abs(start - line) AS dist FROM a JOIN h USING (file)), m AS (SELECT file, line, min(dist) AS dist FROM n GROUP BY 1, 2),
b AS (SELECT file, line, min(start) AS start, count(*) AS c FROM n JOIN m USING (file, line, dist) GROUP BY 1, 2)
SELECT a.file, a.line, CASE WHEN c = 1 THEN start END AS start, CASE WHEN c IS NULL THEN 'no hunks' WHEN c > 1 THEN 'ambiguous' END AS problem FROM a LEFT JOIN b USING (file, line)""")
def nearest_hunks(spark, d):
    g = Graph(spark, d)
    return reports.nearest_hunks(g.orders().selectExpr("file", "start_line AS line"), g.hunks())


@_query("""SELECT doc_id::VARCHAR AS qname, 2 AS start_line, least(9, 4) AS end_line, 1 AS truncated,
array_to_string(list_transform(range(2, least(4, len(string_split(text, chr(10)))) + 1), lambda i: i || ': ' || string_split(text, chr(10))[i]), chr(10)) AS source FROM documents WHERE text IS NOT NULL""", graph_sql=False)
def symbol_snippets(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").selectExpr("CAST(doc_id AS STRING) AS file", "text")
    nodes = docs.selectExpr("file AS qname", "file", "2 AS start_line", "9 AS end_line")
    return reports.snippets(nodes, docs, 3).drop("file")


@_query("""+ a AS (SELECT DISTINCT target AS qname FROM calls UNION SELECT 'gone.' || l_orderkey FROM lineitem)
SELECT a.qname, coalesce(kind, '') AS kind, coalesce(file, '') AS file, coalesce(start_line, 0) AS line,
CASE WHEN length(signature) > 160 THEN signature[1:160] || '…' ELSE coalesce(signature, '') END AS signature FROM a LEFT JOIN nodes USING (qname)""")
def symbol_briefs(spark, d):
    g = Graph(spark, d)
    asked = g.calls().select(F.col("target").alias("qname")).union(g.t("lineitem").select(F.concat(F.lit("gone."), "l_orderkey"))).distinct()
    return reports.briefs(asked, g.nodes())


@_query("""+ m AS (SELECT qname, parent AS community FROM ords), s AS (SELECT community, count(*) AS node_count, list_sort(list(qname)) AS l FROM m GROUP BY 1),
a AS (SELECT qname AS symbol FROM ords UNION SELECT qname FROM parts UNION SELECT 'no::such')
SELECT symbol, CAST(community IS NOT NULL AS INTEGER) AS found, CASE WHEN symbol = 'no::such' THEN 'symbol not found' WHEN community IS NULL THEN 'not in any community' END AS reason, community,
'L' || community AS label, node_count, array_to_string(l[1:3], ',') AS members, greatest(node_count - 3, 0) AS overflow_count FROM a LEFT JOIN m ON m.qname = symbol LEFT JOIN s USING (community)""")
def community_of_symbol(spark, d):
    g = Graph(spark, d)
    members = g.orders().selectExpr("qname", "parent AS community")
    labels = members.groupBy("community").agg(F.count("*").alias("node_count")).withColumn("label", F.concat(F.lit("L"), "community"))
    asked = g.orders().select("qname").union(g.parts().select("qname")).union(spark.createDataFrame([("no::such",)], "qname string"))
    r = reports.community_of(asked, g.nodes(), members, labels, 3)
    return r.withColumn("members", F.when(F.col("found") == 1, F.array_join("members", ",")))


@_query(f"""+ {_RISK} SELECT CASE WHEN risk >= 60 THEN 'high' ELSE 'low' END AS level, count(*) AS n, CAST(max(risk) AS BIGINT) AS top FROM risks GROUP BY 1""")
def risk_levels(spark, d):
    g = Graph(spark, d)
    r = impact.risk_scores(g.calls(), g.nodes())
    return r.groupBy(F.when(F.col("risk") >= reports.HIGH_RISK, "high").otherwise("low").alias("level")).agg(F.count("*").alias("n"), F.max("risk").cast("long").alias("top"))
