"""Queries of names in texts, gold kinds, contexts under a budget and of checked cases, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import budget, words
from codeloom.operators.flows import saved
from codeloom.plans.catalogue import _query
from codeloom.sources import records
from codeloom.sources.starschema import Graph, table

#: The first word and the first two words of each benchmark item are its names.
_NAMED = r"""n AS (SELECT item_id, unnest([regexp_extract(text, '[\p{L}]+'), regexp_extract(text, '[\p{L}]+ [\p{L}]+')]) AS name FROM benchmark),
d AS (SELECT doc_id, chr(1) || regexp_replace(text, '[^\p{L}\p{N}_ ]', chr(1), 'g') || chr(1) AS t FROM documents),
hit AS (SELECT d.doc_id, k.name FROM d JOIN (SELECT DISTINCT name FROM n WHERE name <> '') k ON contains(t, ' ' || k.name || ' ')
  OR contains(t, chr(1) || k.name || ' ') OR contains(t, ' ' || k.name || chr(1)) OR contains(t, chr(1) || k.name || chr(1)))"""


def _item_names(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    first = lambda p: F.regexp_extract("text", p, 0)
    return b.select("item_id", F.explode(F.array(first(r"[\p{L}]+"), first(r"[\p{L}]+ [\p{L}]+"))).alias("name"))


@_query(rf"WITH {_NAMED} SELECT DISTINCT doc_id AS id, name FROM hit", graph_sql=False)
def name_mentions(spark, d):
    return words.mentions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _item_names(spark, d))


@_query(rf"""WITH {_NAMED}, c AS (SELECT count(*) AS k FROM benchmark), g AS (SELECT doc_id % k AS item_id, doc_id FROM documents, c)
SELECT g.item_id AS "case", g.doc_id AS file, CASE WHEN EXISTS (SELECT 1 FROM n JOIN hit USING (name) WHERE n.item_id = g.item_id AND hit.doc_id = g.doc_id)
THEN 'direct' ELSE 'cochange' END AS kind FROM g""", graph_sql=False)
def gold_kinds(spark, d):
    """Every document as a gold of one item: direct if it holds one of the item's names."""
    docs = table(spark, d, "documents")
    n = table(spark, d, "benchmark").agg(F.count("*").alias("k"))
    # one row
    golds = docs.crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("k")).alias("case"), F.col("doc_id").alias("file"))
    return words.gold_kinds(golds, _item_names(spark, d).withColumnRenamed("item_id", "case"), docs.select(F.col("doc_id").alias("file"), "text"))


#: Characters of a budgeted context of the query below.
LIMIT = 2500


def _context(g: Graph) -> dict[str, DataFrame]:
    """Orders as cases: the parts of their lines are changed, the lines' suppliers neighbours, the parts' resolved calls downstream."""
    # a row per order and number, of which the tables may have several
    lines = g.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    # what a part calls, two symbols at most, comes along with the part
    calls = g.part_calls().selectExpr("source AS part", "target AS qname", "ord AS place").join(
        g.nodes().where("kind IN ('class', 'function')").select("qname", F.col("file").alias("at")), "qname").groupBy("part").agg(F.collect_list(F.struct("place", "qname", "at")).alias("calls"))
    parts = g.parts().select("pk", F.col("qname").alias("part"), "file", "p_name").join(calls, "part", "left")
    lines = lines.join(parts, F.col("pk") == F.col("l_partkey"))
    lines = lines.join(g.suppliers().selectExpr("sk", "qname AS near", "file AS near_file"), F.col("sk") == F.col("l_suppkey"))
    # five tables read the lines
    lines = saved(lines.select("l_orderkey", "l_linenumber", "l_quantity", "part", "file", "p_name", "calls", "near", "near_file"))
    snippet = ["l_orderkey AS `case`", "CAST(l_linenumber AS BIGINT) AS ord"]
    source = "repeat(concat(p_name, '\\n'), CAST(l_quantity AS INT) + 30) AS source"
    # sources are long, so lines are dealt out before they have them
    changed = lines.selectExpr(*snippet, "part", "file", "p_name", "l_quantity", "l_linenumber").repartition("case", "ord").selectExpr(
        "`case`", "ord", "part AS qname", "file", "1 AS start_line", "l_linenumber AS end_line", source, "l_linenumber % 2 = 0 AS truncated")
    near = lines.selectExpr(*snippet, "near AS qname", "near_file AS file", "1 AS start_line", "l_linenumber AS end_line", "repeat(near, 9) AS source", "false AS truncated")
    impacts = lines.selectExpr(*snippet, "part AS symbol", "true AS found", "array(near) AS entries")
    nodes = lines.selectExpr("*", "inline(calls)").selectExpr(
        *snippet, "'downstream' AS direction", "place AS rank", "qname", "at AS file", "l_linenumber AS line")
    cases = lines.groupBy(F.col("l_orderkey").alias("case")).agg(F.sort_array(F.collect_set("part")).alias("symbols"))
    return budget.fit_context(cases, changed, near, impacts, nodes, LIMIT)


def _js(*members: str) -> str:
    """Characters of an object from key:chars pairs, as SQL."""
    pairs = [m.split(":", 1) for m in members]
    return "(" + " + ".join([str(2 + 2 * (len(pairs) - 1) + sum(len(k) + 4 for k, _ in pairs)), *(f"({v})" for _, v in pairs)]) + ")"


def _snip(q: str, f: str, source: str, flag: str) -> str:
    return _js(f"qname:length({q}) + 2", f"file:length({f}) + 2", "start_line:1", "end_line:length(CAST(l_linenumber AS VARCHAR))", f"source:{source} + 2", f"truncated:{flag}")


@_query(f"""+ l AS (SELECT l_orderkey AS c, l_linenumber, p.qname AS part, p.file, p_name, s.qname AS near, s.file AS near_file,
  (length(p_name) + 1) * (CAST(floor(l_quantity) AS INTEGER) + 30) AS size, (length(p_name) + 2) * (CAST(floor(l_quantity) AS INTEGER) + 30) AS wide
  FROM (SELECT l_orderkey, l_linenumber, x.l_partkey, x.l_suppkey, x.l_quantity FROM (SELECT l_orderkey, l_linenumber,
    min({{'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_quantity': l_quantity}}) AS x FROM lineitem GROUP BY ALL)) JOIN parts p ON pk = l_partkey JOIN suppliers s ON sk = l_suppkey),
ch AS (SELECT *, {_snip('part', 'file', 'wide', 'CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 5 END')} AS chars FROM l),
nb AS (SELECT *, {_snip('near', 'near_file', '9 * length(near)', '5')} AS chars FROM l),
im AS (SELECT c, {_js('symbol:length(part) + 2', 'found:4', 'affected_entries:length(near) + 4', 'upstream:2', 'downstream:2')} AS chars FROM l),
nd AS (SELECT c, l_linenumber, k.ord AS place, {_js('qname:length(n.qname) + 2', 'file:length(n.file) + 2', 'line:length(CAST(l_linenumber AS VARCHAR))')} AS chars
  FROM l JOIN calls k ON k.source = part JOIN nodes n ON n.qname = k.target WHERE resolution = 'resolved' AND k.ord > 1000000),
sy AS (SELECT c, sum(length(part) + 2) + 2 * (count(*) - 1) + 2 AS chars FROM (SELECT DISTINCT c, part FROM l) GROUP BY 1),
ndl AS (SELECT c, sum(x) AS chars FROM (SELECT c, sum(chars) + 2 * (count(*) - 1) AS x FROM nd GROUP BY c, l_linenumber) GROUP BY 1),
listed AS (SELECT c, sum(a) AS a, sum(b) AS b, sum(i) AS i FROM (SELECT c, sum(chars) + 2 * (count(*) - 1) AS a, 0 AS b, 0 AS i FROM ch GROUP BY 1
  UNION ALL SELECT c, 0, sum(chars) + 2 * (count(*) - 1), 0 FROM nb GROUP BY 1 UNION ALL SELECT c, 0, 0, sum(chars) + 2 * (count(*) - 1) FROM im GROUP BY 1) GROUP BY 1),
tot AS (SELECT c, {_js('changed_symbol_source:a + 2', 'direct_neighbor_source:b + 2',
    'graph_evidence:' + _js('changed_symbols:sy.chars', 'impacts:i + 2 + coalesce(ndl.chars, 0)'), f'max_chars:{len(str(LIMIT))}', 'serialized_chars:1')} AS total
  FROM listed JOIN sy USING (c) LEFT JOIN ndl USING (c)),
cuts AS (SELECT *, unnest(range(CAST(ceil((size - 500) / 500.0) AS BIGINT))) AS k FROM ch WHERE size > 500),
go AS (SELECT c, [0, -l_linenumber] AS turn, 0 AS part_no, chars + CASE WHEN row_number() OVER (PARTITION BY c ORDER BY l_linenumber) = 1 THEN 0 ELSE 2 END AS frees FROM nb
  UNION ALL SELECT c, [1, l_linenumber, -place], 1, chars + CASE WHEN row_number() OVER (PARTITION BY c, l_linenumber ORDER BY place) = 1 THEN 0 ELSE 2 END FROM nd
  UNION ALL SELECT c, [2, -(size - 500 * k), l_linenumber], 2, 500 + ((size - 500 * k) // (length(p_name) + 1)) - ((size - 500 * (k + 1)) // (length(p_name) + 1))
    + CASE WHEN k = 0 AND l_linenumber % 2 <> 0 THEN 1 ELSE 0 END FROM cuts),
gone AS (SELECT * FROM (SELECT c, part_no, frees, coalesce(sum(frees) OVER (PARTITION BY c ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM go) JOIN tot USING (c) WHERE total - earlier > {LIMIT})
SELECT c AS "case", CAST(total - coalesce(sum(frees), 0) AS BIGINT) AS serialized_chars FROM tot LEFT JOIN (SELECT c, frees FROM gone) USING (c) GROUP BY c, total""")
def context_sizes(spark, d):
    """Characters of each order's context after it was cut to the budget."""
    return _context(Graph(spark, d))["cases"]


@_query()
def context_sources(spark, d):
    """The changed sources as they fit the budget."""
    return _context(Graph(spark, d))["changed"].select("case", "ord", "qname", F.length("source").alias("n_chars"), "truncated")


def _cases(g: Graph) -> DataFrame:
    """Orders as records of cases, of which many break a rule."""
    ranges = "map_from_entries(IF(ok % 5 = 0, array(), array(struct(file, array(array(IF(ok % 11 = 0, end_line + 1, start_line), end_line))))))"
    record = f"""to_json(named_struct('id', IF(ok % 7 = 0, '', concat('c', ok)), 'changed_symbols', IF(ok % 3 = 0, array(), array(qname)),
        'changed_ranges', {ranges}, 'gold_files', IF(ok % 13 = 0, array(), array(file))))"""
    return g.orders().selectExpr("ok AS position", f"{record} AS record")


_BROKEN = """+ o AS (SELECT *, CASE WHEN ok % 7 = 0 THEN '' ELSE 'c' || ok END AS id, CASE WHEN ok % 5 <> 0 AND ok % 11 = 0 THEN 1 WHEN ok % 7 = 0 THEN 2 WHEN ok % 13 = 0 THEN 3
  WHEN ok % 3 = 0 AND ok % 5 = 0 THEN 4 ELSE 0 END AS bad FROM ords) """


@_query(_BROKEN + """SELECT ok AS position, CASE bad WHEN 1 THEN 'case ' || id || ' has invalid line range' WHEN 2 THEN 'case ' || ok || ' requires a non-empty id'
WHEN 3 THEN 'case ' || id || ' has invalid symbols or gold_files' ELSE 'case ' || id || ' requires changed_symbols or changed_ranges' END AS reason FROM o WHERE bad > 0""")
def case_problems(spark, d):
    """The records that are no benchmark cases, and the rule that each breaks first."""
    return records.checked_cases(_cases(Graph(spark, d)))[1].select("position", "reason")


@_query(_BROKEN + """SELECT id AS case_id, CASE WHEN ok % 3 = 0 THEN '' ELSE qname END AS symbols, CASE WHEN ok % 5 = 0 THEN '' ELSE file || ':' || start_line || '-' || end_line END AS ranges, file AS gold_files FROM o WHERE bad = 0""")
def case_records(spark, d):
    good = records.checked_cases(_cases(Graph(spark, d)))[0]
    lines = F.transform(F.map_entries("ranges"), lambda e: F.concat(e["key"], F.lit(":"), e["value"][0][0].cast("string"), F.lit("-"), e["value"][0][1].cast("string")))
    return good.select("case_id", F.array_join("symbols", ",").alias("symbols"), F.array_join(lines, ",").alias("ranges"), F.array_join("gold_files", ",").alias("gold_files"))
