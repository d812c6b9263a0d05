"""All queries of the code-graph library over the star-schema projection, with their oracle SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import module, short
from codeloom.operators import changes, community, evaluate, flows, graph, impact, reach, resolve, search
from codeloom.operators.sizes import spread
from codeloom.sources.starschema import SQL, Graph, table
from codeloom.streaming import follow, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NAMES, DECORATORS = ["o*7", "C*77", "main"], ["1-*"]
#: Semantic edges of rule R1 are followed, those of R2 are not.
RULES = {"R1": True, "R2": False}
_NAMED = "(regexp_full_match(regexp_extract(qname, '([^.:]*)$', 1), 'o.*7|C.*77|main') OR len(list_filter(decorators, lambda d: d LIKE '1-%')) > 0)"
_REACH = (
    "reach AS (SELECT qname AS entry, qname AS node FROM entries UNION SELECT r.entry, c.target FROM reach r JOIN rcalls c ON c.source = r.node)"
)
_FLOWS = f"""rcalls AS (SELECT DISTINCT source, target FROM calls WHERE resolution = 'resolved' OR (resolution = 'semantic' AND rule_id = 'R1')),
entries AS (SELECT qname, CAST({_NAMED} AS INTEGER) AS named FROM nodes n WHERE kind IN ('function', 'method')
  AND ({_NAMED} OR NOT EXISTS (SELECT 1 FROM rcalls c WHERE c.target = n.qname))), {_REACH}"""


def _query(sql: str | None = None, graph_sql: bool = True, recursive: bool = False):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            with_ = f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}" if graph_sql else ""
            ORACLE_SQL[f.__name__] = f"{with_} {sql.lstrip().removeprefix('+')}"
        return f
    return keep


_ASKED = "kind = 'function' OR id BETWEEN 4000000000000 AND 4999999999999"


def _symbols(g: Graph) -> DataFrame:
    """The symbols asked about: all parts and suppliers."""
    return g.nodes(False).where(_ASKED).select("qname")


def _marks(g: Graph, tests: str) -> DataFrame:
    """node, asked, kept: whether a node is asked about, and whether the test filter keeps it."""
    return g.nodes(False).select(F.col("qname").alias("node"), F.expr(f"CAST({_ASKED} AS INT) AS asked"), F.col("is_test").isin(impact.TESTS[tests]).cast("int").alias("kept"))


_SYM = "syms AS (SELECT qname FROM nodes WHERE kind = 'function' OR id BETWEEN 4000000000000 AND 4999999999999)"


def _flows(g: Graph, about: DataFrame | None = None) -> DataFrame:
    nodes, calls = g.nodes(False), flows.saved(g.calls())
    return flows.build_flows(flows.entry_nodes(nodes, calls, NAMES, DECORATORS, RULES), calls, rules=RULES, about=about)


# graph


@_query("SELECT id, qname, kind, file, start_line, end_line, signature, is_test FROM nodes")
def graph_nodes(spark, d):
    return Graph(spark, d).nodes().select("id", "qname", "kind", "file", "start_line", "end_line", "signature", "is_test")


@_query("SELECT source, target, kind, resolution, CAST(ord AS BIGINT) AS ord, rule_id FROM edges")
def graph_edges(spark, d):
    return Graph(spark, d).edges()


@_query("""+ r AS (SELECT DISTINCT source, target FROM calls WHERE resolution = 'resolved')
SELECT qname, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes
LEFT JOIN (SELECT target, count(*) AS n FROM r GROUP BY 1) i ON i.target = qname
LEFT JOIN (SELECT source, count(*) AS n FROM r GROUP BY 1) o ON o.source = qname""")
def degrees(spark, d):
    g = Graph(spark, d)
    return graph.degrees(g.calls(), g.nodes())


_NEIGHBORS = """+ d AS (SELECT source AS symbol, 'out' AS direction, target AS other, ord FROM {edges} WHERE resolution = 'resolved'
  UNION ALL SELECT target, 'in', source, ord FROM {edges} WHERE resolution = 'resolved'),
f AS (SELECT symbol, direction, other, min(ord) AS ord FROM d WHERE other IN (SELECT qname FROM nodes) GROUP BY ALL),
r AS (SELECT symbol, direction, other, row_number() OVER (PARTITION BY symbol, direction ORDER BY ord, other) AS rank FROM f)
SELECT * FROM r WHERE rank <= {cap}"""


@_query(_NEIGHBORS.format(edges="calls", cap=20))
def neighbors_call_both(spark, d):
    g = Graph(spark, d)
    return graph.neighbors(g.calls(), g.nodes())


@_query(_NEIGHBORS.format(edges="edges", cap=20))
def neighbors_all(spark, d):
    g = Graph(spark, d)
    return graph.neighbors(g.edges(), g.nodes(), kind="all")


@_query(_NEIGHBORS.format(edges="calls", cap=3) + " AND direction = 'in' AND symbol IN (SELECT qname FROM nodes WHERE kind = 'function')")
def neighbors_topk(spark, d):
    g = Graph(spark, d)
    return graph.neighbors(g.calls(), g.nodes(), g.nodes().where("kind = 'function'"), direction="in", cap=3)


@_query("""+ p AS (SELECT DISTINCT source, target FROM calls WHERE resolution = 'resolved'),
s AS (SELECT source AS symbol, 'out' AS dir, target AS other FROM p UNION ALL SELECT target, 'in', source FROM p),
a AS (SELECT symbol, count(*) FILTER (dir = 'in') AS in_degree, count(*) FILTER (dir = 'out') AS out_degree,
  coalesce(string_agg(other, ',' ORDER BY other) FILTER (dir = 'in'), '') AS callers,
  coalesce(string_agg(other, ',' ORDER BY other) FILTER (dir = 'out'), '') AS callees FROM s GROUP BY 1)
SELECT qname, kind, file, start_line, signature, in_degree, out_degree, callers, callees FROM nodes JOIN a ON qname = symbol""")
def symbol_detail(spark, d):
    g = Graph(spark, d)
    return graph.symbol_detail(g.calls(), g.nodes())


@_query("""+ e AS (SELECT source AS symbol, kind, resolution FROM edges UNION ALL SELECT target, kind, resolution FROM edges WHERE source <> target)
SELECT symbol, count(*) FILTER (kind = 'call' AND resolution = 'resolved') AS resolved_edges, count(*) FILTER (kind = 'call' AND resolution = 'semantic') AS semantic_edges,
  count(*) FILTER (kind = 'call' AND resolution = 'candidate') AS candidate_edges, count(*) FILTER (kind = 'call' AND resolution = 'dynamic') AS dynamic_edges,
  count(*) FILTER (kind = 'call' AND resolution = 'unresolved') AS unresolved_edges, CAST(count(*) FILTER (resolution <> 'resolved') >= 20 AS INTEGER) AS truncated FROM e GROUP BY 1""")
def coverage_by_resolution(spark, d):
    return graph.coverage(Graph(spark, d).edges())


@_query("""SELECT count(*) AS calls, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution = 'dynamic') AS dynamic,
count(*) FILTER (resolution = 'unresolved') AS unresolved, count(*) FILTER (resolution = 'candidate') AS candidate,
CAST(count(*) FILTER (resolution = 'resolved') AS DOUBLE) / count(*) AS rate FROM calls""")
def resolution_rate(spark, d):
    return graph.resolution_rate(Graph(spark, d).calls())


@_query("""+ e AS (SELECT source AS symbol, source, target, resolution, rule_id, ord FROM edges WHERE resolution <> 'resolved'
  UNION ALL SELECT target, source, target, resolution, rule_id, ord FROM edges WHERE resolution <> 'resolved' AND source <> target),
r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY CASE resolution WHEN 'dynamic' THEN 0 WHEN 'candidate' THEN 1 WHEN 'unresolved' THEN 2
  WHEN 'external' THEN 3 ELSE 4 END, source, ord, target) AS rank, source, target AS expression, resolution, rule_id, CASE resolution
  WHEN 'dynamic' THEN 'receiver type not statically known' WHEN 'unresolved' THEN 'target not found in repo' WHEN 'candidate' THEN 'one of several possible targets'
  WHEN 'external' THEN 'external dependency' ELSE 'uncertain edge' END AS reason, count(*) OVER (PARTITION BY symbol) AS n FROM e)
SELECT * EXCLUDE (n), CAST(n >= 20 AS INTEGER) AS truncated FROM r WHERE rank <= 20""")
def uncertainty_topk(spark, d):
    return graph.uncertainty(Graph(spark, d).edges())


@_query("""SELECT e.qname, kind, degree FROM (SELECT q AS qname, count(*) AS degree FROM
(SELECT source AS q FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) GROUP BY 1) e
JOIN nodes USING (qname) ORDER BY degree DESC, qname LIMIT 50""")
def export_topk_degree(spark, d):
    g = Graph(spark, d)
    return graph.top_degree(g.edges(), g.nodes())


@_query("""+ top AS (SELECT qname FROM (SELECT q AS qname, count(*) AS degree FROM
(SELECT source AS q FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) GROUP BY 1) JOIN nodes USING (qname)
ORDER BY degree DESC, qname LIMIT 50)
SELECT source, target, kind, count(*) AS n FROM edges WHERE source IN (FROM top) AND target IN (FROM top) GROUP BY ALL""")
def export_edges_within(spark, d):
    g = Graph(spark, d)
    return graph.edges_within(g.edges(), graph.top_degree(g.edges(), g.nodes()))


@_query("SELECT source, target, kind FROM contains_")
def contains_edges(spark, d):
    return Graph(spark, d).contains().select("source", "target", "kind")


@_query("SELECT source, target, kind FROM imports")
def import_edges(spark, d):
    return Graph(spark, d).imports().select("source", "target", "kind")


@_query("SELECT source, target, kind FROM extends_")
def inherit_edges(spark, d):
    return Graph(spark, d).extends().select("source", "target", "kind")


# flows


@_query(f"+ {_FLOWS} SELECT qname, named FROM entries", recursive=True)
def entry_nodes(spark, d):
    g = Graph(spark, d)
    return flows.entry_nodes(g.nodes(), g.calls(), NAMES, DECORATORS, RULES)


@_query(f"+ {_FLOWS} SELECT entry, node FROM reach", recursive=True)
def flow_reachability(spark, d):
    return _flows(Graph(spark, d)).select("entry", "node")


@_query()
def flow_membership_positions(spark, d):
    return _flows(Graph(spark, d))


@_query(f"""+ {_FLOWS} SELECT entry, count(*) AS node_count, count(DISTINCT file) AS file_count
FROM reach JOIN nodes ON qname = node GROUP BY 1""", recursive=True)
def flow_stats(spark, d):
    g = Graph(spark, d)
    nodes = g.nodes(False)
    return flows.flow_stats(_flows(g, nodes.select(F.col("qname").alias("node"), "file")), nodes)


@_query()
def flow_slices_up_down(spark, d):
    g = Graph(spark, d)
    return flows.slices(_flows(g, _marks(g, "include")), None, F.lit(True))


@_query(f"""+ {_FLOWS} SELECT DISTINCT n.qname, n.file FROM entries JOIN nodes n USING (qname) WHERE n.is_test = 0""", recursive=True)
def entry_points(spark, d):
    g = Graph(spark, d)
    e = flows.entry_nodes(g.nodes(), g.calls(), NAMES, DECORATORS, RULES)
    return g.nodes().where("is_test = 0").join(e.select("qname"), "qname", "left_semi").select("qname", "file")


# impact

_DIRECT = """p AS (SELECT DISTINCT source, target FROM calls WHERE resolution = 'resolved'),
dir AS (SELECT source AS symbol, 'out' AS direction, target AS other FROM p UNION ALL SELECT target, 'in', source FROM p),
direct AS (SELECT symbol, direction, other, row_number() OVER (PARTITION BY symbol, direction ORDER BY other) AS rank FROM dir
  WHERE symbol IN (FROM syms) AND other IN (SELECT qname FROM nodes WHERE is_test IN ({tests})))"""


@_query(f"+ {_SYM}, {_DIRECT.format(tests='0')} SELECT * FROM direct WHERE rank <= 20")
def impact_direct(spark, d):
    g = Graph(spark, d)
    return impact.direct_impact(g.calls(), g.nodes(), _symbols(g))


@_query(f"+ {_SYM}, {_DIRECT.format(tests='1')} SELECT * FROM direct WHERE rank <= 20")
def impact_tests_only(spark, d):
    g = Graph(spark, d)
    return impact.direct_impact(g.calls(), g.nodes(), _symbols(g), tests="only")


@_query()
def impact_full(spark, d):
    g = Graph(spark, d)
    nodes, calls = g.nodes(False), flows.saved(g.calls())
    direct = impact.direct_impact(calls, nodes, _symbols(g))
    marks = _marks(g, "exclude")
    f, rows = flows.sized_flows(flows.entry_nodes(nodes, calls, NAMES, DECORATORS, RULES), flows.saved(flows.adjacency(calls, RULES)), about=marks)
    if marks.where("asked = 1 AND kept = 0").isEmpty():
        # a row has up to 40 neighbours; fewer in a short flow
        return impact.impact_near(flows.nearby(f, None, F.col("kept") == 1), direct, 40 * rows)
    return impact.impact(flows.slices(f, None, F.col("kept") == 1), direct)


@_query(f"""+ {_FLOWS}, {_SYM} SELECT DISTINCT node AS symbol, entry FROM reach
WHERE node IN (FROM syms) AND entry IN (SELECT qname FROM nodes WHERE is_test = 0)""", recursive=True)
def impact_entries(spark, d):
    g = Graph(spark, d)
    nodes, calls = g.nodes(False), flows.saved(g.calls())
    entries = flows.entry_nodes(nodes, calls, NAMES, DECORATORS, RULES).join(nodes.where("is_test = 0").select("qname"), "qname", "left_semi")
    return reach.entries_of(calls, _symbols(g), entries, RULES)


def _covers(g: Graph, calls: DataFrame | None = None, by: str = "test") -> DataFrame:
    n, calls = g.nodes(False), flows.saved(g.calls()) if calls is None else calls
    entries = flows.entry_nodes(n, calls, NAMES, DECORATORS, RULES)
    # a flow without a test covers nothing
    f = flows.saved(reach.flows_to(calls, entries, n.where("is_test = 1").select(F.col("qname").alias("node")), RULES, _marks(g, "only")))
    tests = f.where("position = 0 AND kept = 1").select("entry")
    hits = f.where("asked = 1").select("entry", F.col("node").alias("symbol")).join(tests, "entry", "left_semi")
    # all three hold tests alone
    return impact.covers(hits, impact.direct_impact(calls, n, _symbols(g), tests="only"), flows.slices(f, None, F.col("kept") == 1), None, by)


@_query()
def test_impact(spark, d):
    g = Graph(spark, d)
    return impact.test_impact(_covers(g), g.nodes(False))


@_query()
def test_impact_flags(spark, d):
    g = Graph(spark, d)
    asked, calls = _symbols(g).union(spark.createDataFrame([("no::such",)], "qname string")), flows.saved(g.calls())
    return impact.test_impact_flags(asked, g.nodes(False), _covers(g, calls, "symbol"), g.edges(calls))


_DEAD = f"""called AS (SELECT DISTINCT target FROM calls WHERE resolution = 'resolved'), declared AS (SELECT qname, file FROM nodes WHERE {_NAMED}),
dead AS (SELECT qname, kind, file, start_line, signature, decorators FROM nodes WHERE kind IN ('function', 'method', 'class') AND is_test = 0
  AND qname NOT IN (FROM called) AND qname NOT IN (SELECT qname FROM declared)),
files AS (SELECT m.file, m.qname, coalesce(k.n, 0) AS symbol_count FROM nodes m LEFT JOIN (SELECT file, count(*) AS n FROM dead GROUP BY 1) k USING (file)
  WHERE m.kind = 'module' AND m.file NOT ILIKE '%__init__.py' AND m.qname NOT IN (SELECT target FROM imports)
  AND m.file NOT IN (SELECT file FROM nodes WHERE is_test = 1 UNION SELECT file FROM declared))"""


def _dead(g: Graph) -> tuple[DataFrame, DataFrame]:
    n, entry = g.nodes(), flows.is_entry(NAMES, DECORATORS)
    dead = impact.dead_symbols(n, graph.degrees(g.calls(), n), entry)
    return dead, impact.dead_files(n, g.imports(), entry, dead)


@_query(f"+ {_DEAD} SELECT qname, kind, file, start_line, signature, array_to_string(decorators, ',') AS decorators FROM dead")
def dead_symbols(spark, d):
    return _dead(Graph(spark, d))[0].withColumn("decorators", F.concat_ws(",", "decorators"))


@_query(f"+ {_DEAD} SELECT * FROM files")
def dead_files(spark, d):
    return _dead(Graph(spark, d))[1]


@_query(f"+ {_DEAD} SELECT (SELECT count(*) FROM dead) AS symbol_count, (SELECT count(*) FROM files) AS file_count")
def dead_report(spark, d):
    return impact.dead_report(*_dead(Graph(spark, d)))


_RISK = """p AS (SELECT DISTINCT source, target FROM calls WHERE resolution = 'resolved'),
c AS (SELECT t.qname, count(*) FILTER (s.file <> t.file) AS cross_callers, count(*) FILTER (s.file = t.file) AS same_callers FROM nodes t
  LEFT JOIN p ON p.target = t.qname LEFT JOIN nodes s ON s.qname = p.source AND s.is_test = 0 WHERE t.kind IN ('function', 'method', 'class') GROUP BY 1),
risks AS (SELECT *, CAST(CASE WHEN cross_callers > 0 THEN least(100, 60 + 10 * cross_callers) WHEN same_callers > 0 THEN least(59, 30 + 5 * same_callers)
  ELSE 10 END AS BIGINT) AS risk FROM c)"""


@_query(f"+ {_RISK} SELECT * FROM risks")
def risk_scores(spark, d):
    g = Graph(spark, d)
    return impact.risk_scores(g.calls(), g.nodes())


# changes

_OVERLAP = """ov AS (SELECT h.file, h.start, h.count, n.qname FROM hunks h JOIN nodes n ON n.file = h.file AND n.kind IN ('function', 'method')
AND n.start_line <= h.start + h.count - 1 AND n.end_line >= h.start)"""


@_query(f"+ {_OVERLAP} SELECT DISTINCT * FROM ov")
def hunk_symbol_overlap(spark, d):
    g = Graph(spark, d)
    return changes.hunk_overlaps(g.hunks(), g.nodes())


_COVER = """cov AS (SELECT DISTINCT h.file, h.start, h.count, n.qname FROM hunks h JOIN nodes n ON n.file = h.file AND n.kind IN ('function', 'method', 'class')
AND n.start_line <= h.start + h.count - 1 AND n.end_line >= h.start)"""


@_query(f"+ {_COVER} SELECT file, start, count FROM hunks ANTI JOIN cov USING (file, start, count)")
def uncovered_hunks(spark, d):
    g = Graph(spark, d)
    return changes.uncovered_hunks(g.hunks(), g.nodes())


@_query(f"+ {_OVERLAP} SELECT qname, file, count(*) AS n_hunks FROM (SELECT DISTINCT * FROM ov) GROUP BY 1, 2")
def changed_symbols(spark, d):
    g = Graph(spark, d)
    return changes.changed_symbols(changes.hunk_overlaps(g.hunks(), g.nodes()))


@_query("""SELECT file, CAST(start_line AS BIGINT) AS start, CAST(greatest(CASE WHEN ok % 2 = 0 THEN 1 ELSE end_line - start_line END, 1) AS BIGINT) AS count FROM ords WHERE ok % 13 <> 0""")
def diff_text_parse(spark, d):
    o = Graph(spark, d).orders()
    target = F.when(F.col("ok") % 13 == 0, "/dev/null").otherwise(F.concat(F.lit("b/"), F.col("file")))
    tail = F.when(F.col("ok") % 2 == 0, "").otherwise(F.concat(F.lit(","), F.col("end_line") - F.col("start_line")))
    lines = F.array(F.concat(F.lit("+++ "), target), F.concat(F.lit("@@ -1 +"), F.col("start_line"), tail, F.lit(" @@")), F.lit("+x"))
    return changes.parse_diff(o.select(F.col("ok").alias("diff_id"), F.posexplode(lines).alias("line_no", "line")))


_STONES = """stones AS (SELECT l_orderkey * 100 + l_linenumber AS id, o.file, o.qname, o.start_line FROM lineitem JOIN ords o ON ok = l_orderkey WHERE l_quantity > 40),
gone AS (SELECT file, qname, max(id) AS id, arg_max(start_line, id) AS start_line, 90 AS risk FROM stones
  WHERE qname NOT IN (SELECT qname FROM ords WHERE o_orderstatus <> 'F') AND file IN (SELECT file FROM deleted_files UNION SELECT file FROM numstat WHERE removed > 0) GROUP BY 1, 2)"""
_CHANGE = f"""{_COVER}, {_RISK}, {_STONES}, live AS (SELECT * FROM hunks WHERE file NOT IN (FROM deleted_files)),
fn AS (SELECT n.qname, n.kind, n.file, n.start_line, n.end_line, coalesce(r.risk, 50) AS risk FROM nodes n LEFT JOIN risks r USING (qname)
  WHERE n.qname IN (SELECT qname FROM cov WHERE file NOT IN (FROM deleted_files))),
told AS (SELECT DISTINCT file FROM gone),
unc AS (SELECT file, start, count, 0 AS deleted FROM live ANTI JOIN cov USING (file, start, count)
  UNION ALL SELECT file, NULL, NULL, CAST(file IN (FROM deleted_files) AS INTEGER) FROM (SELECT file FROM numstat UNION SELECT file FROM hunks)
  WHERE file NOT IN (FROM told) AND (file IN (FROM deleted_files) OR file NOT IN (SELECT file FROM hunks)))"""


def _deletions(g: Graph) -> DataFrame:
    o = g.orders()
    stones = g.t("lineitem").where("l_quantity > 40").join(o, F.col("ok") == F.col("l_orderkey")).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), "file", "qname", "start_line"
    )
    return changes.deleted_symbols(changes.deletion_candidates(stones, g.numstat(), g.deleted_files()), o.where("o_orderstatus <> 'F'"))


def _functions(g: Graph) -> DataFrame:
    return changes.changed_functions(g.hunks(), g.deleted_files(), g.nodes(), impact.risk_scores(g.calls(), g.nodes()))


def _uncovered(g: Graph) -> DataFrame:
    return changes.uncovered_changes(g.hunks(), g.numstat(), g.deleted_files(), g.nodes(), _deletions(g))


@_query(f"+ {_CHANGE} SELECT * FROM fn")
def change_functions(spark, d):
    return _functions(Graph(spark, d))


@_query(f"+ {_CHANGE} SELECT file, CAST(start AS BIGINT) AS start, CAST(count AS BIGINT) AS count, deleted FROM unc")
def change_uncovered(spark, d):
    return _uncovered(Graph(spark, d))


@_query(f"""+ {_CHANGE} SELECT (SELECT count(*) FROM numstat) AS files_changed, (SELECT CAST(sum(added) AS BIGINT) FROM numstat) AS lines_added, (SELECT CAST(sum(removed) AS BIGINT) FROM numstat) AS lines_removed,
(SELECT count(*) FROM fn) AS changed_functions, (SELECT count(DISTINCT file) FROM unc) AS uncovered_changes, (SELECT count(*) FROM gone) AS delete_change""")
def change_summary_totals(spark, d):
    g = Graph(spark, d)
    lines = g.numstat().select(F.concat_ws("\t", F.when(F.col("file").startswith("src/parts"), "-").otherwise(F.col("added").cast("string")),
                                           F.when(F.col("file").startswith("src/parts"), "-").otherwise(F.col("removed").cast("string")), "file").alias("line"))
    return changes.change_summary(changes.parse_numstat(lines), _functions(g), _uncovered(g), _deletions(g))


@_query(f"+ {_STONES} SELECT * FROM gone")
def delete_change_latest(spark, d):
    return _deletions(Graph(spark, d))


def _manifests(g: Graph) -> tuple[DataFrame, DataFrame]:
    o = g.t("orders")
    key = F.col("o_orderkey")
    path, text = F.concat(F.lit("f"), key).alias("path"), key.cast("string")
    old = o.where("o_orderstatus <> 'P'").select(path, key.cast("double").alias("stamp"), F.lit(9).alias("size"), F.sha2(text, 256).alias("hash"))
    stamp = (key + F.when(key % 3 == 0, 1).otherwise(0)).cast("double").alias("stamp")
    size = F.when(key % 11 == 0, 10).otherwise(9).alias("size")
    new = o.where("o_orderkey % 50 <> 0").select(path, stamp, size, F.sha2(F.when(key % 7 == 0, F.concat(text, F.lit("x"))).otherwise(text), 256).alias("hash"))
    return old, new


@_query("""SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'added' WHEN o_orderkey % 50 = 0 THEN 'deleted' ELSE 'changed' END AS status
FROM orders WHERE (o_orderstatus = 'P' AND o_orderkey % 50 <> 0) OR (o_orderstatus <> 'P' AND o_orderkey % 50 = 0)
OR (o_orderstatus <> 'P' AND o_orderkey % 50 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 11 = 0) AND o_orderkey % 7 = 0)""", graph_sql=False)
def manifest_diff(spark, d):
    return changes.manifest_diff(*_manifests(Graph(spark, d)))


@_query("""SELECT source, target, CAST(ord AS BIGINT) AS ord, CASE WHEN resolution IN ('resolved', 'unresolved')
THEN CASE WHEN target IN (SELECT qname FROM parts WHERE pk % 11 <> 0) THEN 'resolved' ELSE 'unresolved' END ELSE resolution END AS resolution FROM calls""")
def repair_resolutions(spark, d):
    g = Graph(spark, d)
    return changes.repair_resolutions(g.calls(), g.parts().where("pk % 11 <> 0")).select("source", "target", "ord", "resolution")


@_query("""SELECT qname, kind, file, signature FROM nodes WHERE NOT (kind = 'function' AND id % 10 = 3)""")
def delta_apply_equals_rebuild(spark, d):
    nodes = Graph(spark, d).nodes()
    after = nodes.where("NOT (kind = 'function' AND id % 10 = 3)")
    before = nodes.where("NOT (kind = 'function' AND id % 10 = 4)")
    touched = nodes.where("kind = 'function'").select("file").distinct()
    fresh = after.join(touched, "file", "left_semi").drop("id")
    return changes.apply_delta(before, touched, fresh).select("qname", "kind", "file", "signature")


@_query("""+ gone AS (SELECT qname, file FROM nodes WHERE id >= 6000000000000 AND id % 10 = 3),
up AS (SELECT DISTINCT target AS qname, source FROM edges WHERE kind IN ('call', 'import', 'extends') AND target IN (SELECT qname FROM gone) AND source NOT IN (SELECT qname FROM gone))
SELECT g.qname, g.file, count(source) AS n_upstream, coalesce(string_agg(source, ',' ORDER BY source), '') AS upstream FROM gone g LEFT JOIN up USING (qname) GROUP BY 1, 2""")
def tombstone_upstream(spark, d):
    g = Graph(spark, d)
    n = g.nodes()
    return changes.tombstones(n, n.where("NOT (id >= 6000000000000 AND id % 10 = 3)"), g.edges())


# resolution


@_query("""+ s AS (SELECT DISTINCT source, 'call' || (l_linenumber % 2) AS expr, p.qname AS target FROM lineitem JOIN (SELECT ok, qname AS source FROM ords) ON ok = l_orderkey JOIN parts p ON pk = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY source, expr ORDER BY target) AS rank, count(*) OVER (PARTITION BY source, expr) AS n FROM s)
SELECT source, expr, substr(sha1(source || chr(0) || expr), 1, 12) AS site_id, rank, target, CAST(n > 3 AS INTEGER) AS truncated FROM r WHERE rank <= 3""")
def candidates_fanout(spark, d):
    g = Graph(spark, d)
    sites = g.t("lineitem").join(g.orders().selectExpr("ok", "qname AS source"), F.col("ok") == F.col("l_orderkey")).join(
        g.parts().selectExpr("pk", "qname AS target"), F.col("pk") == F.col("l_partkey")
    ).select("source", F.concat(F.lit("call"), F.col("l_linenumber") % 2).alias("expr"), "target")
    return resolve.candidate_fanout(sites, 3)


@_query("""+ b AS (SELECT ck AS src, ck // 10 AS dst FROM customers WHERE ck > 0 AND ck % 7 <> 0),
w AS (SELECT ck AS key, ck AS node FROM customers UNION SELECT w.key, b.dst FROM w JOIN b ON b.src = w.node WHERE w.node % 7 <> 0),
h AS (SELECT key, count(*) AS n, min(node) AS node FROM w WHERE node % 7 = 0 GROUP BY 1)
SELECT c.ck AS key, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'candidate' END AS resolution, CASE WHEN n = 1 THEN node END AS target
FROM (SELECT ck FROM customers) c LEFT JOIN h ON h.key = c.ck""", recursive=True)
def reexport_closure(spark, d):
    c = Graph(spark, d).customers().select("ck")
    asks = c.selectExpr("ck AS key", "ck AS node")
    steps = c.where("ck > 0 AND ck % 7 <> 0").selectExpr("ck AS src", "CAST(floor(ck / 10) AS BIGINT) AS dst")
    return resolve.resolve_reexports(asks, steps, c.where("ck % 7 = 0").selectExpr("ck AS node"))


@_query("""+ def AS (SELECT qname FROM customers WHERE ck % 5 = 0),
w AS (SELECT qname AS call, target AS node, 1 AS depth FROM customers JOIN extends_ ON source = qname
  UNION SELECT w.call, e.target, depth + 1 FROM w JOIN extends_ e ON e.source = w.node WHERE w.node NOT IN (FROM def))
SELECT call, node AS owner, min(depth) AS depth FROM w WHERE node IN (FROM def) GROUP BY 1, 2""", recursive=True)
def ancestor_method_lookup(spark, d):
    g = Graph(spark, d)
    c = g.customers()
    calls = c.select(F.col("qname").alias("call"), F.col("qname").alias("cls"), F.lit("run").alias("name"))
    members = c.where("ck % 5 = 0").select(F.col("qname").alias("owner"), F.lit("run").alias("name"))
    return resolve.ancestor_members(calls, g.extends(), members).select("call", "owner", "depth")


@_query("SELECT o.qname, o.parent AS match FROM ords o UNION ALL SELECT qname, 'parts' FROM parts")
def longest_prefix_class(spark, d):
    g = Graph(spark, d)
    names = g.orders().select("qname").union(g.parts().select("qname"))
    known = g.customers().select("qname").union(g.customers().selectExpr("substring_index(qname, '.', 1)")).union(
        g.parts().selectExpr("'parts' AS qname").distinct()
    ).toDF("known")
    return resolve.longest_prefix(names, known)


@_query("""+ r AS (SELECT qname AS controller, pk, CASE WHEN pk % 3 = 0 THEN 'ANY' ELSE 'GET' END AS m FROM parts),
q AS (SELECT qname AS test, ok // 4 AS k, CASE WHEN ok % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, CASE WHEN ok % 5 = 0 THEN '{v}' ELSE 'v' || ok % 4 END AS v FROM ords WHERE is_test = 1)
SELECT DISTINCT test, controller, CASE WHEN pk % 13 = 0 THEN 'unresolved' ELSE 'resolved' END AS resolution, 'JAVA-F01' AS rule_id
FROM q JOIN r ON q.k = r.pk AND (r.m = 'ANY' OR r.m = q.m) AND (pk % 2 = 1 OR v = 'v0' OR v = '{v}')""")
def route_match(spark, d):
    g = Graph(spark, d)
    routes = g.parts().select(
        F.col("qname").alias("controller"), F.when(F.col("pk") % 3 == 0, "ANY").otherwise("GET").alias("method"),
        F.when(F.col("pk") % 2 == 1, F.concat(F.lit("/api//p"), F.col("pk"), F.lit("/{id}/"))).otherwise(F.concat(F.lit("/{any}/p"), F.col("pk"), F.lit("/v0"))).alias("path"),
    )
    last = F.when(F.col("ok") % 5 == 0, "{v}").otherwise(F.concat(F.lit("v"), F.col("ok") % 4))
    asks = g.orders().where("is_test = 1").select(
        F.col("qname").alias("test"), F.when(F.col("ok") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/p"), F.floor(F.col("ok") / 4), F.lit("/"), last, F.when(F.col("ok") % 3 == 0, "?x=/1/2").otherwise("#top")).alias("path"),
    )
    return resolve.match_routes(asks, routes, g.parts().where("pk % 13 <> 0"))


# communities

_UND = """und AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS weight FROM calls
WHERE resolution = 'resolved' AND source <> target GROUP BY 1, 2)"""
_SIG = """pr AS (SELECT DISTINCT source, target FROM calls WHERE resolution = 'resolved' AND source <> target),
i AS (SELECT target AS qname, count(*) AS n_in, count(*) FILTER (split_part(source, '::', 1) = split_part(target, '::', 1)) AS own FROM pr GROUP BY 1),
o AS (SELECT source AS qname, count(*) AS n_out FROM pr GROUP BY 1),
sig AS (SELECT qname, n_in, coalesce(n_out, 0) AS n_out, CAST(n_in - coalesce(n_out, 0) AS DOUBLE) / (n_in + coalesce(n_out, 0)) AS sinkness,
  1 - CAST(own AS DOUBLE) / n_in AS spread FROM i LEFT JOIN o USING (qname) WHERE n_in > coalesce(n_out, 0))"""


@_query(f"+ {_UND} SELECT * FROM und")
def undirected_adjacency(spark, d):
    g = Graph(spark, d)
    return community.undirected(g.calls(), g.nodes())


@_query(f"+ {_SIG} SELECT * FROM sig")
def sink_signals(spark, d):
    return community.sink_signals(Graph(spark, d).calls())


@_query(f"""+ {_UND}, {_SIG}, f AS (SELECT qname, greatest(1 - 0.5::DOUBLE * sinkness * spread, 0.1::DOUBLE) AS f FROM sig)
SELECT a, b, CAST(round(weight * coalesce(x.f, 1) * coalesce(y.f, 1), 6) AS DECIMAL(18, 6)) AS weight FROM und LEFT JOIN f x ON x.qname = a LEFT JOIN f y ON y.qname = b""")
def damped_weights(spark, d):
    g = Graph(spark, d)
    w = community.damped(community.undirected(g.calls(), g.nodes()), community.sink_signals(g.calls()))
    return w.select("a", "b", F.round("weight", 6).cast("decimal(18,6)").alias("weight"))


@_query(f"""+ {_UND}, {_SIG}, hub AS (SELECT qname FROM sig WHERE n_in >= 3 AND spread > 0.5)
SELECT a, b, weight FROM und WHERE split_part(a, '::', 1) = split_part(b, '::', 1) OR (a NOT IN (FROM hub) AND b NOT IN (FROM hub))""")
def hub_pruned_edges(spark, d):
    g = Graph(spark, d)
    return community.hub_pruned(community.undirected(g.calls(), g.nodes()), community.sink_signals(g.calls()))


def _weights(g: Graph) -> DataFrame:
    return community.undirected(g.calls(), g.nodes())


@_query()
def community_components(spark, d):
    return community.components(_weights(Graph(spark, d)))


@_query(f"""+ {_UND}, pg AS (SELECT a, b, weight FROM und UNION ALL SELECT b, a, weight FROM und), l0 AS (SELECT DISTINCT a AS q, a AS c FROM pg),
v1 AS (SELECT pg.a, c, sum(weight) AS w FROM pg JOIN l0 ON q = b GROUP BY 1, 2), l1 AS (SELECT a AS q, arg_min(c, (-w, c)) AS c FROM v1 GROUP BY 1),
v2 AS (SELECT pg.a, c, sum(weight) AS w FROM pg JOIN l1 ON q = b GROUP BY 1, 2), l2 AS (SELECT a AS q, arg_min(c, (-w, c)) AS c FROM v2 GROUP BY 1)
SELECT q AS qname, c AS community FROM l2""")
def community_lpa_k(spark, d):
    return community.label_propagation(_weights(Graph(spark, d)), 2)


def _modules(g: Graph) -> DataFrame:
    n = g.nodes().where("kind <> 'module'")
    return n.select("qname", module(F.col("qname")).alias("community"))


@_query("""+ m AS (SELECT qname, split_part(qname, '::', 1) AS c FROM nodes WHERE kind <> 'module')
SELECT least(a.c, b.c) AS community_a, greatest(a.c, b.c) AS community_b, count(*) AS weight FROM calls
JOIN m a ON a.qname = source JOIN m b ON b.qname = target WHERE resolution = 'resolved' AND a.c <> b.c GROUP BY 1, 2""")
def inter_community_edges(spark, d):
    g = Graph(spark, d)
    return community.between(g.calls(), _modules(g))


@_query()
def community_sizes(spark, d):
    return community.components(_weights(Graph(spark, d))).groupBy("community").agg(F.count("*").alias("node_count"))


@_query("""+ m AS (SELECT parent AS community, min(qname) AS lo, max(qname) AS hi, count(*) AS node_count FROM ords GROUP BY 1),
l AS (SELECT community, node_count, lo, lo[1:coalesce(list_max(list_filter(range(1, length(lo) + 1), lambda i: lo[1:i] = hi[1:i])), 0)] AS p FROM m),
c AS (SELECT community, node_count, lo, regexp_replace(regexp_replace(p, '[.:]+$', ''), '(\\.|::)[^.:]*$', '') AS p FROM l),
n AS (SELECT community, node_count, CASE WHEN p = '' THEN split_part(lo, '::', 1) ELSE regexp_replace(p, '(\\.|:)index$', '') END AS label FROM c),
f AS (SELECT label FROM n ORDER BY community LIMIT 1),
d AS (SELECT label[1:i] AS pre FROM f, range(1, (SELECT length(label) + 1 FROM f)) t(i) WHERE label[i] = '.'),
b AS (SELECT pre FROM d WHERE (SELECT count(*) FROM n WHERE starts_with(n.label, pre)) > 0.8 * (SELECT count(*) FROM n) ORDER BY length(pre) DESC LIMIT 1)
SELECT community, CASE WHEN starts_with(label, (FROM b)) THEN substr(label, (SELECT length(pre) + 1 FROM b)) ELSE label END AS label, node_count FROM n""")
def community_labels(spark, d):
    return community.labels(Graph(spark, d).orders().select("qname", F.col("parent").alias("community")))


@_query("""SELECT p_brand AS community, module AS label, count(*) AS node_count FROM parts GROUP BY 1, 2""")
def community_labels_plain(spark, d):
    """Communities whose labels share no dotted prefix that most have, but for that of a package: it goes."""
    parts = Graph(spark, d).parts()
    l = community.labels(parts.select("qname", F.col("p_brand").alias("community")))
    return l.withColumn("label", F.concat(F.lit("parts."), "label"))


# search

_BM25 = """SELECT {id} AS id, tok FROM (SELECT {id}, unnest(regexp_split_to_array(strip_accents(lower({text})), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {t}) WHERE tok <> ''"""


def _bm25_sql(first: str, second: str) -> str:
    return f"""WITH p AS ({_BM25.format(id='doc_id', text='text', t='documents')}),
l AS (SELECT id, count(*) AS len FROM p GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM p) / (SELECT count(*) FROM documents) AS avgdl),
h AS (SELECT id, 0 AS k, count(*) AS tf FROM p WHERE starts_with(tok, '{first}') GROUP BY 1 UNION ALL SELECT id, 1, count(*) FROM p WHERE starts_with(tok, '{second}') GROUP BY 1),
df AS (SELECT k, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT h.id, count(*) AS c, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM h JOIN df USING (k) JOIN l USING (id), st GROUP BY 1)
SELECT id, CAST(round(score, 6) AS DECIMAL(18, 6)) AS score FROM s WHERE c = 2"""


@_query(_bm25_sql("license", "version"), graph_sql=False)
def search_bm25(spark, d):
    r = search.bm25(table(spark, d, "documents"), "license version", "doc_id", ["text"])
    return r.select("id", F.round("score", 6).cast("decimal(18,6)").alias("score"))


@_query(_bm25_sql("that", "ing"), graph_sql=False)
def search_prefix_and(spark, d):
    r = search.bm25(table(spark, d, "documents"), "that ing", "doc_id", ["text"])
    return r.select("id", F.round("score", 6).cast("decimal(18,6)").alias("score"))


_SHOWN = "id, qname, kind, file, start_line, end_line, signature"


@_query(f"SELECT {_SHOWN} FROM nodes WHERE kind IN ('function', 'method', 'class') AND regexp_full_match(regexp_extract(qname, '([^.:]*)$', 1), 'p.*7')")
def search_glob(spark, d):
    return search.glob_search(Graph(spark, d).nodes(), "p*7")


@_query(f"""SELECT {_SHOWN} FROM nodes WHERE kind IN ('function', 'method', 'class')
AND contains(lower(concat_ws(' ', qname, file, signature, array_to_string(decorators, ' '), end_line)), 't-o 1')""")
def search_infix(spark, d):
    """The end of a decorator and the start of a line number: only the joined columns hold it."""
    return search.infix_search(Graph(spark, d).nodes(), "T-O 1")


@_query("""+ x AS (SELECT qname, concat_ws(' ', qname, file, signature, array_to_string(decorators, ' '), end_line) AS t FROM nodes WHERE kind IN ('function', 'method', 'class')),
p AS (SELECT qname, tok FROM (SELECT qname, unnest(regexp_split_to_array(strip_accents(lower(t)), '[^\\p{L}\\p{N}]+')) AS tok FROM x) WHERE tok <> ''),
l AS (SELECT qname, count(*) AS len, count(*) FILTER (starts_with(tok, 'urgent')) AS a, count(*) FILTER (starts_with(tok, 'r3')) AS b FROM p GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM l),
s AS (SELECT qname, -(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avgdl))
  + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM l, st WHERE a > 0 AND b > 0)
SELECT qname, kind, file, start_line, end_line, signature, CAST(round(score, 6) AS DECIMAL(18, 6)) AS score FROM s JOIN nodes USING (qname) ORDER BY s.score, qname LIMIT 30""")
def search_symbols(spark, d):
    return search.search(Graph(spark, d).nodes(), "Urgent r3").withColumn("score", F.round("score", 6).cast("decimal(18,6)"))


# evaluation


#: Golds of a task; each becomes several candidates.
GOLDS = 50_000


def _by_case(gold: DataFrame, g: Graph) -> DataFrame:
    return spread(gold, ["case_id"], g.t("lineitem").count(), GOLDS).distinct()


def _gold(g: Graph) -> DataFrame:
    return _by_case(g.t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("item")), g)


@_query("""WITH g AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS item, l_partkey % 7 AS bucket FROM lineitem),
n AS (SELECT case_id, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2),
cand AS (SELECT DISTINCT a.case_id, a.item AS seed, b.item FROM g a JOIN g b ON a.case_id = b.case_id AND a.item <> b.item AND abs(a.bucket - b.bucket) <= 3)
SELECT g.case_id, g.item AS seed, n - 1 AS n_gold, coalesce(h, 0) AS hits, CAST(coalesce(h, 0) AS DOUBLE) / (n - 1) AS recall,
CASE WHEN coalesce(h, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision FROM g JOIN n USING (case_id)
LEFT JOIN (SELECT case_id, seed, count(*) AS h FROM cand GROUP BY 1, 2) c ON c.case_id = g.case_id AND c.seed = g.item""", graph_sql=False)
def loo_symbol_folds(spark, d):
    gold = _gold(Graph(spark, d))
    a, b = gold.withColumnRenamed("item", "seed"), gold
    cand = a.join(b, "case_id").where("seed <> item AND abs(seed % 7 - item % 7) <= 3")
    return evaluate.fold_scores(gold, cand, "item")


_FILE_FOLDS = """g AS (SELECT DISTINCT l_orderkey AS case_id, file FROM lineitem JOIN parts ON pk = l_partkey),
n AS (SELECT case_id, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2),
cand AS (SELECT DISTINCT g.case_id, g.file AS seed, s.file FROM g, LATERAL (SELECT 'src/parts/b' || ((CAST(regexp_extract(g.file, 'b([0-9]+)', 1) AS INTEGER) + k) % 25 + 1) || '.py' AS file FROM range(0, 6) r(k)) s WHERE s.file <> g.file),
folds AS (SELECT g.case_id, g.file AS seed, n - 1 AS n_gold, count(g2.file) AS hits, CAST(count(g2.file) AS DOUBLE) / (n - 1) AS recall, CAST(count(g2.file) AS DOUBLE) / count(c.file) AS precision
FROM g JOIN n USING (case_id) JOIN cand c ON c.case_id = g.case_id AND c.seed = g.file LEFT JOIN g g2 ON g2.case_id = c.case_id AND g2.file = c.file GROUP BY g.case_id, g.file, n)"""


def _file_folds(g: Graph) -> DataFrame:
    gold = _by_case(g.t("lineitem").join(g.parts().select("pk", "file"), F.col("pk") == F.col("l_partkey")).select(F.col("l_orderkey").alias("case_id"), "file"), g)
    num = F.regexp_extract("seed", "b([0-9]+)", 1).cast("int")
    near = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("src/parts/b"), (num + k) % 25 + 1, F.lit(".py")))).alias("file")
    cand = gold.select("case_id", F.col("file").alias("seed")).select("case_id", "seed", near)
    return evaluate.fold_scores(gold, cand, "file")


@_query(f"+ {_FILE_FOLDS} SELECT * FROM folds")
def loo_file_folds(spark, d):
    return _file_folds(Graph(spark, d))


@_query(f"+ {_FILE_FOLDS} SELECT count(*) AS folds, CAST(round(avg(recall), 6) AS DECIMAL(18, 6)) AS recall, CAST(round(avg(precision), 6) AS DECIMAL(18, 6)) AS precision FROM folds")
def macro_means(spark, d):
    m = evaluate.macro_means(_file_folds(Graph(spark, d)))
    return m.select("folds", *[F.round(c, 6).cast("decimal(18,6)").alias(c) for c in ("recall", "precision")])


_RUNS = """runs AS (SELECT source AS case_id, lang AS mode, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS repetition,
CAST(n_chars % 5 AS DOUBLE) / 4 AS precision, CAST(quality AS DOUBLE) AS recall, CAST(n_chars % 9 AS DOUBLE) / 8 AS f1, toxic FROM documents JOIN labels USING (doc_id))"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    rep = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))
    return docs.select(
        F.col("source").alias("case_id"), F.col("lang").alias("mode"), rep.alias("repetition"), ((F.col("n_chars") % 5) / 4).alias("precision"),
        F.col("quality").cast("double").alias("recall"), ((F.col("n_chars") % 9) / 8).alias("f1"), "toxic",
    )


@_query(f"WITH {_RUNS} SELECT mode, count(*) AS runs, " + ", ".join(f"CAST(round(avg({c}), 6) AS DECIMAL(18, 6)) AS {c}" for c in ("precision", "recall", "f1")) + " FROM runs GROUP BY 1", graph_sql=False)
def mode_metrics(spark, d):
    m = evaluate.mode_metrics(_runs(spark, d))
    return m.select("mode", "runs", *[F.round(c, 6).cast("decimal(18,6)").alias(c) for c in ("precision", "recall", "f1")])


@_query(f"""WITH {_RUNS}, c AS (SELECT mode, case_id, bool_and(recall >= 1) AS every, bool_or(recall > 0) AS some_ FROM runs GROUP BY 1, 2)
SELECT mode, count(*) AS cases, count(*) FILTER (every) AS stable_case_hits, count(*) FILTER (some_) AS cases_with_any_hit FROM c GROUP BY 1""", graph_sql=False)
def stable_case_hits(spark, d):
    return evaluate.stable_cases(_runs(spark, d))


@_query(f"""WITH {_RUNS}, p AS (SELECT b.f1 - a.f1 AS d FROM runs a JOIN runs b USING (case_id, repetition) WHERE a.mode = 'en' AND b.mode = 'fr')
SELECT count(*) AS pairs, CAST(round(avg(d), 6) AS DECIMAL(18, 6)) AS mean_delta, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM p""", graph_sql=False)
def paired_deltas(spark, d):
    return evaluate.paired_deltas(_runs(spark, d), "en", "fr").withColumn("mean_delta", F.round("mean_delta", 6).cast("decimal(18,6)"))


@_query(f"WITH {_RUNS} SELECT count(*) AS n, CAST(round(corr(f1, toxic), 6) AS DECIMAL(18, 6)) AS r FROM runs", graph_sql=False)
def pearson_risk(spark, d):
    return evaluate.pearson(_runs(spark, d), F.col("f1"), F.col("toxic")).withColumn("r", F.round("r", 6).cast("decimal(18,6)"))


@_query(f"""WITH {_RUNS}, c AS (SELECT row_number() OVER (ORDER BY case_id, mode) - 1 AS case_no, avg(f1) AS value FROM runs GROUP BY case_id, mode),
n AS (SELECT count(*) AS n FROM c), dr AS (SELECT r // n AS s, ((r * 48271 + 1) % 2147483647) % n AS case_no FROM n, range(0, (SELECT 1000 * n FROM n)) t(r)),
m AS (SELECT s, sum(value) / (SELECT n FROM n) AS m FROM dr JOIN c USING (case_no) GROUP BY 1),
k AS (SELECT m, row_number() OVER (ORDER BY m, s) - 1 AS r FROM m)
SELECT count(*) AS samples, CAST(round(max(m) FILTER (r = 25), 4) AS DECIMAL(18, 4)) AS lo, CAST(round(max(m) FILTER (r = 974), 4) AS DECIMAL(18, 4)) AS hi FROM k""", graph_sql=False)
def bootstrap_ci_hash(spark, d):
    c = _runs(spark, d).groupBy("case_id", "mode").agg(F.avg("f1").alias("value"))
    # case means are few: one for each source and language
    c = c.withColumn("case_no", (F.row_number().over(W.orderBy("case_id", "mode")) - 1).cast("long"))
    ci = evaluate.bootstrap_ci(c.select("case_no", "value"))
    return ci.select("samples", *[F.round(x, 4).cast("decimal(18,4)").alias(x) for x in ("lo", "hi")])


@_query()
def bipartite_match_size(spark, d):
    t = table(spark, d, "lineitem")
    near = t.select(F.col("l_orderkey").cast("string").alias("run"), F.col("l_linenumber").alias("pred"), (F.col("l_partkey") % 3).alias("gold"))
    return evaluate.match_sizes(near)


@_query("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""", graph_sql=False)
def gold_text_classification(spark, d):
    """Benchmark items held word for word by documents: joined by the item's first five words, then compared whole."""
    key = lambda c, at: F.xxhash64(F.slice(c, at, F.lit(3)))
    words = lambda c: F.split(c, r"\s+")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w"))
    # inner words alone are whole in any document that holds the item; items of few words have none and are looked for one by one
    docs = table(spark, d, "documents").select("doc_id", "text", words(F.col("text")).alias("w"))
    brief = items.where("size(w) < 5").select("item_id", "item")
    few = docs.join(F.broadcast(brief), F.contains("text", F.col("item"))).select("item_id", "doc_id")
    items = items.where("size(w) >= 5").select("item_id", "item", key(F.col("w"), F.lit(2)).alias("k"))
    places = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: key(F.col("w"), i))).alias("k"))
    small = items.select("k").distinct()
    hits = places.join(small, "k", "left_semi").distinct().join(items, "k")
    return hits.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id").union(few).distinct()


@_query("""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT file, line_no FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'token') ORDER BY file, line_no LIMIT 20""", graph_sql=False)
def lexical_hits_top20(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return evaluate.lexical_hits(lines.select("file", (F.col("n") + 1).cast("long").alias("line_no"), "text"), ["license", "token"])


@_query("""SELECT CAST(conv_id AS VARCHAR) AS run, coalesce(arg_max(text, turn) FILTER (role = 'user' AND turn % 3 = 0), arg_max(text, turn) FILTER (role = 'assistant')) AS text FROM conversations GROUP BY 1""", graph_sql=False)
def transcript_last_result(spark, d):
    kind = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), "result").otherwise(F.col("role"))
    e = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("run"), F.col("turn").alias("ord"), kind.alias("kind"), "text")
    return evaluate.last_results(e)


# streams


@_query("SELECT event_type, count(*) AS n, CAST(round(sum(value), 2) AS DECIMAL(18, 2)) AS total FROM events GROUP BY 1", graph_sql=False)
def stream_incremental_counts(spark, d):
    root = f"{flows.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    r = watch.incremental_counts(spark, f"{d}/events.parque[t]", schema, f"{root}/checkpoint", f"{root}/state")
    return r.withColumn("total", F.round("total", 2).cast("decimal(18,2)"))


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(round(sum(value), 2) AS DECIMAL(18, 2)) AS total FROM events GROUP BY 1, 2", graph_sql=False)
def window_tumbling_events(spark, d):
    return watch.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 2).cast("decimal(18,2)"))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""", graph_sql=False)
def session_events(spark, d):
    return watch.sessions(table(spark, d, "events"))


@_query("""WITH e AS (SELECT event_id, 'src/u' || user_id || CASE WHEN event_id % 4 = 0 THEN '.txt' ELSE '.py' END AS path, ts,
  CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' ELSE 'modified' END AS change FROM events WHERE event_id % 4 <> 0),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS k FROM g)
SELECT path, arg_max(change, (ts, change = 'deleted', event_id)) AS change, max(ts) AS changed_at, count(*) AS n_events FROM s GROUP BY path, k""", graph_sql=False)
def settled_changes(spark, d):
    """The last change of each file once it was quiet for eight hours, of events of which a third come twice."""
    e = table(spark, d, "events").selectExpr("event_id", "concat('src/u', user_id, IF(event_id % 4 = 0, '.txt', '.py')) AS path", "ts",
                                             "CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' ELSE 'modified' END AS change")
    return follow.settled(e.unionByName(e.where("event_id % 3 = 0")), "8 hours")
