"""Impact of symbols, tests that reach them, dead code and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.graph import directed, keep_first
from codeloom.operators.sizes import spread

#: What a test filter keeps: is_test values, or all.
TESTS = {"exclude": [0], "only": [1], "include": [0, 1]}


def direct_impact(edges: DataFrame, nodes: DataFrame, symbols: DataFrame, cap: int = 20, tests: str = "exclude") -> DataFrame:
    """symbol, direction, other, rank: callers and callees over resolved calls, by name, filtered by tests before the cap."""
    calls = edges.where("kind = 'call' AND resolution = 'resolved'")
    d = directed(calls).select("symbol", "direction", "other").distinct()
    d = d.join(symbols.select(F.col("qname").alias("symbol")).distinct(), "symbol", "left_semi")
    ok = nodes.where(F.col("is_test").isin(TESTS[tests])).select(F.col("qname").alias("other"))
    d = d.join(ok, "other", "left_semi")
    rank = F.row_number().over(W.partitionBy("symbol", "direction").orderBy("other"))
    return d.withColumn("rank", rank.cast("long")).where(F.col("rank") <= cap).select("symbol", "direction", "other", "rank")


def impact(flow_slices: DataFrame, direct: DataFrame) -> DataFrame:
    """symbol, direction, node, rank: direct callers and callees first, then the slices of all flows, each node once."""
    first = direct.select("symbol", F.when(F.col("direction") == "in", "up").otherwise("down").alias("direction"), F.col("other").alias("node"),
                          F.lit(0).alias("tier"), F.lit("").alias("entry"), F.col("rank").cast("long").alias("position"))
    later = flow_slices.select("symbol", "direction", "node", F.lit(1).alias("tier"), "entry", F.col("position").cast("long").alias("position"))
    both = keep_first(first.unionByName(later), ["symbol", "direction", "node"], ["tier", "entry", "position"])
    rank = F.row_number().over(W.partitionBy("symbol", "direction").orderBy("tier", "entry", "position", "node"))
    return both.select("symbol", "direction", "node", rank.cast("long").alias("rank"))


#: Pairs of a symbol and a node that a task makes.
MADE = 1_000_000


def impact_near(near: DataFrame, direct: DataFrame, pairs: int) -> DataFrame:
    """What `impact` gives, from near(symbol, entry, up, down) of `flows.nearby`, which hold about `pairs` names.

    Neighbours travel to their symbol as lists of names, once; pairs are made, told apart and ranked there. Within a flow the place in the list is the order.
    """
    side = lambda way: F.transform(F.sort_array(F.collect_list(F.when(F.col("direction") == way, F.struct("rank", "other")))), lambda x: x.other)
    first = direct.groupBy("symbol").agg(side("in").alias("up"), side("out").alias("down")).select("symbol", F.lit(0).alias("tier"), F.lit("").alias("entry"), "up", "down")
    each = spread(near.select("symbol", F.lit(1).alias("tier"), "entry", "up", "down").unionByName(first), ["symbol"], pairs, MADE)
    item = lambda way: F.transform(way, lambda x, i: F.struct(F.lit(way).alias("direction"), x.alias("node"), i.alias("place")))
    each = each.select("symbol", "tier", "entry", F.explode(F.concat(item("up"), item("down"))).alias("x")).select("symbol", "x.direction", "x.node", "tier", "entry", "x.place")
    both = each.groupBy("symbol", "direction", "node").agg(F.min(F.struct("tier", "entry", "place")).alias("at"))
    rank = F.row_number().over(W.partitionBy("symbol", "direction").orderBy("at", "node"))
    return both.select("symbol", "direction", "node", rank.cast("long").alias("rank"))


def affected_entries(flows: DataFrame, nodes: DataFrame, symbols: DataFrame, tests: str = "exclude") -> DataFrame:
    """symbol, entry: the entries of the flows that a symbol is on, filtered by tests; `reach.entries_of` finds them without flows."""
    ok = nodes.where(F.col("is_test").isin(TESTS[tests])).select(F.col("qname").alias("entry"))
    return flows.select(F.col("node").alias("symbol"), "entry").join(
        symbols.select(F.col("qname").alias("symbol")), "symbol", "left_semi"
    ).join(ok, "entry", "left_semi").distinct()


def covers(entries: DataFrame, direct: DataFrame, flow_slices: DataFrame, nodes: DataFrame | None, by: str = "test") -> DataFrame:
    """test, symbol: the tests that reach each symbol, as entries of its flows, as callers, or before it in a flow.

    Without nodes all three hold tests alone. The rows lie by `by`, test or symbol, where what reads them goes on.
    """
    hits = entries.select(F.col("entry").alias("test"), "symbol").unionByName(
        direct.where("direction = 'in'").select(F.col("other").alias("test"), "symbol")
    ).unionByName(flow_slices.where("direction = 'up'").select(F.col("node").alias("test"), "symbol"))
    if nodes is not None:
        hits = hits.join(nodes.where("is_test = 1").select(F.col("qname").alias("test")), "test", "left_semi")
    return hits.repartition(by).distinct()


def test_impact(covered: DataFrame, nodes: DataFrame) -> DataFrame:
    """test, file, n_covers, covers: the tests to run, with the symbols that each covers."""
    tests = nodes.where("is_test = 1").select(F.col("qname").alias("test"), "file")
    return covered.join(tests, "test").groupBy("test", "file").agg(
        F.count("*").alias("n_covers"), F.concat_ws(",", F.sort_array(F.collect_list("symbol"))).alias("covers")
    )


def test_impact_flags(symbols: DataFrame, nodes: DataFrame, covered: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol, found, n_tests, fallback: a run of all tests is advised for unknown symbols, and for untested ones with a dynamic or candidate edge."""
    n = covered.groupBy("symbol").agg(F.count("*").alias("n_tests"))
    hidden = edges.where("resolution IN ('dynamic', 'candidate')").select(F.explode(F.array("source", "target")).alias("symbol")).distinct()
    s = symbols.select(F.col("qname").alias("symbol")).distinct()
    s = s.join(nodes.select(F.col("qname").alias("symbol"), F.lit(1).alias("found")), "symbol", "left").join(n, "symbol", "left").join(
        hidden.withColumn("hidden", F.lit(1)), "symbol", "left"
    ).na.fill(0)
    return s.select("symbol", "found", "n_tests", ((F.col("found") == 0) | ((F.col("n_tests") == 0) & (F.col("hidden") == 1))).cast("int").alias("fallback"))


def dead_symbols(nodes: DataFrame, degrees: DataFrame, entry: Column) -> DataFrame:
    """Functions, methods and classes outside of tests that nothing calls and that are no declared entry (`entry`, over nodes)."""
    n = nodes.where("kind IN ('function', 'method', 'class') AND is_test = 0").where(~entry)
    return n.join(degrees.where("in_degree = 0").select("qname"), "qname", "left_semi").select("qname", "kind", "file", "start_line", "signature", "decorators")


def dead_files(nodes: DataFrame, edges: DataFrame, entry: Column, dead: DataFrame) -> DataFrame:
    """Modules that nothing imports and whose file has neither a declared entry of any kind nor a test: file, qname, dead symbols.

    The pattern of package files is SQL's: each underscore is any character, in either case.
    """
    imported = edges.where("kind = 'import' AND resolution = 'resolved'").select(F.col("target").alias("qname"))
    live = nodes.where(entry | (F.col("is_test") == 1)).select("file")
    modules = nodes.where("kind = 'module'").where(~F.col("file").ilike("%__init__.py")).join(imported, "qname", "left_anti").join(live, "file", "left_anti")
    counts = dead.groupBy("file").agg(F.count("*").alias("symbol_count"))
    return modules.select("file", "qname").join(counts, "file", "left").na.fill(0)


def dead_report(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: symbol_count, file_count."""
    return symbols.agg(F.count("*").alias("symbol_count")).crossJoin(files.agg(F.count("*").alias("file_count")))


def risk_scores(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """qname, cross, same, risk: callers in other files weigh 10 from 60 on, in the same file 5 from 30 on; 50 without a file. Tests are no callers."""
    calls = edges.where("kind = 'call' AND resolution = 'resolved'").select("source", "target").distinct()
    callers = calls.join(nodes.where("is_test = 0").select(F.col("qname").alias("source"), F.col("file").alias("caller_file")), "source")
    targets = nodes.where("kind IN ('function', 'method', 'class')").select("qname", "file")
    j = targets.join(callers, F.col("qname") == F.col("target"), "left")
    c = j.groupBy("qname", "file").agg(
        F.count_if(F.col("caller_file") != F.col("file")).alias("cross_callers"), F.count_if(F.col("caller_file") == F.col("file")).alias("same_callers")
    )
    x, s = F.col("cross_callers"), F.col("same_callers")
    risk = F.when(F.col("file").isNull(), 50).when(x > 0, F.least(F.lit(100), 60 + 10 * x)).when(s > 0, F.least(F.lit(59), 30 + 5 * s)).otherwise(10)
    return c.select("qname", "cross_callers", "same_callers", risk.cast("long").alias("risk"))
