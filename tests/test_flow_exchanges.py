"""Flows carry what is asked of their nodes, and lists of neighbours travel in place of pairs."""

import random

from pyspark.sql import functions as F

from codeloom.operators import flows, impact, reach


def graph(spark, seed=3):
    rng = random.Random(seed)
    calls = [(f"e{i}", f"p{rng.randrange(30)}", "call", "resolved", n) for i in range(60) for n in range(3)]
    calls += [(f"p{i}", f"p{rng.randrange(30)}", "call", "resolved", n) for i in range(30) for n in range(2)]
    return spark.createDataFrame(calls, "source string, target string, kind string, resolution string, ord long")


def test_lists_of_neighbours_give_the_same_impact(spark, monkeypatch):
    monkeypatch.setattr(impact, "MADE", 500)
    e = graph(spark)
    entries = e.select(F.col("source").alias("qname")).where("qname LIKE 'e%'").distinct()
    symbols = e.select(F.col("target").alias("qname")).distinct()
    name = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    marks = name.selectExpr("node", "CAST(node LIKE 'p%' AS INT) AS asked", "CAST(NOT node LIKE 'e%7' AS INT) AS kept")
    direct = spark.createDataFrame([("p1", "in", "e1", 1), ("p1", "in", "e2", 2), ("p1", "out", "p9", 1), ("x", "in", "e1", 1)], "symbol string, direction string, other string, rank int")
    plain = flows.saved(flows.build_flows(entries, e))
    kept = name.where("NOT node LIKE 'e%7'").withColumn("kept", F.lit(True))
    want = impact.impact(flows.slices(plain.join(kept, "node", "left"), symbols, F.col("kept"), 4), direct)
    f, rows = flows.sized_flows(entries, flows.saved(flows.adjacency(e)), about=marks)
    assert rows >= plain.count()
    got = impact.impact_near(flows.nearby(f, None, F.col("kept") == 1, 4), direct, 8 * rows)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) > 500
    # pairs are made behind the exchange by symbol
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(symbol" in line]
    assert dealt and not any("direction#" in line for line in dealt)
    own = [(r["symbol"], r["entry"], r["direction"], r["node"], r["position"]) for r in flows.slices(f, None, F.col("kept") == 1, 4).collect()]
    assert sorted(own) == sorted((r["symbol"], r["entry"], r["direction"], r["node"], r["position"]) for r in flows.slices(plain.join(kept, "node", "left"), symbols, F.col("kept"), 4).collect())


def test_levels_meet_no_calls_of_uncalled_nodes(spark, monkeypatch):
    met, plain = [], flows.grow
    monkeypatch.setattr(flows, "grow", lambda level, done, adj, depth=None: (met.append(adj.count()), plain(level, done, adj, depth))[1])
    e = graph(spark)
    entries = e.select(F.col("source").alias("qname")).where("qname LIKE 'e%'").distinct()
    n = flows.adjacency(e.where("source LIKE 'p%'")).count()
    flows.build_flows(entries, e).count()
    assert met == [n]


def test_upstream_search_leaves_uncalled_nodes_to_its_end(spark, monkeypatch):
    seen, plain = [], reach._back
    monkeypatch.setattr(reach, "_back", lambda start, arcs: (seen.append(arcs.count()), plain(start, arcs))[1])
    arcs = [(f"e{i}", "a") for i in range(30)] + [("a", "b"), ("b", "a"), ("x", "y"), ("e1", "e2")]
    got = reach.upstream(spark.createDataFrame(arcs, "src string, dst string"), spark.createDataFrame([("b",), ("e7",), ("e2",), ("lone",)], "node string"))
    assert sorted(r.node for r in got.collect()) == sorted([*[f"e{i}" for i in range(30)], "a", "b", "lone"])
    assert seen == [3]


def test_moved_sources_deal_calls_out_once(spark):
    from codeloom.operators import flow_upkeep

    adj = lambda *rows: spark.createDataFrame(rows, "src string, dst string, ord long")
    before = adj(("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2), ("c", "x", 1), ("d", "x", 1), ("d", "y", 1), ("e", "x", 3), (None, "x", 1))
    after = adj(("a", "x", 5), ("a", "y", 9), ("b", "x", 2), ("b", "y", 1), ("c", "x", 1), ("d", "y", 1), ("d", "x", 1), ("f", "x", 3), ("c", "z", 2))
    d = flow_upkeep.moved_sources(before, after)
    assert sorted(r.src for r in d.collect() if r.src) == ["b", "c", "e", "f"]
    one = lambda s: s.count("Exchange hashpartitioning(src#")
    assert one(d._jdf.queryExecution().sparkPlan().toString()) <= 2 and "hashpartitioning(src#" in d._jdf.queryExecution().sparkPlan().toString()
