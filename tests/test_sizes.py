"""Memory of tasks and passes over the data that must not grow faster than the tables."""

from pyspark.sql import functions as F

from codeloom.operators import community, evaluate, reach, scans, search
from codeloom.operators.sizes import spread


def plan(df, *names):
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[-1]
    return [sum(1 for line in text.splitlines() if line.strip(" :+-*()0123456789").startswith(n)) for n in names]


def test_spread_bounds_the_rows_of_a_partition(spark):
    d = spread(spark.range(50_000).selectExpr("id AS k"), ["k"], 50_000, 1_000)
    assert d.rdd.getNumPartitions() == 50
    assert spread(spark.range(10).selectExpr("id AS k"), ["k"], 10, 1_000).rdd.getNumPartitions() == 1
    # a grouping by the key stays there
    assert plan(d.groupBy("k").count(), "Exchange") == [1]


def test_diff_sections_order_lines_once(spark):
    rows = [(1, n, x) for n, x in enumerate(["noise", "diff --git a/p b/p", "@@ -1 +1 @@", "-x", "diff --git a/p b/p", "index", "@@ -2 +7,2 @@ f", "+a", "@@ -5 +9 @@", "diff --git a/q"])]
    d = scans.diff_sections(spark.createDataFrame(rows, "diff_id long, line_no int, line string"))
    assert sorted(tuple(r) for r in d.collect()) == [
        (1, "p", 0, None, 2, "diff --git a/p b/p\nindex"), (1, "p", 1, 7, 2, "@@ -2 +7,2 @@ f\n+a"), (1, "p", 2, 9, 1, "@@ -5 +9 @@")]
    # the lines once, the hunks once
    assert plan(d, "Sort ") == [2]


def test_fold_scores_stay_with_their_case(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "x"), (3, "y"), (None, "a"), (None, "b")], "case_id long, item string")
    cand = [(1, "a", "b"), (1, "a", "b"), (1, "a", "z"), (1, "b", "b"), (1, "c", "a"), (1, "c", "b"), (2, "a", "b"), (3, "x", "q"), (1, "nobody", "a")]
    cand = spark.createDataFrame(cand, "case_id long, seed string, item string")
    of = lambda d: spread(d, ["case_id"], 9, 3)
    d = evaluate.fold_scores(of(gold), of(cand), "item")
    assert sorted(tuple(r) for r in d.collect()) == [
        (1, "a", 2, 1, 0.5, 0.5), (1, "b", 2, 0, 0.0, 0.0), (1, "c", 2, 2, 1.0, 1.0), (3, "x", 1, 0, 0.0, 0.0), (3, "y", 1, 0, 0.0, 0.0)]
    assert plan(d, "Exchange", "SortMergeJoin", "BroadcastHashJoin") == [2, 0, 0]


def test_postings_read_their_rows_once(spark):
    docs = spark.createDataFrame([(1, "a B", None), (2, "", "c")], "id long, x string, y string")
    p = search.postings(docs, "id", ["x", "y"])
    assert sorted(tuple(r) for r in p.collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (2, 1, 0, "c")]
    assert plan(p, "Union") == [0]


def test_components_shrink_with_every_round(spark, monkeypatch):
    written, plain = [], community.saved
    monkeypatch.setattr(community, "saved", lambda d: (written.append((d.columns, plain(d))), written[-1][1])[1])
    # a path, a ring, a star, a loop and an end that is null
    pairs = [(f"p{i:03}", f"p{i + 1:03}") for i in range(99)] + [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)] + [("s0", f"s{i}") for i in range(1, 9)] + [("l", "l"), (None, "x")]
    d = community.components(spark.createDataFrame(pairs, "a string, b string").withColumn("weight", F.lit(1)))
    got = {r.qname: r.community for r in d.collect()}
    assert got == {q: q[0] + {"p": "000", "r": "0", "s": "0"}.get(q[0], "") for a, b in pairs for q in (a, b) if q}
    # an edge table a round at most, and each shorter
    assert len([c for c, _ in written if c == ["a", "b"]]) <= 4


def test_what_nothing_enters_is_no_part_of_the_search(spark, monkeypatch):
    arcs = [(f"e{i}", "a") for i in range(30)] + [("e1", "c"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "y")]
    seen, plain = [], reach.strong_components
    monkeypatch.setattr(reach, "strong_components", lambda x: (seen.append(x.count()), plain(x))[1])
    name = lambda *n: spark.createDataFrame([(q,) for q in n], "qname string")
    d = reach.reaching(spark.createDataFrame(arcs, "src string, dst string"), name("a", "b", "d", "e3", "y", "lone"), name(*[f"e{i}" for i in range(30)], "b", "x", "lone"))
    want = {(s, f"e{i}") for s in "abd" for i in range(30)} | {("b", "b"), ("d", "b"), ("e3", "e3"), ("y", "x"), ("lone", "lone")}
    got = [tuple(r) for r in d.collect()]
    assert set(got) == want and len(got) == len(want)
    assert seen == [4]


def test_coverage_counts_in_partitions_by_rows(spark, monkeypatch):
    from codeloom.operators import graph

    monkeypatch.setattr(graph, "EACH", 50)
    e = spark.createDataFrame([(f"s{i % 40}", f"t{i}", "call", "resolved") for i in range(500)], "source string, target string, kind string, resolution string")
    found = graph.coverage(e)
    assert found.rdd.getNumPartitions() >= 20
    assert {r.symbol: r.resolved_edges for r in found.collect()} == {f"t{i}": 1 for i in range(500)} | {f"s{i}": 12 + (i < 20) for i in range(40)}
