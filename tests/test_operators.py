"""Operators on small graphs against plain Python."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import changes, community, evaluate, flows, graph, impact, resolve, search


def edges_of(spark, rows):
    return spark.createDataFrame(
        [(s, t, k, r, i) for i, (s, t, k, r) in enumerate(rows)], "source string, target string, kind string, resolution string, ord long"
    )


def nodes_of(spark, qnames, **extra):
    row = {"kind": "function", "file": "f.py", "start_line": 1, "end_line": 2, "signature": "s", "is_test": 0, "decorators": [], "parent": None} | extra
    return spark.createDataFrame(
        [(i, q, *row.values()) for i, q in enumerate(qnames)],
        "id long, qname string, kind string, file string, start_line int, end_line int, signature string, is_test int, decorators array<string>, parent string",
    )


def test_names(spark):
    df = spark.createDataFrame([("a.b::C.m", "x" * 200), ("m", None)], "q string, s string")
    r = df.select(names.short(F.col("q")).alias("s"), names.module(F.col("q")).alias("m"), F.char_length(names.cap_signature(F.col("s"))).alias("n")).collect()
    assert [tuple(x) for x in r] == [("m", "a.b", 161), ("m", "m", 0)]
    g = spark.createDataFrame([("test_x",), ("a.b",), ("ab",)], "s string").select("s", names.glob_match(F.col("s"), ["test_*", "a.?"]).alias("g")).collect()
    assert [x.g for x in g] == [True, True, False]
    j = spark.createDataFrame([('["a","b"]',), ("oops",), (None,)], "j string").select(F.size(names.json_list(F.col("j"))).alias("n")).collect()
    assert [x.n for x in j] == [2, 0, 0]
    names.register_functions(spark)
    assert spark.sql("SELECT qname_short('a::B.c') AS s, glob_match('abc', 'a*c') AS g").first() == ("c", True)


def test_flows_match_a_queue(spark):
    rng = random.Random(7)
    for _ in range(3):
        n = 9
        rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", "call", rng.choice(["resolved"] * 4 + ["dynamic"])) for _ in range(22)]
        e = edges_of(spark, rows)
        adj = {}
        for s, t, _, r in rows:
            if r == "resolved" and t not in adj.setdefault(s, []):
                adj[s].append(t)
        entries = spark.createDataFrame([(f"n{i}",) for i in range(0, n, 2)], "qname string")
        got = {}
        for x in flows.build_flows(entries, e).orderBy("entry", "position").collect():
            got.setdefault(x.entry, []).append(x.node)
        for i in range(0, n, 2):
            seen, queue = [f"n{i}"], deque([f"n{i}"])
            while queue:
                for t in adj.get(queue.popleft(), []):
                    if t not in seen:
                        seen.append(t)
                        queue.append(t)
            assert got[f"n{i}"] == seen


def test_entries_and_cycles(spark):
    e = edges_of(spark, [("m::a", "m::b", "call", "resolved"), ("m::c", "m::c", "call", "resolved"), ("x::ghost", "m::d", "call", "resolved")])
    n = nodes_of(spark, ["m::a", "m::b", "m::c", "m::d", "m::main"])
    r = {x.qname: x.named for x in flows.entry_nodes(n, e, ["main"], []).collect()}
    assert r == {"m::a": 0, "m::main": 1}


def test_neighbors_caps_and_errors(spark):
    e = edges_of(spark, [(f"m::s{i:02}", "m::t", "call", "resolved") for i in range(21)] + [("m::t", "gone::x", "call", "resolved"), ("m::t", "m::t", "call", "resolved")])
    n = nodes_of(spark, [f"m::s{i:02}" for i in range(21)] + ["m::t"])
    r = graph.neighbors(e, n, n.where("qname = 'm::t'"))
    assert r.where("direction = 'in'").count() == 20 and r.where("direction = 'out'").select("other").collect()[0][0] == "m::t"
    assert graph.neighbors(e, n, kind="import").count() == 0
    with pytest.raises(ValueError):
        graph.neighbors(e, n, kind="nope")
    d = {x.qname: (x.in_degree, x.out_degree) for x in graph.degrees(e, n).collect()}
    assert d["m::t"] == (22, 2)


def test_all_kinds_are_the_union(spark):
    e = edges_of(spark, [("a", "b", "call", "resolved"), ("a", "c", "import", "resolved"), ("d", "a", "extends", "resolved"), ("a", "d", "call", "dynamic")])
    n = nodes_of(spark, list("abcd"))
    every = {tuple(x)[:3] for x in graph.neighbors(e, n, kind="all").collect()}
    parts = {tuple(x)[:3] for k in ("call", "import", "extends") for x in graph.neighbors(e, n, kind=k).collect()}
    assert every == parts


def test_semantic_rules(spark):
    df = spark.createDataFrame([("resolved", None), ("semantic", "R1"), ("semantic", "R2"), (None, None)], "r string, rule string")
    r = df.select(graph.is_traversable(F.col("r"), F.col("rule"), {"R1": True, "R2": False}).alias("t")).collect()
    assert [x.t for x in r] == [True, True, False, False]


def test_risk(spark):
    n = nodes_of(spark, ["m::a", "m::b", "m::c"]).union(nodes_of(spark, ["k::x"], file="g.py"))
    e = edges_of(spark, [("k::x", "m::a", "call", "resolved"), ("m::a", "m::b", "call", "resolved"), ("m::c", "m::b", "call", "dynamic")])
    r = {x.qname: x.risk for x in impact.risk_scores(e, n).collect()}
    assert r == {"m::a": 70, "m::b": 35, "m::c": 10, "k::x": 10}
    tests = nodes_of(spark, ["m::a", "m::c"]).union(nodes_of(spark, ["k::x"], file="g.py", is_test=1))
    assert {x.qname: x.risk for x in impact.risk_scores(e, tests).collect()}["m::a"] == 10


def test_uncertainty_and_coverage(spark):
    rows = [("m::a", "e", "call", "external"), ("m::a", "u", "import", "unresolved"), ("m::a", "d", "call", "dynamic"), ("m::z", "m::a", "call", "candidate"), ("m::a", "s", "call", "semantic"),
            ("m::a", "m::b", "call", "resolved"), ("m::a", "m::a", "call", "dynamic")]
    rows += [("m::q", f"x{i:02}", "call", "dynamic") for i in range(20)] + [("m::p", f"y{i:02}", "call", "dynamic") for i in range(19)]
    e = edges_of(spark, rows).withColumn("rule_id", F.lit(None).cast("string"))
    u = graph.uncertainty(e).where("symbol = 'm::a'").orderBy("rank").collect()
    assert [(x.resolution, x.source, x.expression) for x in u] == [
        ("dynamic", "m::a", "d"), ("dynamic", "m::a", "m::a"), ("candidate", "m::z", "m::a"), ("unresolved", "m::a", "u"), ("external", "m::a", "e"), ("semantic", "m::a", "s")]
    assert u[-1].reason == "uncertain edge" and {x.truncated for x in u} == {0}
    c = {x.symbol: x for x in graph.coverage(e).collect()}
    assert (c["m::q"].truncated, c["m::p"].truncated, c["m::a"].truncated) == (1, 0, 0)
    assert (c["m::a"].resolved_edges, c["m::a"].dynamic_edges, c["m::a"].unresolved_edges) == (1, 2, 0)
    assert graph.uncertainty(e).where("symbol = 'm::q'").agg(F.min("truncated")).first()[0] == 1


def plain_flows(rows, entries, followed=("resolved",)):
    adj, out = {}, {}
    for s, t, _, r in rows:
        if r in followed and t not in adj.setdefault(s, []):
            adj[s].append(t)
    for e in entries:
        seen, queue = [e], deque([e])
        while queue:
            for t in adj.get(queue.popleft(), []):
                if t not in seen:
                    seen.append(t)
                    queue.append(t)
        out[e] = seen
    return out


def test_slices_impact_and_tests_match_plain_python(spark):
    rng = random.Random(11)
    for cap, n in ((3, 14), (20, 40)):
        names = [f"n{i:02}" for i in range(n)]
        rows = [(rng.choice(names), rng.choice(names), "call", rng.choice(["resolved"] * 4 + ["dynamic"])) for _ in range(2 * n)]
        tests = {x for x in names if rng.random() < 0.3}
        e = edges_of(spark, rows)
        nodes = nodes_of(spark, [x for x in names if x not in tests]).union(nodes_of(spark, sorted(tests), is_test=1))
        entries = names[::3]
        flows_of = plain_flows(rows, entries)
        f = flows.saved(flows.build_flows(spark.createDataFrame([(x,) for x in entries], "qname string"), e))
        symbols = spark.createDataFrame([(x,) for x in [*names, "gone::x"]], "qname string")
        for mode, ok in (("exclude", lambda x: x not in tests), ("only", lambda x: x in tests), ("include", lambda x: True)):
            keep = nodes.where(F.col("is_test").isin(impact.TESTS[mode])).select(F.col("qname").alias("node"), F.lit(True).alias("kept"))
            near = flows.slices(f.select("entry", "node", "position").join(keep, "node", "left"), symbols, F.col("kept"), cap)
            direct = impact.direct_impact(e, nodes, symbols, cap, mode)
            got = {}
            for x in impact.impact(near, direct).orderBy("rank").collect():
                got.setdefault((x.symbol, x.direction), []).append(x.node)
            for s in names:
                sides = {"up": sorted({a for a, b, _, r in rows if b == s and r == "resolved" and ok(a)})[:cap], "down": sorted({b for a, b, _, r in rows if a == s and r == "resolved" and ok(b)})[:cap]}
                for entry in sorted(flows_of):
                    path = flows_of[entry]
                    if s in path:
                        at = path.index(s)
                        sides["up"] = sides["up"] + [x for x in path[:at] if ok(x)][-cap:]
                        sides["down"] = sides["down"] + [x for x in path[at + 1:] if ok(x)][:cap]
                for d, want in sides.items():
                    assert got.get((s, d), []) == list(dict.fromkeys(want)), (mode, s, d)
            if mode == "only":
                c = impact.covers(impact.affected_entries(f, nodes, symbols, "only"), direct, near, nodes)
                want = {(t, s) for s in names for t in got.get((s, "up"), [])} | {(x, s) for x in entries if x in tests for s in flows_of[x]}
                assert {(x.test, x.symbol) for x in c.collect()} == want
                flags = {x.symbol: x for x in impact.test_impact_flags(symbols, nodes, c, e).collect()}
                hidden = {x for a, b, _, r in rows if r == "dynamic" for x in (a, b)}
                assert all(flags[s].fallback == int(s in hidden and not any(w[1] == s for w in want)) for s in names)
                assert flags["gone::x"].fallback == 1 and flags["gone::x"].found == 0


def test_slices_shuffle_no_pairs(spark):
    f = spark.createDataFrame([("e", f"n{i:02}", i) for i in range(60)], "entry string, node string, position long")
    symbols = f.select(F.col("node").alias("qname"))
    near = flows.slices(f, symbols, F.lit(True), 3)
    assert near.count() == 2 * (60 * 3 - 6)
    # pairs come from a window; flows are joined with no other table by entry
    assert "Join [entry#" not in near._jdf.queryExecution().executedPlan().toString()
    sparse = flows.slices(f, symbols, F.col("position") % 20 == 7, 2)
    got = {(r.symbol, r.direction, r.node) for r in sparse.collect()}
    kept = [7, 27, 47]
    want = {(f"n{i:02}", d, f"n{k:02}") for i in range(60) for d, ks in (("up", [k for k in kept if k < i][-2:]), ("down", [k for k in kept if k > i][:2])) for k in ks}
    assert got == want


def test_long_chain_and_registered_rules(spark):
    rows = [(f"c{i:03}", f"c{i + 1:03}", "call", "resolved") for i in range(40)] + [("c040", "s1", "call", "semantic"), ("s1", "s2", "call", "semantic")]
    e = edges_of(spark, rows).withColumn("rule_id", F.when(F.col("target") == "s1", "R1").otherwise("R2"))
    entry = spark.createDataFrame([("c000",)], "qname string")
    got = [x.node for x in flows.build_flows(entry, e, rules={"R1": True, "R2": False}).orderBy("position").collect()]
    assert got == [f"c{i:03}" for i in range(41)] + ["s1"]
    n = nodes_of(spark, ["s1", "s2", "c000"])
    assert {x.qname for x in flows.entry_nodes(n, e, [], [], {"R1": True}).collect()} == {"s2", "c000"}


def test_dead_code_knows_entries_of_all_kinds(spark):
    n = nodes_of(spark, ["m::main", "m::used", "m::dead"]).union(nodes_of(spark, ["m::Plugin"], kind="class", decorators=["other", "register"]))
    n = n.union(nodes_of(spark, ["m::Gone"], kind="class", file="g.py")).union(nodes_of(spark, ["g"], kind="module", file="g.py")).union(nodes_of(spark, ["m"], kind="module"))
    n = n.union(nodes_of(spark, ["p"], kind="module", file="pkg/reinit_x.py")).union(nodes_of(spark, ["q"], kind="module", file="q/__init__.py"))
    e = edges_of(spark, [("m::main", "m::used", "call", "resolved")])
    entry = flows.is_entry(["main"], ["regist*"])
    dead = impact.dead_symbols(n, graph.degrees(e, n), entry)
    assert {x.qname for x in dead.collect()} == {"m::dead", "m::Gone"}
    assert {(x.qname, x.symbol_count) for x in impact.dead_files(n, e, entry, dead).collect()} == {("g", 1)}  # reinit_x.py fits the pattern of package files


def test_diff_parsing(spark):
    text = ["+++ b/a.py", "@@ -1 +0,0 @@", "@@ -3,2 +5 @@", "+++ /dev/null", "@@ -1,4 +0,0 @@", "+++ b/b.py", "@@ -1 +7,3 @@ def f"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "diff_id int, line_no int, line string")
    assert sorted(tuple(x) for x in changes.parse_diff(lines).collect()) == [("a.py", 1, 1), ("a.py", 5, 1), ("b.py", 7, 3)]
    ns = spark.createDataFrame([("3\t1\ta.py",), ("-\t-\tb.bin",)], "line string")
    assert sorted(tuple(x) for x in changes.parse_numstat(ns).collect()) == [("a.py", 3, 1), ("b.bin", 0, 0)]


def test_every_hunk_is_accounted_for(spark):
    n = nodes_of(spark, ["m::long"], start_line=10, end_line=400).union(nodes_of(spark, ["m::b"], start_line=500, end_line=501))
    h = spark.createDataFrame([("f.py", 60, 300), ("f.py", 401, 99), ("f.py", 395, 106), ("z.py", 1, 1)], "file string, start int, count int")
    n = n.unionByName(nodes_of(spark, ["m::C"], kind="class", start_line=401, end_line=450).withColumn("id", F.lit(77).cast("long")))
    h = h.union(spark.createDataFrame([("f.py", 410, 2), ("f.py", 460, 2)], "file string, start int, count int"))
    o = changes.hunk_overlaps(h, n)
    assert sorted((x.start, x.qname) for x in o.collect()) == [(60, "m::long"), (395, "m::b"), (395, "m::long")]
    assert sorted((x.file, x.start) for x in changes.uncovered_hunks(h, n).collect()) == [("f.py", 460), ("z.py", 1)]
    names = lambda *x: spark.createDataFrame([(y,) for y in x], "file string")
    stat = spark.createDataFrame([("f.py", 1, 1), ("img.png", 0, 0), ("gone.py", 0, 9), ("told.py", 0, 4)], "file string, added long, removed long")
    u = changes.uncovered_changes(h, stat, names("gone.py", "told.py"), n, names("told.py"))
    assert {(x.file, x.start, x.deleted) for x in u.collect()} == {("f.py", 460, 0), ("z.py", 1, 0), ("img.png", None, 0), ("gone.py", None, 1)}
    risks = spark.createDataFrame([("m::long", 70)], "qname string, risk long")
    f = {x.qname: x.risk for x in changes.changed_functions(h, names("gone.py"), n, risks).collect()}
    assert f == {"m::long": 70, "m::b": 50, "m::C": 50}
    total = changes.change_summary(stat, n, u, names("a", "b")).first()
    assert tuple(total) == (4, 1, 14, 3, 4, 2)


def test_equal_hunks_are_joined_once(spark):
    h = spark.createDataFrame([("f", 60, 10)] * 3 + [("f", 1, 0), ("g", 5, 1)], "file string, start int, count int")
    n = spark.createDataFrame([("f", "a", "function", 1, 200), ("f", "b", "function", 62, 70), ("g", "c", "class", 5, 5)], "file string, qname string, kind string, start_line int, end_line int")
    o = changes.hunk_overlaps(h, n)
    assert sorted(tuple(r) for r in o.collect()) == [("f", 60, 10, "a"), ("f", 60, 10, "b")]
    # the hunks are made distinct before the join, the pairs after it
    assert o._jdf.queryExecution().sparkPlan().toString().count("HashAggregate(keys=[file") == 4


def test_delta_keeps_ids(spark):
    old = nodes_of(spark, ["m::a", "m::b"]).union(nodes_of(spark, ["k::z"], file="k.py").withColumn("id", F.lit(9).cast("long")))
    fresh = nodes_of(spark, ["m::b", "m::new1", "m::new2"]).drop("id")
    r = {x.qname: x.id for x in changes.apply_delta(old, spark.createDataFrame([("f.py",)], "file string"), fresh).collect()}
    assert r["m::b"] == 1 and r["k::z"] == 9 and sorted((r["m::new1"], r["m::new2"])) == [10, 11] and "m::a" not in r


def test_manifest_and_repair(spark):
    schema = "path string, stamp double, size int, hash string"
    old = spark.createDataFrame([("a", 1.0, 1, "x"), ("b", 1.0, 1, "x"), ("c", 1.0, 1, "x"), ("d", 1.0, 1, "x"), ("s", 1.0, 1, "x")], schema)
    new = spark.createDataFrame([("a", 1.0, 1, "y"), ("b", 2.0, 1, "x"), ("c", 2.0, 1, "y"), ("e", 1.0, 1, "x"), ("s", 1.0, 2, "y")], schema)
    assert {tuple(x) for x in changes.manifest_diff(old, new).collect()} == {("c", "changed"), ("d", "deleted"), ("e", "added"), ("s", "changed")}
    e = edges_of(spark, [("a", "m::b", "call", "unresolved"), ("a", "m::gone", "call", "resolved"), ("a", "m::b", "call", "dynamic"), ("a", "plain", "call", "unresolved")])
    r = [x.resolution for x in changes.repair_resolutions(e, nodes_of(spark, ["m::b", "plain"])).orderBy("ord").collect()]
    assert r == ["resolved", "unresolved", "dynamic", "unresolved"]


def test_communities(spark):
    w = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1)] + [(f"q{i:02}", f"q{i + 1:02}", 1) for i in range(20)], "a string, b string, weight long")
    r = {x.qname: x.community for x in community.components(w).collect()}
    assert r["c"] == "a" and r["y"] == "x" and r["q20"] == "q00"
    m = spark.createDataFrame([("a.b::C.x", 1), ("a.b::C.y", 1), ("a.b::Z", 2)], "qname string, community long")
    labels = {x.community: x.label for x in community.labels(m.withColumn("community", F.col("community").cast("string"))).collect()}
    assert labels == {"1": "b", "2": "b"}  # both were a.b, whose prefix a. all share
    m = spark.createDataFrame([(f"src.app.m{k}.index::f{i}", k) for k in range(5) for i in range(2)] + [("other::x", 5)], "qname string, community long")
    labels = [x.label for x in community.labels(m).orderBy("community").collect()]
    # the first label is src.app.m0.index: index goes, then the prefix src.app. that five of six have
    assert labels == [f"m{k}" for k in range(5)] + ["other"]


def test_only_sinks_are_hubs(spark):
    e = edges_of(spark, [(f"m{i}::a", "hub::f", "call", "resolved") for i in range(4)] + [(f"m{i}::a", "busy::f", "call", "resolved") for i in range(4)]
                 + [("busy::f", f"x{i}::g", "call", "resolved") for i in range(9)])
    n = nodes_of(spark, [f"m{i}::a" for i in range(4)] + ["hub::f", "busy::f"] + [f"x{i}::g" for i in range(9)])
    signals = {x.qname: (x.n_in, x.sinkness, x.spread) for x in community.sink_signals(e).collect()}
    assert "busy::f" not in signals and signals["hub::f"] == (4, 1.0, 1.0)
    left = {(x.a, x.b) for x in community.hub_pruned(community.undirected(e, n), community.sink_signals(e)).collect()}
    assert not any("hub::f" in p for p in left) and sum("busy::f" in p for p in left) == 13


def test_search(spark):
    n = nodes_of(spark, ["auth::hash_pw", "auth::hash", "util::pw_hash", "util::other"])
    hit = [x.id for x in search.bm25(n, "hash_pw", "qname", ["qname"]).collect()]
    assert hit == ["auth::hash_pw"]
    assert search.bm25(n, "::", "qname", ["qname"]).count() == 0
    assert [x.qname for x in search.search(n, "h*").collect()] == ["auth::hash_pw", "auth::hash"]
    assert [x.qname for x in search.search(n, "sh_p").collect()] == ["auth::hash_pw"]
    more = n.union(nodes_of(spark, ["hash"], kind="module")).union(nodes_of(spark, ["z::Café"], kind="class", signature="Ab(x)", decorators=["one", "wrap_it"], end_line=77))
    assert {x.qname for x in search.search(more, "hash").collect()} == {"auth::hash", "auth::hash_pw", "util::pw_hash"}
    assert [x.qname for x in search.search(more, "CAFE a-b wrap").collect()] == ["z::Café"]
    assert [x.qname for x in search.search(more, "rap_it 7").collect()] == ["z::Café"] and search.search(more, "!! ::").count() == 0
    assert search.terms("hash_pw a-b AND ::") == [["hash", "pw"], ["ab"], ["and"]]


def test_resolution_channels(spark):
    calls = spark.createDataFrame(
        [(1, "m::f", "m", None, "g", "simple"), (2, "m::f", "m", None, "imp", "simple"), (3, "m::f", "m", None, "nope", "simple"), (4, "m::C.k", "m", "self", "run", "attribute"),
         (5, "m::f", "m", "lib", "go", "attribute"), (6, "m::f", "m", "obj", "run", "attribute"), (7, "m::f", "m", "who", "x", "attribute")],
        "call int, source string, module string, receiver string, name string, form string",
    )
    n = nodes_of(spark, ["m::g", "lib::real", "m::C.run", "lib::go"])
    imports = spark.createDataFrame([("m", "imp", "old", "thing", 0), ("m", "imp", "lib", "real", 1), ("m", "lib", "lib", None, 2)], "module string, local string, target_module string, target_name string, ord int")
    types = spark.createDataFrame([("m::f", "obj", "m::C")], "scope string, receiver string, type string")
    r = {x.call: (x.resolution, x.target) for x in resolve.resolve_calls(calls, n, imports, types).collect()}
    assert r == {1: ("resolved", "m::g"), 2: ("resolved", "lib::real"), 3: ("unresolved", None), 4: ("resolved", "m::C.run"), 5: ("resolved", "lib::go"), 6: ("resolved", "m::C.run"), 7: ("dynamic", None)}


def test_closure_ends_on_cycles(spark):
    step = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "d1"), ("b", "d2")], "src string, dst string")
    asks = spark.createDataFrame([("k", "a"), ("k2", "zz")], "key string, node string")
    defined = spark.createDataFrame([("d1",), ("d2",)], "node string")
    r = {x.key: x.resolution for x in resolve.resolve_reexports(asks, step, defined).collect()}
    assert r == {"k": "candidate", "k2": "unresolved"}


def test_matching_and_statistics(spark):
    pairs = spark.createDataFrame([("r", "p1", "g1"), ("r", "p1", "g2"), ("r", "p2", "g1"), ("r", "p3", "g1")], "run string, pred string, gold string")
    assert evaluate.match_sizes(pairs).first().matched == 2
    # one augmenting path through all pairs
    long = [("long", f"p{i:05}", f"g{k:05}") for i in range(3000) for k in ((i, i + 1) if i < 2999 else (0,))]
    assert evaluate.match_sizes(spark.createDataFrame(long, "run string, pred string, gold string")).first().matched == 3000
    rng = random.Random(2)
    for _ in range(5):
        few = sorted({("r", f"p{rng.randrange(6)}", f"g{rng.randrange(6)}") for _ in range(11)})
        best = max(len(c) for k in range(7) for c in itertools.combinations(few, k) if len({x[1] for x in c}) == len(c) == len({x[2] for x in c}))
        assert evaluate.match_sizes(spark.createDataFrame(few, "run string, pred string, gold string")).first().matched == best
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert evaluate.pearson(flat, F.col("x"), F.col("y")).first().r is None
    s = spark.createDataFrame([(0, 0, 3)], "matched long, n_pred long, n_gold long")
    assert tuple(evaluate.scores(s).first())[3:] == (0.0, 0.0, 0.0)


def test_routes(spark):
    q = spark.createDataFrame([("t1", "GET", "/a/5?x=1/2"), ("t2", "POST", "//a/5/#top"), ("t3", "GET", "/a"), ("t4", "GET", "/z/5"), ("t5", "GET", "/a/{any}")], "test string, method string, path string")
    r = spark.createDataFrame([("c1", "GET", "/a/{id}"), ("c2", "ANY", "/{x}/5"), ("c3", "GET", "/a/6/")], "controller string, method string, path string")
    got = sorted((x.test, x.controller, x.resolution) for x in resolve.match_routes(q, r, nodes_of(spark, ["c1", "c3"])).collect())
    assert got == [("t1", "c1", "resolved"), ("t1", "c2", "unresolved"), ("t2", "c2", "unresolved"), ("t4", "c2", "unresolved"),
                   ("t5", "c1", "resolved"), ("t5", "c2", "unresolved"), ("t5", "c3", "resolved")]
