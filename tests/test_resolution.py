"""Java resolution, specifiers, cases and upkeep on small tables."""

from codeloom.operators import cases, java, search, specifiers, upkeep

NODE = "qname string, kind string, path string, module string, file string, start_line int, end_line int, signature string, decorators array<string>, is_test int"
IMPORT = "path string, local string, target_module string, target_name string, is_star boolean, ord int"


def nodes(spark, *names):
    def kind(q):
        return "module" if "::" not in q else "class" if q.split("::")[1].split(".")[-1][0].isupper() else "method"
    return spark.createDataFrame([(q, kind(q), q.split("::")[0].replace(".", "/") + ".java", q.split("::")[0], q.split("::")[0].replace(".", "/") + ".java", i * 10, i * 10 + 5, q, [], 0)
                                  for i, q in enumerate(names)], NODE)


KNOWN = ("a", "a::Own", "a::Own.m", "a::Own.Inner", "a::Own.Inner.k", "a::Mate", "a::Mate.run", "b::Far", "b::Far.go", "b::Twin", "b::Twin.t", "c::Twin", "c::Twin.t", "c.d::Deep", "c.d::Deep.x")


def test_java_calls(spark):
    n = nodes(spark, *KNOWN)
    imports = spark.createDataFrame([
        ("A.java", "Far", "b", "Far", False, 0), ("A.java", "Ext", "ext", "Ext", False, 1), ("A.java", "*", "b", "*", True, 2), ("A.java", "*", "c", "*", True, 3),
        ("A.java", "Mate", "b", "Far", False, 4), ("B.java", "Ext", "a", "Own", False, 0)], IMPORT)
    types = spark.createDataFrame([("a::Own.m", "far", "Far"), ("a::Own.m", "twin", "Twin"), ("a::Own.m", "mate", "Mate"), ("a::Own.m", "gone", "Nowhere")], "source string, receiver string, type string")
    wanted = {
        ("simple", "Mate"): ("a::Mate", "resolved", "package"), ("simple", "Ext"): (None, "unresolved", "import"), ("simple", "Twin"): (None, "candidate", "star"),
        ("simple", "m"): ("a::Own.m", "resolved", "member"), ("simple", "nope"): (None, "unresolved", None),
        ("construct", "Far"): ("b::Far", "resolved", "import"), ("construct", "Ext"): (None, "unresolved", None), ("construct", "Twin"): (None, "candidate", "star"),
        ("attribute", "this.m"): ("a::Own.m", "resolved", "this"), ("attribute", "this.nope"): (None, "dynamic", None), ("attribute", "far.go"): ("b::Far.go", "resolved", "type"),
        ("attribute", "this.far.go"): ("b::Far.go", "resolved", "type"), ("attribute", "twin.t"): (None, "candidate", "type"), ("attribute", "mate.run"): (None, "candidate", "type"),
        ("attribute", "gone.x"): (None, "dynamic", None), ("attribute", "far.nope"): (None, "dynamic", None), ("attribute", "Far.nope"): (None, "unresolved", "import"),
        ("attribute", "Own.m"): ("a::Own.m", "resolved", "receiver"), ("attribute", "Twin.t"): (None, "candidate", "star"), ("attribute", "c.d.Deep.x"): ("c.d::Deep.x", "resolved", "full"),
        ("attribute", "c.d.Deep"): ("c.d::Deep", "resolved", "full"), ("other", "f()"): (None, "unresolved", None),
    }
    calls = spark.createDataFrame([(f"{f}:{e}", "A.java", "a", "a::Own.m", f, e) for f, e in wanted], "call string, path string, module string, source string, form string, expr string")
    got = {r["call"]: (r["target"], r["resolution"], r["channel"]) for r in java.resolve_java(calls.union(calls.limit(1)), n, imports, types).collect()}
    assert got == {f"{f}:{e}": v for (f, e), v in wanted.items()}
    inner = spark.createDataFrame([("k", "A.java", "a", "a::Own.Inner.k", "simple", "k"), ("m", "A.java", "a", "a::Own.Inner.k", "simple", "m")], calls.schema)
    assert {r["call"]: r["target"] for r in java.resolve_java(inner, n, imports, types).collect()} == {"k": "a::Own.Inner.k", "m": None}
    assert java.resolve_java(calls.limit(0), n, imports, types).count() == 0


def test_injections(spark):
    n = nodes(spark, *KNOWN)
    imports = spark.createDataFrame([("A.java", "Far", "b", "Far", False, 0), ("A.java", "Ext", "ext", "Ext", False, 1), ("A.java", "*", "b", "*", True, 2), ("A.java", "*", "c", "*", True, 3)], IMPORT)
    d = spark.createDataFrame([
        ("A.java", "a", "a::Own", "Far", "field", ["Autowired"]), ("A.java", "a", "a::Own", "Far", "field", ["Autowired"]), ("A.java", "a", "a::Own", "Mate", "field", ["Lazy"]),
        ("A.java", "a", "a::Own", "Mate", "field", None), ("A.java", "a", "a::Own", "Twin", "constructor", []), ("A.java", "a", "a::Own", "Ext", "constructor", []),
        ("A.java", "a", "a::Mate", "String", "constructor", [])], "path string, module string, owner string, type string, mechanism string, annotations array<string>")
    got = sorted((r["source"], r["target"], r["resolution"], r["rule_id"], r["site_id"] is None) for r in java.injection_edges(d, imports, n, ["Auto*"]).collect())
    assert got == [("a::Own", "b::Far", "resolved", "JAVA-F05", True), ("a::Own", "b::Twin", "candidate", "JAVA-F04", False), ("a::Own", "c::Twin", "candidate", "JAVA-F04", False)]


def test_relative_specifiers(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a/x.ts", "src/a/b/index.js", "src/a/b.vue", "src/c.py", "top.ts")], "path string")
    wanted = {"./x": "a.x", "./x.ts": "a.x", "./b": "a.b.index", "./b/": "a.b.index", "../c": "c", "../../top": "top", "./none": "a.none", "../../../out": None, "..": None, "../..": None, "./b/index": "a.b.index"}
    specs = spark.createDataFrame([("src/a/main.ts", s) for s in [*wanted, "react", "./x"]], "path string, spec string")
    got = {r["spec"]: r["module"] for r in specifiers.relative_modules(specs, files).collect()}
    # .js comes before .vue among the suffixes, so b/index.js is found before b.vue
    assert got == wanted
    assert {r["module"] for r in specifiers.relative_modules(spark.createDataFrame([("main.ts", "./top")], specs.schema), files).collect()} == {"top"}


def test_alias_specifiers(spark):
    modules = spark.createDataFrame([("hooks.x",), ("lib.y",), ("z",)], "module string")
    specs = spark.createDataFrame([("@/hooks/x",), ("@/hooks/x.ts",), ("@/none",), ("y",), ("z",), ("./y",), ("@/",)], "spec string")
    got = {r["spec"]: r["module"] for r in specifiers.canonical_modules(specs, modules, {"@/": "src/"}, "src/lib").collect()}
    assert got == {"@/hooks/x": "hooks.x", "@/hooks/x.ts": "hooks.x", "@/none": "@/none", "y": "lib.y", "z": "z", "./y": "./y", "@/": "@/"}
    assert {r["module"] for r in specifiers.canonical_modules(specs, modules).collect()} == {r["spec"] for r in specs.collect()}


def test_cases(spark):
    n = nodes(spark, *KNOWN)
    named = spark.createDataFrame([("1", 0, "b::Far.go"), ("1", 1, "b::Far.go"), ("2", 0, "no::such")], "case string, ord int, symbol string")
    ranges = spark.createDataFrame([("1", 0, "a.java", 12, 1), ("1", 1, "d.java", 0, 1)], "case string, ord int, file string, start int, count int")
    # `a.java` is no folder's file, so only d.java in c/ meets
    s = cases.case_symbols(named, ranges, n)
    assert sorted((r["case"], r["symbol"], r["rank"]) for r in s.collect()) == [("1", "b::Far.go", 1), ("2", "no::such", 1)]
    reached = spark.createDataFrame([("b::Far.go", "down", "c::Twin", 1), ("b::Far.go", "up", "a::Mate", 1), ("b::Far.go", "up", "b::Far", 2)], "symbol string, direction string, node string, rank long")
    c = cases.candidate_files(s, reached, n)
    assert [(r["case"], r["file"], r["rank"]) for r in c.orderBy("case", "rank").collect()] == [("1", "b.java", 1), ("1", "a.java", 2), ("1", "c.java", 3)]
    gold = spark.createDataFrame([("1", "a.java"), ("1", "c.java"), ("1", "c.java"), ("3", "x")], "case string, file string")
    got = {r["case"]: (r["n_gold"], r["hits_at_k"], r["recall_at_k"], r["precision_at_k"], r["recall_all"], r["precision_all"]) for r in cases.case_scores(c, gold, 2).collect()}
    assert got == {"1": (2, 1, 0.5, 0.5, 1.0, 0.6667), "3": (1, 0, 0.0, 0.0, 0.0, 0.0)}
    asked = spark.createDataFrame([("b::Far.go",), ("no::such",)], "qname string")
    r = {x["symbol"]: x for x in cases.compact_impact(asked, reached, n, spark.createDataFrame([("b::Far.go", "e")], "symbol string, entry string"), 1).collect()}
    assert [v.qname for v in r["b::Far.go"].upstream] == ["a::Mate"] and [v.qname for v in r["b::Far.go"].downstream] == ["c::Twin"] and r["b::Far.go"].n_entries == 1
    assert (r["no::such"].found, r["no::such"].upstream, r["no::such"].n_entries) == (0, [], 0)


def test_candidate_files_travel_to_their_cases_once(spark):
    n = nodes(spark, *KNOWN)
    s = spark.createDataFrame([("1", "b::Far.go", 1), ("1", "a::Own", 2), ("2", "a::Own", 5)], "case string, symbol string, rank long")
    reached = spark.createDataFrame([("a::Own", "up", "b::Far", 1), ("a::Own", "down", "c::Twin", 1), ("b::Far.go", "up", "a::Mate", 1)], "symbol string, direction string, node string, rank long")
    c = cases.candidate_files(s, reached, n)
    assert [tuple(r) for r in c.orderBy("case", "rank").collect()] == [
        ("1", "b.java", 1), ("1", "a.java", 2), ("1", "c.java", 3), ("2", "a.java", 1), ("2", "b.java", 2), ("2", "c.java", 3)]
    plan = c._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("hashpartitioning(case") == 0 and c._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(case") == 1


def test_upkeep(spark):
    before, after = nodes(spark, *KNOWN), nodes(spark, *KNOWN[:-2], "new::Thing.a_b")
    old = search.postings(search.searchable(before), "qname", list(search.FIELDS))
    got = upkeep.update_postings(old, before, after)
    want = search.postings(search.searchable(after), "qname", list(search.FIELDS))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert upkeep.update_postings(old, before, before.limit(0)).count() == 0
    members = spark.createDataFrame([("a::Own", 1), ("gone::X", 1), ("gone::Y", 2)], "qname string, community int")
    kept, sizes = upkeep.keep_members(members, before)
    assert [tuple(r) for r in kept.collect()] == [("a::Own", 1)] and [tuple(r) for r in sizes.collect()] == [(1, 1)]
