"""The index of source files: build, upkeep after changes, and reports on small tables."""

from pyspark.sql import functions as F

from codeloom.operators import flows, index, reports
from codeloom.sources import files
from codeloom.sources.store import Store

BASE = {
    "src/app/main.py": "from app.util import *\nfrom app.base import Base as B\nimport app.base\n\nclass Job(B):\n    def go(self):\n        helper()\n        Thing()\n\nclass Other(app.base.Base):\n    pass\n\nclass Lost(Nowhere):\n    pass\n\ndef main():\n    later()\n    x.run()\n",
    "src/app/util.py": "class Thing:\n    def __init__(self):\n        other()\n\ndef helper():\n    return other()\n\ndef other():\n    pass\n",
    "src/app/base.py": "class Base:\n    def stay(self):\n        pass\n",
}
CHANGED = BASE | {
    "src/app/util.py": "class Thing:\n    def __init__(self):\n        pass\n\ndef helper():\n    return 1\n\ndef later():\n    helper()\n",
    "src/app/new.py": "from app.util import helper\n\ndef fresh():\n    helper()\n",
}


def parsed(spark, tree):
    df = spark.createDataFrame(list(tree.items()), "path string, content string").withColumn("module", files.module_of(F.col("path")))
    p = flows.saved(files.parse_python(df))
    ir = {k: files.exploded(p, k) for k in ("nodes", "calls", "imports", "bases")}
    return ir | {"types": spark.createDataFrame([], "scope string, receiver string, type string")}


def rows(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


EDGE = ("path", "source", "target", "kind", "resolution")


def test_build_update_and_store(spark, tmp_path):
    old_ir = parsed(spark, BASE)
    old = index.build(old_ir, ["main"])
    e = set(rows(old["edges"], "source", "target", "kind", "resolution"))
    assert ("app.main::Job", "app.base::Base", "extends", "resolved") in e and ("app.main::Other", "app.base::Base", "extends", "resolved") in e
    assert ("app.main::Lost", "Nowhere", "extends", "unresolved") in e and ("app.main", "app.util", "import", "resolved") in e
    assert ("app.main::Job.go", "app.util::helper", "call", "resolved") in e
    assert ("app.main::Job.go", "app.util::Thing.__init__", "call", "resolved") in e
    assert ("app.main::main", "later", "call", "unresolved") in e and ("app.main::main", "x.run", "call", "dynamic") in e
    assert ("app.main::Job", "app.main::Job.go", "contains", "resolved") in e
    s = Store(spark, str(tmp_path / "index"))
    s.commit(old)
    assert {t: s.read(t).count() for t in index.TABLES} == {t: old[t].count() for t in index.TABLES}
    ir = parsed(spark, CHANGED)
    touched = spark.createDataFrame([("src/app/util.py",), ("src/app/new.py",)], "path string")
    mixed = {k: index.replace_files(old_ir[k], v.join(touched, "path", "left_semi"), touched) if k != "types" else v for k, v in ir.items()}
    new, gone, rebuilt = index.update(old, mixed, touched, ["main"])
    want = index.build(ir, ["main"])
    assert rebuilt and rows(new["edges"], *EDGE) == rows(want["edges"], *EDGE)
    for name, columns in (("nodes", ("qname", "kind", "parent", "path")), ("degrees", ("qname", "in_degree", "out_degree")), ("flows", ("entry", "node", "position"))):
        assert rows(new[name], *columns) == rows(want[name], *columns)
    assert ("app.main::main", "app.util::later", "call", "resolved") in set(rows(new["edges"], "source", "target", "kind", "resolution"))
    was, now = dict(rows(old["nodes"], "qname", "id")), dict(rows(new["nodes"], "qname", "id"))
    assert all(now[q] == i for q, i in was.items() if q in now) and len(set(now.values())) == len(now)
    assert rows(gone, "qname", "upstream") == [("app.util::other", "app.util::Thing.__init__,app.util::helper")]


def test_update_without_structural_change_keeps_flows(spark):
    ir = parsed(spark, BASE)
    old = index.build(ir, ["main"])
    longer = parsed(spark, BASE | {"src/app/base.py": BASE["src/app/base.py"].replace("pass", "return 1")})
    new, gone, rebuilt = index.update(old, longer, spark.createDataFrame([("src/app/base.py",)], "path string"), ["main"])
    assert not rebuilt and gone.count() == 0 and rows(new["edges"], *EDGE) == rows(old["edges"], *EDGE)


def test_empty_index(spark):
    ir = {k: v.where("false") for k, v in parsed(spark, BASE).items()}
    assert {k: v.count() for k, v in index.build(ir).items()} == {"nodes": 0, "edges": 0, "degrees": 0, "flows": 0}


def test_star_names_and_ambiguity(spark):
    imports = spark.createDataFrame([("f", "m", "*", x, "*", True, i) for i, x in enumerate(["a", "b", "c"])], "path string, module string, local string, target_module string, target_name string, is_star boolean, ord int")
    symbols = spark.createDataFrame([("a", "x", "a::x"), ("b", "x", "b::x"), ("c", "y", "c::y")], "module string, name string, qname string")
    asks = spark.createDataFrame([(1, "f", "x"), (2, "f", "y"), (3, "f", "z")], "call int, path string, name string")
    assert rows(index.star_hits(asks, imports, symbols), "call", "target") == [("1", "a::x"), ("1", "b::x"), ("2", "c::y")]
    listed = spark.createDataFrame([("a", []), ("c", ["y"])], "module string, names array<string>")
    assert rows(index.star_hits(asks, imports, symbols, listed), "call", "target") == [("1", "b::x"), ("2", "c::y")]


def test_small_reports(spark):
    t = spark.createDataFrame([("abcdefgh",), ("abcdefghij",), ("a",), ("",), (None,)], "t string").select(reports.token_estimate(F.col("t")).alias("n"))
    assert [x.n for x in t.collect()] == [2, 2, 1, 0, 0]
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(["noise", "@@@c1|p|d|s|t", "", "src/a.py", "@@@c2|p q|d|s"])], "repo string, ord long, line string")
    h = {x["commit"]: (x.parents, x.subject, x.files) for x in reports.read_history(lines).collect()}
    assert h == {"c1": (["p"], "s|t", ["src/a.py"]), "c2": (["p", "q"], "s", [])}
    hunks = spark.createDataFrame([("f", 10), ("f", 20)], "file string, start long")
    asked = spark.createDataFrame([("f", 15), ("f", 10), ("f", 30), ("f", 1), ("g", 1)], "file string, line long")
    got = {(x.file, x.line): (x.start, x.problem) for x in reports.nearest_hunks(asked, hunks).collect()}
    assert got == {("f", 15): (None, "ambiguous"), ("f", 10): (10, None), ("f", 30): (20, None), ("f", 1): (10, None), ("g", 1): (None, "no hunks")}
    p = spark.createDataFrame([("r", "c", 1, "a.py", 5, "Null", None), ("r", "c", 2, "b.py", None, None, "leak")], "run string, case_id string, pred int, file string, line int, title string, description string")
    g = spark.createDataFrame([("c", 1, "x.py", ["a.py"], 4, 6, ["null"]), ("c", 2, "b.py", None, None, None, None), ("c", 3, "b.py", [], 1, 9, [])],
                              "case_id string, gold int, file string, alternates array<string>, line_start int, line_end int, keywords array<string>")
    assert rows(reports.findings_met(p, g), "pred", "gold") == [("1", "1"), ("2", "2")]
