"""Resolution of Python calls in a built index: re-exports, super, declared types, listed names, candidates."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import flows, index, python_calls
from codeloom.sources import files

TREE = {
    "pkg/__init__.py": "from pkg.impl import work\nfrom pkg.mid import deep as far\nfrom pkg.left import *\nfrom pkg.right import *\nfrom pkg.loop import spin\n",
    "pkg/impl.py": "def work():\n    pass\n\nclass K:\n    def run(self):\n        pass\n",
    "pkg/mid.py": "from pkg.impl import work as deep\n",
    "pkg/left.py": "def both():\n    pass\n\nclass Twin:\n    def run(self):\n        pass\n",
    "pkg/right.py": "def both():\n    pass\n\nclass Twin:\n    def run(self):\n        pass\n",
    "pkg/loop.py": "from pkg import spin\n",
    "s1.py": "__all__ = ['vis']\n\ndef vis():\n    pass\n\ndef hid():\n    pass\n",
    "app.py": (
        "from pkg import work, far, both, spin, Twin\nimport pkg\nimport pkg.impl\nfrom pkg.impl import K\nfrom s1 import *\n\n"
        "def a():\n    work()\n    far()\n    both()\n    spin()\n    pkg.impl.work()\n    pkg.gone()\n    vis()\n    hid()\n    K.run()\n    nothing.run()\n\n"
        "def b(k: K, t: Twin, d: K = None):\n    k.run()\n    t.run()\n    d.run()\n    k.none()\n\n"
        "class W:\n    w: K\n    def go(self):\n        self.w.run()\n        self.own()\n        def inner():\n            self.own()\n    def own(self):\n        pass\n"
    ),
    "base.py": "class A:\n    def m(self):\n        pass\n\nclass B(A):\n    def m(self):\n        super().m()\n        super().lost()\n\nclass C(A):\n    def m(self):\n        pass\n\nclass D(B, C):\n    def m(self):\n        super().m()\n",
    "two.py": "from pkg.left import *\nfrom pkg.right import *\n\ndef c():\n    both()\n    Twin.run()\n",
}


def built(spark, tree):
    df = spark.createDataFrame(list(tree.items()), "path string, content string").withColumn("module", files.module_of(F.col("path")))
    ir = files.index_input(flows.saved(files.parse_python(df)))
    return ir, index.build(ir, ["a"])


@pytest.fixture(scope="module")
def calls(spark):
    _, out = built(spark, TREE)
    return [r for r in out["edges"].where("kind = 'call'").collect()]


def of(calls, source):
    return {(r.target, r.resolution) for r in calls if r.source == source}


def test_names_and_modules(calls):
    got = of(calls, "app::a")
    assert {("pkg.impl::work", "resolved"), ("pkg.left::both", "candidate"), ("pkg.right::both", "candidate"), ("pkg::spin", "unresolved"),
            ("pkg::gone", "unresolved"), ("s1::vis", "resolved"), ("hid", "unresolved"), ("pkg.impl::K.run", "resolved"), ("nothing.run", "dynamic")} == got
    assert of(calls, "two::c") == {("pkg.left::both", "candidate"), ("pkg.right::both", "candidate"), ("pkg.left::Twin.run", "candidate"), ("pkg.right::Twin.run", "candidate")}


def test_super_and_declared_types(calls):
    assert of(calls, "base::B.m") == {("base::A.m", "resolved"), ("super().lost", "dynamic")}
    assert of(calls, "base::D.m") == {("base::B.m", "candidate"), ("base::C.m", "candidate")}
    assert of(calls, "app::b") == {("pkg.impl::K.run", "resolved"), ("pkg.left::Twin.run", "candidate"), ("pkg.right::Twin.run", "candidate"), ("d.run", "dynamic"), ("k.none", "dynamic")}
    assert of(calls, "app::W.go") == {("pkg.impl::K.run", "resolved"), ("app::W.own", "resolved")}
    assert of(calls, "app::W.go.inner") == {("app::W.own", "resolved")}


def test_sites_and_evidence(calls):
    sites = {r.site_id for r in calls if r.source == "two::c" and r.target.endswith("both")}
    assert len(sites) == 1 and None not in sites
    said = {r.target: json.loads(r.evidence) for r in calls if r.source == "app::a"}
    assert said["nothing.run"] == {"call_form": "attribute", "target_expr": "nothing.run"}
    assert said["pkg.left::both"] == {"n_candidates": 2, "truncated": False} and said["pkg.impl::work"] == {"channel": "import"}
    assert all(r.site_id is None for r in calls if r.resolution != "candidate")


def test_reexport_cycles_and_chains(spark):
    n = 30
    imports = [(f"f{k}", f"m{k}", f"x{k}", f"m{k + 1}", f"x{k + 1}", False, 0) for k in range(n)]
    imports += [("c0", "c0", "y", "c1", "y", False, 0), ("c1", "c1", "y", "c0", "y", False, 0), ("g", "g", "*", "c0", "*", True, 0), ("g", "g", "*", f"m{n - 1}", "*", True, 1)]
    i = spark.createDataFrame(imports, "path string, module string, local string, target_module string, target_name string, is_star boolean, ord int")
    known = spark.createDataFrame([(f"m{n}::x{n}",), ("c1::z",)], "qname string")
    asks = spark.createDataFrame([("m0", "x0"), ("c0", "y"), ("g", f"x{n - 1}"), ("g", "y"), ("c1", "z"), ("none", "q")], "module string, name string")
    got = {(r.module, r.name, r.target) for r in python_calls.reexports(asks, i, known).collect()}
    assert got == {("m0", "x0", f"m{n}::x{n}"), ("g", f"x{n - 1}", f"m{n}::x{n}"), ("c1", "z", "c1::z")}
    assert python_calls.reexports(asks.limit(0), i, known).collect() == []


def test_update_follows_re_exports(spark):
    ir, old = built(spark, TREE)
    changed = TREE | {"pkg/__init__.py": "from pkg.left import both as work\n", "base.py": TREE["base.py"].replace("class B(A)", "class B(C)").replace("class C(A)", "class Z").replace("class A:", "class A:\n    def lost(self):\n        pass\n")}
    now, want = built(spark, changed)
    touched = spark.createDataFrame([("pkg/__init__.py",), ("base.py",)], "path string")
    new, _, _ = index.update(old, now, touched, ["a"])
    rows = lambda t: sorted(map(str, t.select("path", "source", "target", "kind", "resolution", "site_id", "evidence").collect()))
    assert rows(new["edges"]) == rows(want["edges"])
    assert ("app::a", "pkg.left::both", "resolved") in {(r.source, r.target, r.resolution) for r in new["edges"].collect()}
