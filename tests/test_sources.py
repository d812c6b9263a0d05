"""Sources and sinks over files written by the test."""

import json

from pyspark.sql import functions as F

from codeloom.operators import evaluate, export, flows, resolve
from codeloom.sources import files
from codeloom.sources.store import Store

CODE = {
    "src/app/main.py": "from app.util import helper as h\nimport app.util\n\n@deco(1)\ndef main(a, b=1):\n    h(a)\n    app.util.other()\n    x = Thing()\n    x.run()\n",
    "src/app/util.py": "class Thing(Base):\n    def run(self):\n        self.stop()\n    def stop(self):\n        pass\n\ndef helper(x):\n    return other()\n\ndef other():\n    pass\n",
    "src/app/bad.py": "def broken(:\n",
    "notes.txt": "no code",
}


def test_python_tree_to_calls(spark, tmp_path):
    for name, text in CODE.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    tree = files.read_tree(spark, str(tmp_path / "repo"))
    assert sorted(x.path for x in tree.collect()) == ["src/app/bad.py", "src/app/main.py", "src/app/util.py"]
    parsed = files.parse_python(tree.select("path", "content", files.module_of(F.col("path")).alias("module"))).cache()
    assert {x.path for x in parsed.where("NOT ok").collect()} == {"src/app/bad.py"}
    nodes = files.exploded(parsed, "nodes")
    assert {x.qname: x.kind for x in nodes.collect()} == {
        "app.main": "module", "app.main::main": "function", "app.util": "module", "app.util::Thing": "class", "app.util::Thing.run": "method",
        "app.util::Thing.stop": "method", "app.util::helper": "function", "app.util::other": "function",
    }
    main = nodes.where("qname = 'app.main::main'").first()
    assert main.decorators == ["deco"] and main.signature == "main(a, b=1)" and main.start_line == 5
    calls = files.exploded(parsed, "calls").withColumn("call", F.concat_ws(":", "path", "line", "name"))
    types = spark.createDataFrame([("app.main::main", "x", "app.util::Thing")], "source string, receiver string, type string").withColumnRenamed("source", "scope")
    r = {x.call.split(":", 1)[1]: (x.resolution, x.target) for x in resolve.resolve_calls(calls, nodes, files.exploded(parsed, "imports"), types).collect()}
    assert r["6:h"] == ("resolved", "app.util::helper") and r["9:run"] == ("resolved", "app.util::Thing.run")
    assert r["8:Thing"] == ("unresolved", None) and r["3:stop"] == ("resolved", "app.util::Thing.stop") and r["8:other"] == ("resolved", "app.util::other")


def test_small_readers(spark, tmp_path):
    df = spark.createDataFrame([("a.vue",), ("b.java",), ("c.txt",)], "p string").select(files.language(F.col("p")).alias("l")).collect()
    assert [x.l for x in df] == ["typescript", "java", None]
    v = spark.createDataFrame([("<t/><script lang='ts'>a</script>\n<script>b</script>",)], "c string").select(files.vue_script(F.col("c"))).first()[0]
    assert v == "a\nb"
    t = tmp_path / "t"
    t.mkdir()
    (t / "one.jsonl").write_text('{"type":"assistant","text":"hi"}\noops\n{"type":"result","result":"r1"}\n{"type":"result","result":"r2"}\n')
    (t / "two.jsonl").write_text('{"type":"assistant","text":"only"}\n')
    got = sorted(x.text for x in evaluate.last_results(files.read_transcripts(spark, str(t))).collect())
    assert got == ["only", "r2"]
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "c1", "changed_ranges": {"a.py": [[1, 2], [5, 9]]}, "gold_files": ["a.py"]}]))
    assert [(x.file, x.start, x.end) for x in files.read_cases(spark, str(tmp_path / "cases.json")).collect()] == [("a.py", 1, 2), ("a.py", 5, 9)]


def test_store_and_export(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"))
    first = s.commit({"nodes": spark.range(3)})
    s.commit({"nodes": spark.range(5)})
    assert s.read("nodes").count() == 5 and s.read("nodes", first).count() == 3
    e = spark.createDataFrame([("m::a", "m::b", "call", "resolved", 1), ("m::b", "m::c", "call", "resolved", 2)], "source string, target string, kind string, resolution string, ord long")
    n = spark.createDataFrame([(f"m::{x}", "function") for x in "abc"], "qname string, kind string")
    payload = json.loads(export.graph_json(e, n).first().json)
    assert len(payload["nodes"]) == 3 and len(payload["links"]) == 2
    f = flows.build_flows(spark.createDataFrame([("m::a",)], "qname string"), e)
    assert [x["node"] for x in json.loads(export.flow_json(f, "m::a").first().json)] == ["m::a", "m::b", "m::c"]
