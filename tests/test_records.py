"""Rules of cases and runs, with every reason."""

import json

from codeloom.sources import records

GOOD = {"id": "g", "changed_symbols": ["a"], "changed_ranges": {"x\\y.py": [[1, 2], [3, 3]]}, "gold_files": ["t\\u.py"], "prompt": "", "repo": "r"}
BAD = [
    ([1], "case {} must be an object"), (GOOD | {"changed_ranges": [1]}, "case g changed_ranges must be an object"), (GOOD | {"changed_ranges": None}, "case g changed_ranges must be an object"),
    (GOOD | {"changed_ranges": {"f": 3}}, "case g has invalid changed_ranges"), (GOOD | {"changed_ranges": {"f": [[2, 1]]}}, "case g has invalid line range"),
    (GOOD | {"changed_ranges": {"f": [[0, 1]]}}, "case g has invalid line range"), (GOOD | {"changed_ranges": {"f": [[1, "2"]]}}, "case g has invalid line range"),
    (GOOD | {"changed_ranges": {"f": [7]}}, "case g has invalid line range"), (GOOD | {"id": ""}, "case {} requires a non-empty id"), (GOOD | {"id": 5}, "case {} requires a non-empty id"),
    (GOOD | {"changed_symbols": ["a", ""]}, "case g has invalid symbols or gold_files"), (GOOD | {"changed_symbols": None}, "case g has invalid symbols or gold_files"),
    (GOOD | {"gold_files": []}, "case g has invalid symbols or gold_files"), (GOOD | {"changed_symbols": [], "changed_ranges": {}}, "case g requires changed_symbols or changed_ranges"),
    (GOOD | {"gold_findings": [1]}, "case g has invalid gold_findings"),
]


def test_cases(spark):
    texts = [json.dumps(GOOD), json.dumps({"id": "h", "changed_symbols": ["a"], "gold_files": ["z"], "gold_findings": []}), *[json.dumps(b) for b, _ in BAD], "{no", None]
    good, bad = records.checked_cases(spark.createDataFrame(list(enumerate(texts)), "position long, record string"))
    got = sorted(tuple(r) for r in good.collect())
    assert got == [("g", ["a"], {"x/y.py": [[1, 2], [3, 3]]}, ["t/u.py"], "r", None, None), ("h", ["a"], {}, ["z"], None, None, None)]
    want = [r.format(i + 2) for i, (_, r) in enumerate(BAD)] + [f"case {len(BAD) + i} must be an object" for i in (2, 3)]
    assert [r.reason for r in bad.orderBy("position").collect()] == want


def test_runs(spark, tmp_path):
    runs = {("a b", m, i): {"result": {"f1": v}} for m in records.MODES for i, v in ((1, 0.5), (2, 1))} | {("c", "diff_only", 1): {"result": {"f1": "x"}}, ("c", "graph_agent", 1): {}}
    runs |= {("d", m, i): {"result": {"f1": 0.25}} for m in records.MODES for i in range(1 + (m == "graph_agent"))}
    for (c, m, i), v in runs.items():
        (tmp_path / c / m).mkdir(parents=True, exist_ok=True)
        (tmp_path / c / m / f"run-{i}.json").write_text(json.dumps(v))
    good, bad = records.scored_runs(spark, f"file://{tmp_path}")
    assert sorted((r["case"], r["mode"]) for r in bad.collect()) == [("c", "diff_only"), ("c", "graph_agent")]
    cover = {r["case"]: (r.repetitions, r.reason) for r in records.run_coverage(good, spark.createDataFrame([("a b",), ("c",), ("d",)], "case string")).collect()}
    assert cover == {"a b": (2, None), "c": (None, "case c has no scored transcripts for: diff_only, graph_agent, hybrid_agent"),
                     "d": (None, "case d has incomplete repetitions: diff_only=1, graph_agent=2, hybrid_agent=1")}
