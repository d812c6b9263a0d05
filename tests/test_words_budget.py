"""Names in texts and context under a budget, against plain Python."""

import json
import random
import re

from codeloom.operators import budget, words

SNIPPET = "case string, ord long, qname string, file string, start_line int, end_line int, source string, truncated boolean"


def test_mentions(spark):
    rng = random.Random(3)
    bits = ["Foo", "foo", "Bar_1", "é", "x", ".", "-", " ", "\n", "++", "日本"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (7, "Foo")]
    names = ["Foo", "Bar_1", "foo.Bar_1", "x-x", "é", "日本", "foo x", ".Foo", "Foo.", "Foo", "-", "", None, "x++x"]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    t = spark.createDataFrame(texts, "id long, text string")
    got = sorted((r.id, r.name) for r in words.mentions(t, n).collect())
    want = sorted({(i, k) for i, text in texts if text for k in names if k and k != "-" and re.search(rf"\b{re.escape(k)}\b", text)})
    assert got == want and len(want) > 50
    golds = spark.createDataFrame([("a", 1), ("a", 60), ("a", 99), ("b", 7), ("b", 7)], "case string, file long")
    of = spark.createDataFrame([("a", "x-x"), ("a", None), ("b", "Foo")], "case string, name string")
    kinds = sorted((r["case"], r.file, r.kind) for r in words.gold_kinds(golds, of, t.withColumnRenamed("id", "file")).collect())
    assert kinds == [("a", 1, "direct" if (1, "x-x") in want else "cochange"), ("a", 60, "cochange"), ("a", 99, "cochange"), ("b", 7, "direct")]
    assert words.mentions(t.limit(0), n).count() == 0 and words.mentions(t, n.limit(0)).count() == 0


def plain(p, limit):
    size = lambda: len(json.dumps(p, ensure_ascii=False))
    while size() > limit:
        if p["direct_neighbor_source"]:
            p["direct_neighbor_source"].pop()
            continue
        lists = [i[d] for i in p["graph_evidence"]["impacts"] for d in ("downstream", "upstream") if i[d]]
        if lists:
            lists[0].pop()
            continue
        long = [s for s in p["changed_symbol_source"] if len(s["source"]) > 500]
        if not long:
            break
        s = max(long, key=lambda x: len(x["source"]))
        s["source"], s["truncated"] = s["source"][:-500], True
    return size()


def test_budget(spark):
    rng = random.Random(11)
    limit, payloads = 1400, {}
    text = lambda n: "".join(rng.choice('ab "\\\n\t\x01é日/') for _ in range(n))
    snippet = lambda n: {"qname": text(5), "file": text(4), "start_line": rng.randrange(200), "end_line": 7, "source": text(n), "truncated": rng.random() < 0.3}
    near = lambda: [{"qname": text(6), "file": text(3), "line": rng.randrange(1000)} for _ in range(rng.randrange(5))]
    for i in range(25):
        payloads[f"c{i}"] = {
            "changed_symbol_source": [snippet(rng.choice([0, 499, 500, 501, 1200, 1200])) for _ in range(rng.randrange(4))],
            "direct_neighbor_source": [snippet(rng.randrange(400)) for _ in range(rng.randrange(5))],
            "graph_evidence": {"changed_symbols": [text(4) for _ in range(rng.randrange(3))], "impacts": [
                {"symbol": text(3), "found": rng.random() < 0.5, "affected_entries": [text(3) for _ in range(rng.randrange(3))], "upstream": near(), "downstream": near()}
                for _ in range(rng.randrange(4))]},
            "max_chars": limit, "serialized_chars": 0}
    snippets = lambda k: spark.createDataFrame([(c, i, *s.values()) for c, p in payloads.items() for i, s in enumerate(p[k])], SNIPPET)
    ev = [(c, p["graph_evidence"]) for c, p in payloads.items()]
    got = budget.fit_context(
        spark.createDataFrame([(c, e["changed_symbols"] or None) for c, e in ev], "case string, symbols array<string>"),
        snippets("changed_symbol_source"), snippets("direct_neighbor_source"),
        spark.createDataFrame([(c, i, x["symbol"], x["found"], x["affected_entries"]) for c, e in ev for i, x in enumerate(e["impacts"])],
                              "case string, ord long, symbol string, found boolean, entries array<string>"),
        spark.createDataFrame([(c, i, d, k, *n.values()) for c, e in ev for i, x in enumerate(e["impacts"]) for d in ("upstream", "downstream") for k, n in enumerate(x[d])],
                              "case string, ord long, direction string, rank long, qname string, file string, line int"), limit)
    rows = {k: [tuple(r) for r in v.collect()] for k, v in got.items()}
    sizes = {c: plain(p, limit) for c, p in payloads.items()}
    assert dict(rows["cases"]) == sizes and any(s > limit for s in sizes.values()) and sum(s <= limit for s in sizes.values()) > 5
    flat = lambda k: sorted((c, i, *s.values()) for c, p in payloads.items() for i, s in enumerate(p[k]))
    assert sorted(rows["changed"]) == flat("changed_symbol_source")
    assert sorted(rows["neighbors"]) == flat("direct_neighbor_source")
    assert sorted(rows["nodes"]) == sorted((c, i, d, k, *n.values()) for c, p in payloads.items() for i, x in enumerate(p["graph_evidence"]["impacts"])
                                           for d in ("upstream", "downstream") for k, n in enumerate(x[d]))
