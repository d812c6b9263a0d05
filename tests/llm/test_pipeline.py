"""The pipeline's stages in a row against what each is to do."""

import random
from collections import Counter

import corpus_pipeline

from codeloom.llm import registry
from codeloom.llm.io import materialise, table
from tests.llm.test_llm import brute_components, line_fails, prose, shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passes(text):
    """The base rules and the line rules in plain Python: the cleaned text, or None."""
    words = (text or "").split()
    runs = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = (text or "").split("\n")
    lost = sum(len("".join(x.split())) for x in lines if line_fails(x))
    if len(words) < 10 or 100 * len(inside) > 20 * len(words) or 100 * lost > 60 * sum(map(len, words)):
        return None
    return "\n".join(x for x in lines if not line_fails(x))


def expected(rows, items):
    """What should be left before mixing: (doc_id, cleaned text), rows that repeat once."""
    clean = [(i, t) for i, t in ((i, passes(t)) for i, t in rows) if t is not None]
    ids = sorted({(i, t) for i, t in clean if i is not None})
    component = brute_components(list(enumerate(t for _, t in ids)))
    kept, seen = [x for x in clean if x[0] is None], set()
    for k, (i, t) in enumerate(ids):
        if not shingles(t) or component[k][1] not in seen:
            seen.add(component[k][1])
            kept.append((i, t))
    return [(i, t) for i, t in kept if not any(x in t for x in items)]


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(40)
    items = [prose(rng, 40) for _ in range(3)]
    rows = [(i, f"{prose(rng, 40)}.\n{prose(rng, 15)}, and so on.", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more", "s0") for i in range(5)]  # near copies
    rows += [(200 + i, f"{prose(rng, 20)}. {items[i]} {prose(rng, 20)}.", "s1") for i in range(3)]
    rows += [(300, f"{prose(rng, 30)}.\nHome | About | Contact\n{prose(rng, 9)}.", "s2"), (301, "w " * 60, "s2"), (302, "short", None)]
    rows += [(None, f"{prose(rng, 30)}.", None), (None, None, "s1"), (303, None, "s0"), (304, "", "s0")]
    rows += [rows[3], rows[3], (3, f"{prose(rng, 33)}.", "s0"), (400, " ".join(f"x{k}y" for k in range(60_000)) + ".", "s1")]
    folder = str(tmp_path / "sf")
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    d.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*d.columns, "mix_rank", "shard_id"] and sorted(x.mix_rank for x in out.collect()) == list(range(out.count()))
    got = out.collect()
    want = expected([(i, t) for i, t, _ in rows], items)
    assert {(x.doc_id, x.text) for x in got} == set(want)
    assert all(x.n_chars == len(x.text) for x in got)
    assert max(Counter((x.doc_id, x.text) for x in got).values()) <= 2 and not any("Home | About" in x.text for x in got)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, raw = docs.columns, [(x.doc_id, x.text) for x in docs.collect()]
    items = [x.text for x in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, SF))
        now = [(x.doc_id, x.text) for x in docs.collect()]
        if name == "quality_rules":
            assert sorted(now) == sorted((i, c) for i, c in ((i, passes(t)) for i, t in raw) if c is not None)
            assert any(c != dict(raw)[i] for i, c in now)
        if name == "minhash_near_dedup":
            component = brute_components([(x.doc_id, x.text) for x in before.collect()])
            assert {i for i, _ in now} == {i for i, (_, c) in component.items() if i == c}
        if name == "benchmark_decontamination":
            leaks = {x.doc_id for x in before.collect() if any(t in x.text for t in items)}
            assert leaks and {i for i, _ in now} == {x.doc_id for x in before.collect()} - leaks
        if name == "source_mixing":
            assert {i for i, _ in now} == {x.doc_id for x in before.collect()}
            mixed = [(x.doc_id, x.text) for x in stage(spark, before, SF).collect()]
            n = Counter(now)
            assert max(n.values()) == 2
        if name == "sharding":
            assert docs.columns == [*columns, "mix_rank", "shard_id"]
            # the order of the mix is there again, however the files were dealt
            assert [(x.doc_id, x.text) for x in docs.orderBy("mix_rank").collect()] == mixed
        else:
            assert docs.columns == columns


def test_registry_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
