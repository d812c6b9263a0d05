"""Flows brought up to date against flows built from scratch."""

import random

from pyspark.sql import functions as F

from codeloom.operators import flow_upkeep, flows

CALL = "source string, target string, kind string, resolution string, ord long"


def calls(spark, rows):
    return spark.createDataFrame([(s, t, "call", "resolved", i) for s, t, i in rows], CALL)


def all_rows(f):
    return sorted(tuple(r) for r in f.select("entry", "node", "position", "depth").collect())


def entries(spark, names):
    return spark.createDataFrame([(n,) for n in names], "qname string")


def test_random_edits_equal_a_rebuild(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    for depth in (None, 2):
        rows = [(rng.choice(names), rng.choice(names), i) for i in range(24)]
        asked = set(names[:8])
        before = calls(spark, rows)
        old = flows.saved(flows.build_flows(entries(spark, asked), before, depth))
        for step in range(3):
            rows = [r for r in rows if rng.random() > 0.1] + [(rng.choice(names), rng.choice(names), 100 * step + 50)]
            # lines shift, and some calls change places
            rows = [(s, t, i + 7 if rng.random() > 0.1 else rng.randrange(60)) for s, t, i in rows]
            asked = (asked | {rng.choice(names)}) - {rng.choice(names)}
            after = calls(spark, rows)
            new, states = flow_upkeep.update_flows(old, entries(spark, asked), before, after, depth)
            new = flows.saved(new)
            assert all_rows(new) == all_rows(flows.build_flows(entries(spark, asked), after, depth))
            assert {r.entry for r in states.where("state <> 'gone'").collect()} == asked
            if depth is None:
                found = flow_upkeep.states_by_search(old.where("position = 0").select(F.col("entry").alias("qname")), entries(spark, asked), before, after)
                assert sorted(tuple(r) for r in found.collect()) == sorted((r.entry, r.state) for r in states.collect())
            old, before = new, after


def test_what_did_not_move_stays(spark):
    chain = [(f"a{i}", f"a{i + 1}", i) for i in range(6)] + [("b0", "b1", 0), ("b0", "b2", 1)]
    before, asked = calls(spark, chain), entries(spark, ["a0", "b0"])
    old = flows.saved(flows.build_flows(asked, before))
    # the lines of b shift, a4 calls another node
    after = calls(spark, [(s, "z" if s == "a4" else t, i + 9) for s, t, i in chain])
    new, states = flow_upkeep.update_flows(old, asked, before, after)
    assert sorted(tuple(r) for r in states.collect()) == [("a0", "grown", 4), ("b0", "kept", None)]
    assert [r.node for r in new.where("entry = 'a0'").orderBy("position").collect()] == ["a0", "a1", "a2", "a3", "a4", "z"]
    assert {(r.state, r.flows, r.share) for r in flow_upkeep.state_counts(states).collect()} == {("grown", 1, 0.5), ("kept", 1, 0.5)}
    # two calls change places: the order counts
    swapped = calls(spark, [(s, t, 5 - i if s == "b0" else i) for s, t, i in chain])
    new, states = flow_upkeep.update_flows(old, asked, before, swapped)
    assert {r.entry: r.state for r in states.collect()} == {"a0": "kept", "b0": "grown"}
    assert [r.node for r in new.where("entry = 'b0'").orderBy("position").collect()] == ["b0", "b2", "b1"]


def test_empty_and_null(spark):
    none, nobody = calls(spark, []), entries(spark, [])
    old = flows.build_flows(nobody, none)
    new, states = flow_upkeep.update_flows(old, nobody, none, none)
    assert new.count() == 0 and states.count() == 0
    odd = spark.createDataFrame([(None, "a", "call", "resolved", 0), ("a", None, "call", "resolved", 1), ("a", "b", "call", "resolved", None)], CALL)
    new, states = flow_upkeep.update_flows(old, entries(spark, ["a"]), none, odd)
    assert all_rows(new.where(F.col("node").isNotNull())) == all_rows(flows.build_flows(entries(spark, ["a"]), odd).where(F.col("node").isNotNull()))


def test_entries_that_nothing_calls_get_their_flows_from_their_callees(spark, monkeypatch):
    rng = random.Random(5)
    inner, outer = [f"n{i}" for i in range(9)], [f"e{i}" for i in range(40)]
    rows = [(rng.choice(inner), rng.choice(inner), rng.randrange(6)) for _ in range(16)]
    rows += [(e, rng.choice(inner), rng.randrange(4)) for e in outer for _ in range(3)]
    rows, asked = [r for r in rows if r[0] != "e0"], outer + ["n1", "n2", "alone"]
    c = spark.createDataFrame([(s, t, "call", "resolved", i) for s, t, i in rows], CALL)
    monkeypatch.setattr(flows, "BLOCK", 2)
    grown, plain = [], flows.grow
    monkeypatch.setattr(flows, "grow", lambda level, *rest: (grown.append(level.count()), plain(level, *rest))[1])
    for depth in (None, 0, 1, 2):
        got = flows.build_flows(entries(spark, asked), c, depth)
        first = flows.saved(flows.start(entries(spark, asked)))
        want = plain(first, first.drop("top"), flows.saved(flows.adjacency(c)), depth)
        order = lambda f: sorted((tuple(r) for r in f.select("entry", "position", "node", "depth").collect()), key=str)
        assert order(got) == order(want)
    # the search starts from what is called, not from each entry
    assert max(grown) <= len(inner)
