"""How often rows are dealt out anew, as plans have it."""

from codeloom.operators import budget, index, resolve


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_context_meets_once_by_case(spark):
    """What counts of a context is dealt out by case once; before, each list of it was."""
    snippet = "case string, ord long, qname string, file string, start_line int, end_line int, source string, truncated boolean"
    empty = lambda schema: spark.createDataFrame([("c", *[None] * schema.count(","))], schema)
    got = budget.fit_context(
        empty("case string, symbols array<string>"), empty(snippet), empty(snippet), empty("case string, ord long, symbol string, found boolean, entries array<string>"),
        empty("case string, ord long, direction string, rank long, qname string, file string, line int"), 100)
    assert exchanges(got["cases"]) <= 2
    assert exchanges(got["changed"]) <= 4


def test_calls_are_looked_up_once(spark):
    """What calls may mean is looked up in one exchange and decided in another; before, each channel had two of its own."""
    calls = spark.createDataFrame([("1", "m::K.f", "m", None, "g", "simple"), ("2", "m::K.f", "m", "self", "h", "attribute"), ("2", "m::K.f", "m", "x", "h", "attribute"), ("3", "m::f", "m", None, "f()", "other")],
                                  "call string, source string, module string, receiver string, name string, form string")
    nodes = spark.createDataFrame([("m::K.h",), ("n::g",)], "qname string")
    imports = spark.createDataFrame([("m", "g", "n", "gone", 1), ("m", "g", "n", "g", 2), ("m", "x", "n", None, 1)], "module string, local string, target_module string, target_name string, ord int")
    types = spark.createDataFrame([("m::K.f", "x", "m::K"), ("m::K.f", "x", "n::L")], "scope string, receiver string, type string")
    got = resolve.resolve_calls(calls, nodes, imports, types)
    # two calls of one id are decided together, by the first channel of either
    assert sorted((r["call"], r.target, r.resolution, r.channel) for r in got.collect()) == [
        ("1", "n::g", "resolved", "import"), ("2", "m::K.h", "resolved", "type"), ("2", "m::K.h", "resolved", "type"), ("3", None, "unresolved", None)]
    assert exchanges(got) <= 16


def test_names_are_asked_of_stars_once_a_file(spark):
    """A name of many calls meets a file's star imports once; before, each call did."""
    calls = spark.range(1000).selectExpr("CAST(id AS STRING) AS call", "'f' AS path", "'a' AS name")
    imports = spark.range(50).selectExpr("'f' AS path", "concat('m', id) AS target_module", "true AS is_star")
    symbols = spark.createDataFrame([("m1", "a", "m1::a"), ("m2", "b", "m2::b")], "module string, name string, qname string")
    got = index.star_hits(calls, imports, symbols)
    assert got.count() == 1000 and [r.target for r in got.select("target").distinct().collect()] == ["m1::a"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # the calls come in at the last join, above the one of names and star imports
    assert plan.count("LeftSemi") == 1 and plan.index("Range (0, 1000") < plan.index("Range (0, 50")
