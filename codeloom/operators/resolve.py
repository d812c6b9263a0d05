"""Reference resolution: prefixes, candidates, re-exports, ancestors, routes and the cascade of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import member
from codeloom.operators.flows import saved

CANDIDATES = 20
#: The rule of edges between a request and a route (a fixed value).
ROUTE_RULE = "JAVA-F01"


def site_id(source: Column, target: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.char(F.lit(0)), target)), 1, 12)


def prefixes(q: Column) -> Column:
    """All prefixes of a dotted name at its dots, itself included."""
    parts = F.split(q, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def longest_prefix(names: DataFrame, known: DataFrame, name: str = "qname", to: str = "known") -> DataFrame:
    """`name`, match: the longest known prefix of each name. Prefixes are exploded and joined by equality."""
    e = names.select(name, F.explode(prefixes(F.col(name))).alias("p")).join(known.select(F.col(to).alias("p")).distinct(), "p")
    return e.groupBy(name).agg(F.max_by("p", F.char_length("p")).alias("match"))


def candidate_fanout(sites: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    """source, expr, site_id, rank, target, truncated: distinct candidate targets of a call site, at most `cap`."""
    w = W.partitionBy("source", "expr")
    d = sites.select("source", "expr", "target").distinct().withColumn("rank", F.row_number().over(w.orderBy("target")).cast("long"))
    total = sites.groupBy("source", "expr").agg(F.countDistinct("target").alias("n"))
    return d.where(F.col("rank") <= cap).join(total, ["source", "expr"]).select(
        "source", "expr", site_id(F.col("source"), F.col("expr")).alias("site_id"), "rank", "target", (F.col("n") > cap).cast("int").alias("truncated")
    )


def closure(start: DataFrame, step: DataFrame, stop: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """key, node, depth: everything reached from (key, node) over (src, dst), each node once at its least depth.

    Semi-naive: only the last level's new nodes are joined again, so cycles end. A branch ends at nodes of `stop`.
    """
    level = saved(start.select("key", "node").distinct().withColumn("depth", F.lit(0)))
    done, depth = level, 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        live = level if stop is None else level.join(stop.select("node"), "node", "left_anti").select("key", "node", "depth")
        nxt = live.join(step, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct()
        level = saved(nxt.join(done.select("key", "node"), ["key", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        done = done.unionByName(level)
    return done


def resolve_reexports(asks: DataFrame, bindings: DataFrame, defined: DataFrame) -> DataFrame:
    """key, resolution, target: names followed through re-exports to where they are defined: one hit is resolved, several are candidates."""
    reached = closure(asks, bindings, stop=defined.select("node"))
    hits = reached.join(defined.select("node"), "node", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return asks.select("key").distinct().join(hits, "key", "left").select(
        "key", F.when(F.coalesce("n", F.lit(0)) == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("candidate").alias("resolution"),
        F.when(F.col("n") == 1, F.col("node")).alias("target"),
    )


def ancestor_members(calls: DataFrame, extends: DataFrame, members: DataFrame) -> DataFrame:
    """call, owner, depth: the nearest ancestors that define a member; a branch ends where it is found. calls: call, cls, name."""
    keyed = calls.select(F.struct("call", "name").alias("key"), F.col("cls").alias("node"))
    steps = extends.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    first = keyed.join(steps, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct()
    level, found, depth, seen = saved(first), None, 0, None
    while not level.isEmpty():
        depth += 1
        hit = saved(level.join(members, (F.col("node") == F.col("owner")) & (F.col("key.name") == F.col("name")), "left_semi").withColumn("depth", F.lit(depth)))
        found = hit if found is None else found.unionByName(hit)
        seen = level if seen is None else seen.unionByName(level)
        rest = level.join(hit.select("key", "node"), ["key", "node"], "left_anti")
        level = saved(rest.join(steps, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct().join(seen, ["key", "node"], "left_anti"))
    if found is None:
        return first.select(F.col("key.call").alias("call"), F.col("node").alias("owner"), F.lit(0).alias("depth")).where("false")
    return found.select("key.call", F.col("node").alias("owner"), "depth")


def match_routes(requests: DataFrame, routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """test, controller, resolution, rule_id: an edge from a test's request (test, method, path) to each route (controller, method, path) that it meets.

    What follows ? or # doesn't count, nor do empty segments; a {x} segment of either side meets any segment. Paths are joined
    by the number of segments and a key of those that are fixed on both sides: each side is laid out once for every
    pattern of templates that the other has, which are few, so the work doesn't grow with requests times routes.
    """
    bare = lambda c: F.regexp_replace(c, r"[?#](?s:.*)$", "")
    seg = lambda c: F.filter(F.split(bare(F.col(c)), "/"), lambda x: x != "")
    shape = lambda s: F.transform(s, lambda x: x.rlike(r"^\{.*\}$"))
    q = requests.select("test", F.col("method").alias("qm"), seg("path").alias("s")).select("*", F.size("s").alias("n"), shape(F.col("s")).alias("qt"))
    r = routes.select("controller", F.col("method").alias("rm"), seg("path").alias("s")).select("*", F.size("s").alias("n"), shape(F.col("s")).alias("rt"))
    key = F.transform("s", lambda x, i: F.when(F.get("qt", i) | F.get("rt", i), F.lit("{}")).otherwise(x)).alias("key")
    q = q.join(r.select("n", "rt").distinct(), "n").select("test", "qm", "n", "qt", "rt", key)
    r = r.join(requests.select(seg("path").alias("s")).select(F.size("s").alias("n"), shape(F.col("s")).alias("qt")).distinct(), "n").select("controller", "rm", "n", "qt", "rt", key)
    met = q.join(r, ["n", "qt", "rt", "key"]).where("qm = rm OR rm = 'ANY'").select("test", "controller").distinct()
    known = nodes.select(F.col("qname").alias("controller"), F.lit("resolved").alias("resolution"))
    return met.join(known, "controller", "left").select("test", "controller", F.coalesce("resolution", F.lit("unresolved")).alias("resolution"), F.lit(ROUTE_RULE).alias("rule_id"))


def cascade(calls: DataFrame, channels: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """call, resolution, target, channel: the first channel that applies decides.

    A channel is (name, hits(call, target), terminal). A call with hits in a channel is resolved there if there is one, and a
    candidate if there are several. A terminal channel also decides for calls that it lists with a null target: unresolved.
    """
    last = len(channels)
    rows = calls.select("call", F.lit(last).alias("o"), F.lit(None).cast("string").alias("target"))
    for order, (_, hits, terminal) in enumerate(channels):
        h = hits if terminal else hits.where("target IS NOT NULL")
        rows = rows.unionByName(h.select("call", F.lit(order).alias("o"), "target"))
    # all rows of a call meet once; none, one or several targets show in the least and the greatest
    ends = rows.repartition("call").groupBy("call", "o").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    best = ends.groupBy("call").agg(F.min(F.struct("o", "low", "high")).alias("x"), F.max("o").alias("end")).where(F.col("end") == last)
    return best.select("call", *_outcome(F.when(F.col("x.o") < last, F.col("x.o")), F.col("x.low"), F.col("x.high"), [c[0] for c in channels]))


def _outcome(order: Column, low: Column, high: Column, names: list[str]) -> list[Column]:
    """resolution, target, channel of a call from the order of the channel that decides, null if none does, and its least and greatest target."""
    label = F.when(order.isNull(), "dynamic").when(low.isNull(), "unresolved").when(low == high, "resolved").otherwise("candidate")
    channel = F.get(F.array(*[F.lit(x) for x in names]), order)
    return [label.alias("resolution"), F.when(order.isNotNull() & (low == high), low).alias("target"), channel.alias("channel")]


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame, types: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """source, target, resolution for Python calls: calls(call, source, module, receiver, name, form).

    simple: local name, imported name, a name of a star import (stars: call, target), else unresolved. attribute: imported module, local class, declared type, self, else dynamic.
    imports(module, local, target_module, target_name, ord), where the last import of a name (the greatest ord) counts; types(scope, receiver, type).
    """
    known = nodes.select(F.col("qname").alias("target"), F.lit(True).alias("there")).distinct()
    names = ("local", "import", "star", "module", "class", "type", "self")
    simple, attribute = F.col("form") == "simple", F.col("form") == "attribute"
    bound = imports.groupBy("module", F.col("local").alias("key")).agg(F.max_by(F.struct("target_module", "target_name"), "ord").alias("b"))
    typed = types.groupBy(F.col("scope").alias("source"), "receiver").agg(F.collect_set("type").alias("types"))
    c = calls.select("call", "source", "module", "receiver", "name", "form", F.when(simple, F.col("name")).when(attribute, F.col("receiver")).alias("key"))
    c = c.join(bound, ["module", "key"], "left").join(typed, ["source", "receiver"], "left")
    to = member(F.col("b.target_module"), F.col("b.target_name"))
    via = member(F.when(F.col("b.target_name").isNull(), F.col("b.target_module")).otherwise(to), F.col("name"))
    own = F.concat_ws(".", F.regexp_extract("source", r"^(.*)\.[^.]*$", 1), "name")

    def tries(channel: str, target: Column) -> Column:
        return F.array(F.struct(F.lit(names.index(channel)).alias("o"), target.alias("target")))

    none = F.expr("CAST(array() AS ARRAY<STRUCT<o:INT,target:STRING>>)")
    only = lambda when, found: F.when(when, found).otherwise(none)
    # what a call may mean is laid out beside it and looked up at once; its first try, which each has, stays for the call itself
    first = F.when(simple, tries("local", F.concat_ws("::", "module", "name"))).when(
        attribute, tries("class", F.concat(F.concat_ws("::", "module", "receiver"), F.lit("."), F.col("name")))).otherwise(
        F.array(F.struct(F.lit(len(names)).alias("o"), F.col("source").alias("target"))))
    of_type = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.struct(F.lit(names.index("type")).alias("o"), F.concat_ws(".", t, "name").alias("target")))
    more = F.concat(
        only(simple & F.col("b").isNotNull(), tries("import", to)), only(attribute & F.col("b").isNotNull(), tries("module", via)),
        only(attribute, of_type), only(attribute & F.col("receiver").isin("self", "cls"), tries("self", own)))
    rows = c.select("call", "source", "form", F.posexplode(F.concat(first, more)).alias("nth", "x"))
    head = F.col("nth") == 0
    rows = rows.select("call", F.when(head, F.col("source")).alias("source"), F.when(head, F.col("form")).alias("form"), head.alias("head"), "x.o", F.coalesce("x.target", F.lit("")).alias("target"))
    if stars is not None:
        rows = rows.unionByName(stars.where("target IS NOT NULL").select("call", F.lit(names.index("star")).alias("o"), "target", F.lit(False).alias("head")), True)
    looked = rows.join(known, "target", "left").withColumn("there", F.col("there").isNotNull() & (F.col("o") < len(names)))
    # an imported name decides even if it isn't known
    applies = F.col("there") | (F.col("o") == names.index("import"))
    per = W.partitionBy("call")
    looked = looked.where(applies | F.col("head")).withColumn("best", F.min(F.when(applies, F.col("o"))).over(per))
    hit = F.when(F.col("there") & (F.col("o") == F.col("best")), F.col("target"))
    looked = looked.withColumn("low", F.min(hit).over(per)).withColumn("high", F.max(hit).over(per)).where("head")
    decided = looked.select("call", "source", "form", *_outcome(F.col("best"), F.col("low"), F.col("high"), list(names)))
    final = F.when((F.col("resolution") == "dynamic") & (F.col("form") != "attribute"), "unresolved").otherwise(F.col("resolution"))
    return decided.select("call", "source", "target", final.alias("resolution"), "channel")
