"""The index of parsed files: numbered nodes, structural edges, one call to build all tables, and upkeep after changes.

Parsed files come as tables over all files, each with path and module: nodes, calls, imports, bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import glob_match, member, short
from codeloom.operators import flow_upkeep, flows, graph
from codeloom.operators.changes import repair_resolutions, tombstones
from codeloom.operators.python_calls import resolve_python, truncated
from codeloom.operators.resolve import cascade, closure, prefixes

#: Tables of an index.
TABLES = ("nodes", "edges", "degrees", "flows")


def path_match(path: Column, patterns: list[str]) -> Column:
    """Whether a path meets a glob, or the path or its last part meets the glob without the stars and slashes at its start."""
    bare = [p.lstrip("*/") for p in patterns]
    return glob_match(path, patterns + bare) | glob_match(F.substring_index(path, "/", -1), bare)


def is_test(path: Column, qname: Column, decorators: Column, paths: list[str], names: list[str], marks: list[str]) -> Column:
    """1 where the path, the short name or any decorator meets its globs, else 0."""
    marked = F.coalesce(F.exists(decorators, lambda d: glob_match(d, marks)), F.lit(False))
    return (path_match(path, paths) | glob_match(short(qname), names) | marked).cast("int")


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with id and parent_id: of a name the first by path and line stays; an unknown parent is null.

    Ids count by name within blocks of a hash of the name, whose sizes are summed first, so no task orders all nodes.
    """
    first = graph.keep_first(nodes, ["qname"], ["path", "start_line"]).withColumn("_b", F.pmod(F.xxhash64("qname"), F.lit(256)))
    sizes = first.groupBy("_b").agg(F.count("*").alias("_n"))
    # one row a block, 256 at most
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("qname"))
    numbered = flows.saved(first.join(F.broadcast(starts), "_b").withColumn("id", F.col("_s") + rank).drop("_b", "_s"))
    parents = numbered.select(F.col("qname").alias("parent"), F.col("id").alias("parent_id"))
    return numbered.join(parents, "parent", "left")


def _labelled(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    known = nodes.select(F.col("qname").alias(end), F.lit("resolved").alias("resolution")).distinct()
    return edges.join(known, end, "left").withColumn("resolution", F.coalesce("resolution", F.lit("unresolved")))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """path, source, target, kind, resolution: each node below its parent, or below its module where it has none; unresolved if the parent is unknown."""
    e = nodes.select("path", F.coalesce("parent", F.when(F.col("qname") != F.col("module"), F.col("module"))).alias("source"), F.col("qname").alias("target"))
    return _labelled(e.where("source IS NOT NULL"), nodes, "source").select("path", "source", "target", F.lit("contains").alias("kind"), "resolution")


def import_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge for every imported name, from its module to the module that it comes from; names of classes are none."""
    e = imports.where(~F.col("target_module").contains("::")).select("path", F.col("module").alias("source"), F.col("target_module").alias("target"))
    return _labelled(e, nodes, "target").select("path", "source", "target", F.lit("import").alias("kind"), "resolution")


def module_symbols(nodes: DataFrame) -> DataFrame:
    """module, name, qname: functions and classes by short name; of several the last by path and line counts, then by name."""
    n = nodes.where("kind IN ('function', 'class')").select("module", short(F.col("qname")).alias("name"), "qname", F.struct("path", "start_line", "qname").alias("at"))
    return n.groupBy("module", "name").agg(F.max_by("qname", "at").alias("qname"))


def star_hits(asks: DataFrame, imports: DataFrame, symbols: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """call, target: what a name asked for in a file (call, path, name) may be through that file's star imports.

    listed(module, names) are the modules that state which names a star shows; others show all.
    """
    stars = imports.where("is_star").select("path", F.col("target_module").alias("module")).distinct()
    # a name is looked for once in a file, however many calls use it, and only if anything is called so
    names = asks.select("path", "name").distinct().join(symbols.select("name").distinct(), "name", "left_semi")
    hits = names.join(stars, "path").join(symbols, ["module", "name"])
    if listed is not None:
        hits = hits.join(listed, "module", "left").where("names IS NULL OR array_contains(names, name)")
    hits = hits.select("path", "name", F.col("qname").alias("target")).distinct()
    return asks.select("call", "path", "name").join(hits, ["path", "name"]).select("call", "target").distinct()


def last_bindings(imports: DataFrame) -> DataFrame:
    """path, local, target_module, target_name: of the imports of a name in a file the last counts."""
    return imports.groupBy("path", "local").agg(F.max_by(F.struct("target_module", "target_name"), "ord").alias("b")).select("path", "local", "b.*")


def inherit_edges(bases: DataFrame, imports: DataFrame, nodes: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """path, source, target, kind, resolution of bases(path, module, cls, base[, relation]).

    A base is looked for by its full name, in its own module, through the file's imports (the name itself, or the part before
    its first dot, or a whole imported module) and at last through star imports, where it must be unique. What isn't found keeps its text, unresolved.
    """
    relation = F.col("relation") if "relation" in bases.columns else F.lit("extends")
    b = bases.select("path", "module", "cls", "base", relation.alias("kind")).withColumn("call", F.struct("path", "cls", "base", "kind"))
    known = nodes.select(F.col("qname").alias("target")).distinct()
    exists = lambda d: d.join(known, "target", "left_semi").select("call", "target")
    plain, bound = b.where(~F.col("base").contains("::")), last_bindings(imports)
    own = plain.select("call", F.concat_ws("::", "module", "base").alias("target"))
    whole = b.join(bound.withColumnRenamed("local", "base"), ["path", "base"]).select(
        "call", F.when(F.col("target_name").isNull(), F.col("target_module")).otherwise(member(F.col("target_module"), F.col("target_name"))).alias("target"))
    dotted = b.where(F.col("base").contains(".")).withColumn("local", F.substring_index("base", ".", 1)).join(bound, ["path", "local"])
    # a name bound as a whole decides; only others are taken apart
    dotted = dotted.join(whole.select("call"), "call", "left_anti").select(
        "call", F.concat_ws("::", "target_module", F.expr("substr(base, length(local) + 2)")).alias("target"))
    # `import a.b` also lets a.b.C be named in full
    full = imports.where("target_name IS NULL").select("path", "target_module").distinct()
    full = b.withColumn("target_module", F.expr("substring_index(base, '.', size(split(base, '[.]')) - 1)")).join(full, ["path", "target_module"]).select(
        "call", F.concat_ws("::", "target_module", F.substring_index("base", ".", -1)).alias("target"))
    stars = star_hits(plain.select("call", "path", F.col("base").alias("name")), imports, module_symbols(nodes), listed)
    decided = cascade(b, [
        ("exact", exists(b.select("call", F.col("base").alias("target"))), False), ("module", exists(own), False),
        ("import", exists(whole.unionByName(dotted).unionByName(full)), False), ("star", stars, False),
    ])
    found = F.col("resolution") == "resolved"
    return b.join(decided.select("call", "resolution", "target"), "call").select(
        "path", F.col("cls").alias("source"), F.when(found, F.col("target")).otherwise(F.col("base")).alias("target"), "kind",
        F.when(found, "resolved").otherwise("unresolved").alias("resolution"))


def constructor_edges(edges: DataFrame, nodes: DataFrame, name: str = "__init__") -> DataFrame:
    """For every resolved call of a class an edge to its constructor, where it has one."""
    made = nodes.where("kind = 'method'").where(short(F.col("qname")) == name).select(
        F.col("parent").alias("target"), F.col("qname").alias("made")).join(nodes.where("kind = 'class'").select(F.col("qname").alias("target")), "target", "left_semi")
    return edges.where("resolution = 'resolved'").join(made, "target").withColumn("target", F.col("made")).select(edges.columns)


def extends_of(inherits: DataFrame) -> DataFrame:
    """source, target of resolved bases."""
    return inherits.where("kind = 'extends' AND resolution = 'resolved'").select("source", "target").distinct()


def call_edges(
    calls: DataFrame, nodes: DataFrame, imports: DataFrame, types: DataFrame, listed: DataFrame | None = None, extends: DataFrame | None = None
) -> DataFrame:
    """Call edges of one pair once, at its first line; calls of classes reach their constructors too; a target that isn't known keeps the name looked for.

    evidence is JSON: the form and text of a dynamic call, the number of candidates and whether they were cut for a candidate, the channel that found others.
    """
    if extends is None:
        extends = nodes.sparkSession.createDataFrame([], "source string, target string")
    text = F.when(F.coalesce("receiver", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "receiver", "name"))
    lines = calls.groupBy("path", "source", text.alias("expr"), "form").agg(F.min("line").alias("line"))
    r = resolve_python(calls, nodes, imports, types, extends, listed).join(lines, ["path", "source", "expr", "form"])
    said = F.when(F.col("resolution") == "dynamic", F.to_json(F.struct(F.col("form").alias("call_form"), F.col("expr").alias("target_expr")))).when(
        F.col("resolution") == "candidate", F.to_json(F.struct(F.col("n_candidates"), truncated(F.col("n_candidates")).alias("truncated")))
    ).otherwise(F.to_json(F.struct("channel")))
    r = r.select("path", "source", "target", "resolution", "line", "site_id", said.alias("evidence"))
    r = r.unionByName(constructor_edges(r, nodes))
    return graph.keep_first(r, ["source", "target"], ["line", "resolution", "path"]).select(
        "path", "source", "target", F.lit("call").alias("kind"), "resolution", F.col("line").cast("long").alias("ord"), "site_id", "evidence")


def _plain(edges: DataFrame) -> DataFrame:
    """Edges without an order among calls, a site or evidence."""
    return edges.select("*", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("string").alias("evidence"))


def edges_of(ir: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """All edges of parsed files; parallel contains, import and inherit edges stay."""
    inherits = flows.saved(inherit_edges(ir["bases"], ir["imports"], nodes, ir.get("listed")))
    e = call_edges(ir["calls"], nodes, ir["imports"], ir["types"], ir.get("listed"), extends_of(inherits))
    for more in (contains_edges(nodes), import_edges(ir["imports"], nodes), inherits):
        e = e.unionByName(_plain(more))
    return e


def finish(nodes: DataFrame, edges: DataFrame, names: list[str], decorators: list[str]) -> dict[str, DataFrame]:
    """The tables of an index over its nodes and edges."""
    f = flows.build_flows(flows.entry_nodes(nodes, edges, names, decorators), edges)
    return {"nodes": nodes, "edges": edges, "degrees": graph.degrees(edges, nodes), "flows": f}


def build(ir: dict[str, DataFrame], names: list[str] = (), decorators: list[str] = ()) -> dict[str, DataFrame]:
    """nodes, edges, degrees and flows of parsed files: nodes, calls, imports, bases, types(scope, receiver, type) and, if known, listed(module, names)."""
    nodes = flows.saved(number_nodes(ir["nodes"]))
    return finish(nodes, flows.saved(edges_of(ir, nodes)), list(names), list(decorators))


def replace_files(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """A table of parsed files with the rows of the touched files(path) replaced."""
    return old.join(touched.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n, digest of what flows depend on: functions and methods with their decorators, and the call edges that can be followed.

    Row hashes are summed as decimals, so the order of rows doesn't matter and repeated rows count.
    """
    n = nodes.where("kind IN ('function', 'method')").select(F.xxhash64(F.lit("n"), "qname", "kind", "path", F.sort_array("decorators")).alias("h"))
    e = flows.traversable_calls(edges).select(F.xxhash64(F.lit("e"), "source", "target", "resolution").alias("h"))
    both = n.unionByName(e)
    return both.agg(F.count("*").alias("n"), F.sha2(F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("digest"))


def update(
    old: dict[str, DataFrame], ir: dict[str, DataFrame], touched: DataFrame, names: list[str] = (), decorators: list[str] = ()
) -> tuple[dict[str, DataFrame], DataFrame, bool]:
    """The index after files changed, tombstones of what vanished, and whether flows were brought up to date.

    ir holds the parsed files as they are now, touched(path) those that changed, came or went. Nodes that were known keep
    their ids, new ones get ids from the largest on. Only edges of touched files are resolved again, against all nodes;
    labels of the others are mended, and other edges that could find a new target are those whose text names a
    new symbol: their files are resolved again too. If the digest of what flows depend on changed, those that go on from a node whose calls changed
    grow again from there (`flow_upkeep`); others stay.
    """
    was = old["nodes"]
    fresh = graph.keep_first(ir["nodes"], ["qname"], ["path", "start_line"])
    known = fresh.join(was.select("qname", "id"), "qname", "left")
    new = number_nodes(known.where("id IS NULL").drop("id")).drop("parent_id")
    top = was.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top")).drop("top")
    every = flows.saved(known.where("id IS NOT NULL").unionByName(new))
    ids = every.select(F.col("qname").alias("parent"), F.col("id").alias("parent_id"))
    nodes = flows.saved(every.join(ids, "parent", "left"))
    # a name that came or went may change what any file that uses its last part refers to
    both = was.select("qname", F.lit(1).alias("n")).union(nodes.select("qname", F.lit(-1)))
    moved = flows.saved(both.groupBy("qname").agg(F.sum("n").alias("n")).where("n <> 0").select(short(F.col("qname")).alias("name"), "qname"))
    uses = ir["calls"].select("path", "name").union(ir["bases"].select("path", F.substring_index("base", ".", -1))).union(
        ir["imports"].select("path", F.coalesce("target_name", "target_module")))
    asked = uses.join(moved.select("name").union(moved.select("qname")), "name", "left_semi").select("path")
    changed = touched.join(was.select("path", "module").union(nodes.select("path", "module")), "path").select("module").distinct()
    again = flows.saved(touched.select("path").union(asked).union(_importers(ir["imports"], moved)).union(_dependents(ir["imports"], changed)).distinct())
    part = {k: v.join(again, "path", "left_semi") for k, v in ir.items() if k in ("calls", "imports", "bases")}
    kept = old["edges"].join(again, "path", "left_anti").where("kind <> 'contains'")
    # edges below a parent are one for each node and cheap, so they are made anew
    inherits = flows.saved(inherit_edges(part["bases"], part["imports"], nodes, ir.get("listed")))
    extends = extends_of(kept.select("source", "target", "kind", "resolution").unionByName(inherits.select("source", "target", "kind", "resolution")))
    # a re-export may lead through files that didn't change, so all imports take part
    redone = call_edges(part["calls"], nodes, ir["imports"], ir["types"], ir.get("listed"), extends)
    for more in (import_edges(part["imports"], nodes), inherits, contains_edges(nodes)):
        redone = redone.unionByName(_plain(more))
    edges = flows.saved(repair_resolutions(kept, nodes).unionByName(redone).select(old["edges"].columns))
    gone = tombstones(was.withColumn("file", F.col("path")), nodes, old["edges"])
    same = digest(was, old["edges"]).first() == digest(nodes, edges).first()
    f = old["flows"]
    if not same:
        entries = flows.entry_nodes(nodes, edges, list(names), list(decorators))
        f = flows.build_flows(entries, edges) if f is None else flow_upkeep.update_flows(f, entries, old["edges"], edges)[0]
    return {"nodes": nodes, "edges": edges, "degrees": graph.degrees(edges, nodes), "flows": f}, gone, not same


def _importers(imports: DataFrame, moved: DataFrame) -> DataFrame:
    """Files with a star import of a module in which a name came or went."""
    changed = moved.select(F.substring_index("qname", "::", 1).alias("target_module")).distinct()
    return imports.where("is_star").join(changed, "target_module", "left_semi").select("path")


def _dependents(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import one of changed(module), or a module that does: what a name of theirs leads to may have changed."""
    uses = imports.select("path", "module", F.explode(prefixes(F.col("target_module"))).alias("src")).distinct()
    reached = closure(changed.select(F.lit(1).alias("key"), F.col("module").alias("node")), uses.select("src", F.col("module").alias("dst")).distinct())
    return uses.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select("path")
