"""Resolution of Java calls, declared types and injected dependencies, as joins over all files at once.

Calls are (call, path, module, source, form, expr), imports (path, local, target_module, target_name, is_star, ord) with a
null target_name where a class or package is imported as a whole, types (source, receiver, type). A module is a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import glob_match, member
from codeloom.operators.graph import keep_first
from codeloom.operators.index import last_bindings, module_symbols, star_hits
from codeloom.operators.resolve import CANDIDATES, cascade, prefixes, site_id

#: Rules of edges to what is injected (fixed values).
CONSTRUCTOR_RULE, FIELD_RULE = "JAVA-F04", "JAVA-F05"


def _bound(imports: DataFrame) -> DataFrame:
    """path, name, target of what each file imports by name."""
    b = last_bindings(imports.where("NOT is_star"))
    whole = F.when(F.col("target_name").isNull(), F.col("target_module")).otherwise(member(F.col("target_module"), F.col("target_name")))
    return b.select("path", F.col("local").alias("name"), whole.alias("target"))


def type_hits(asks: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """call, target: the classes that a type's name may mean for asks(call, path, module, name).

    A class of the package and an imported one both count, the imported one whether it is known or not; star imports
    are asked only where neither is there.
    """
    own = asks.join(symbols, ["module", "name"]).select("call", F.col("qname").alias("target"))
    near = own.unionByName(asks.join(_bound(imports), ["path", "name"]).select("call", "target")).distinct()
    far = star_hits(asks.join(near.select("call").distinct(), "call", "left_anti"), imports, symbols)
    return near.unionByName(far)


def enclosing_members(asks: DataFrame, nodes: DataFrame) -> DataFrame:
    """call, target: the known member called name in the innermost class around asks(call, source, name)."""
    scopes = asks.select("call", "name", "source", F.explode(prefixes(F.col("source"))).alias("cls")).where("cls <> source")
    inner = scopes.join(nodes.where("kind = 'class'").select(F.col("qname").alias("cls")).distinct(), "cls").groupBy("call", "name").agg(
        F.max_by("cls", F.char_length("cls")).alias("cls"))
    return _known(inner.select("call", F.concat_ws(".", "cls", "name").alias("target")), nodes)


def _known(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    return hits.join(nodes.select(F.col("qname").alias("target")).distinct(), "target", "left_semi").select("call", "target")


def _decisive(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits that decide: a single target that isn't known is null, several stay as they are."""
    per = W.partitionBy("call")
    h = hits.distinct().withColumn("many", F.count("*").over(per) > 1)
    there = nodes.select(F.col("qname").alias("target"), F.lit(True).alias("there")).distinct()
    return h.join(there, "target", "left").select("call", F.when(F.col("many") | F.col("there"), F.col("target")).alias("target"))


def dotted_hits(asks: DataFrame, symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """call, target: known targets of names in full, asks(call, expr): the longest leading package, a symbol of it, its members."""
    parts = F.split("expr", r"\.")
    cut = F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i")
    e = asks.select("call", parts.alias("p")).where("size(p) > 1").select("call", "p", cut).select(
        "call", "i", F.array_join(F.slice("p", F.lit(1), F.col("i")), ".").alias("module"), F.get("p", F.col("i")).alias("name"),
        F.array_join(F.slice("p", F.col("i") + 2, F.size("p")), ".").alias("rest"))
    to = F.when(F.col("rest") == "", F.col("qname")).otherwise(F.concat_ws(".", "qname", "rest"))
    hits = e.join(symbols, ["module", "name"]).select("call", "i", to.alias("target"))
    hits = hits.join(nodes.select(F.col("qname").alias("target")).distinct(), "target", "left_semi")
    return hits.groupBy("call").agg(F.max_by("target", "i").alias("target"))


def resolve_java(calls: DataFrame, nodes: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """call, source, target, resolution, channel of Java calls; the first channel that applies decides.

    simple (expr is a name): the package, an import, the innermost class around, star imports; else unresolved. construct: the first
    known class of package and import, then star imports; else unresolved. attribute (a dotted expr): `this.m`, the receiver's
    declared type, an imported or a package's receiver, one of a star import, a name in full; else dynamic. An imported name that isn't
    known is unresolved. Other forms are unresolved. Where several classes are possible the call is a candidate.
    """
    symbols, bound = module_symbols(nodes), _bound(imports)
    c = calls.select("call", "path", "module", "source", "form", "expr")
    plain = c.where("form IN ('simple', 'construct')").withColumn("name", F.col("expr"))
    bare = F.regexp_replace("expr", r"^this\.", "")
    attr = c.where("form = 'attribute'").select("*", F.substring_index(bare, ".", 1).alias("name"), bare.alias("e"))
    dotted = attr.where("contains(e, '.')").withColumn("rest", F.expr("substr(e, length(name) + 2)"))
    simple, made = plain.where("form = 'simple'"), plain.where("form = 'construct'")

    def under(hits: DataFrame) -> DataFrame:
        """Members that the receivers' calls name below what the receivers are."""
        return hits.join(dotted.select("call", "rest"), "call").select("call", member(F.col("target"), F.col("rest")).alias("target"))

    this = enclosing_members(attr.where("expr <> e AND NOT contains(e, '.')").withColumn("name", F.col("e")), nodes)
    typed = dotted.join(types.select("source", F.col("receiver").alias("name"), "type"), ["source", "name"]).select(
        "call", "path", "module", F.col("type").alias("name"))
    by_type = _decisive(under(type_hits(typed, imports, symbols)), nodes).where("target IS NOT NULL")
    imported = lambda asks: asks.join(bound, ["path", "name"]).select("call", "target")
    of_package = lambda asks: asks.join(symbols, ["module", "name"]).select("call", F.col("qname").alias("target"))
    decided = cascade(c, [
        ("this", this, False), ("type", by_type, False), ("package", of_package(plain), False),
        ("import", _decisive(imported(simple).unionByName(under(imported(dotted))), nodes).unionByName(_known(imported(made), nodes)), True),
        ("receiver", _decisive(under(of_package(dotted)), nodes), True), ("member", enclosing_members(simple, nodes), False),
        ("star", _decisive(star_hits(plain, imports, symbols).unionByName(under(star_hits(dotted, imports, symbols))), nodes), True),
        ("full", dotted_hits(dotted, symbols, nodes), False),
    ])
    label = F.when((F.col("resolution") == "dynamic") & (F.col("form") != "attribute"), "unresolved").otherwise(F.col("resolution"))
    return c.join(decided, "call").select("call", "source", "target", label.alias("resolution"), "channel")


def injection_edges(decls: DataFrame, imports: DataFrame, nodes: DataFrame, marks: list[str], cap: int = CANDIDATES) -> DataFrame:
    """path, source, target, kind, resolution, rule_id, site_id from owners to the known classes that are injected into them.

    decls are (path, module, owner, type, mechanism, annotations), mechanism `constructor` or `field`; fields count only with an
    annotation that meets a glob of marks. Several classes are candidates of one site, at most `cap`; equal edges of a source count once.
    """
    marked: Column = F.coalesce(F.exists("annotations", lambda a: glob_match(a, marks)), F.lit(False))
    d = decls.where((F.col("mechanism") != "field") | marked).select(
        F.struct("path", "owner", "type", "mechanism").alias("call"), "path", "module", F.col("type").alias("name")).distinct()
    hits = _known(type_hits(d, imports, module_symbols(nodes)), nodes).distinct()
    per = W.partitionBy("call")
    h = hits.select("call", "target", F.count("*").over(per).alias("n"), F.row_number().over(per.orderBy("target")).alias("rank")).where(F.col("rank") <= cap)
    one = F.col("n") == 1
    e = h.select(
        "call.path", F.col("call.owner").alias("source"), "target", F.lit("call").alias("kind"), F.when(one, "resolved").otherwise("candidate").alias("resolution"),
        F.when(F.col("call.mechanism") == "constructor", CONSTRUCTOR_RULE).otherwise(FIELD_RULE).alias("rule_id"),
        F.when(~one, site_id(F.col("call.owner"), F.col("call.type"))).alias("site_id"))
    return keep_first(e, ["source", "target"], [F.col("resolution").desc(), "rule_id", "path", "site_id"])
