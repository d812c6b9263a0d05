"""Python calls as joins: lexical names, imports with re-exports, star imports, ancestors of super(), and declared types.

Every channel gives rows (call, order, target, hit) for all calls at once; the least order decides a call. Re-exports and
ancestors are closures that many questions share, and a branch ends where it finds something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import member, module, short
from codeloom.operators.flows import saved
from codeloom.operators.resolve import CANDIDATES, ancestor_members, candidate_fanout, prefixes, site_id

#: Channels in the order in which they decide.
CHANNELS = ("local", "import", "star", "super", "module", "class", "type", "self", "star_member", "imported_member")


def _last(imports: DataFrame, by: str) -> DataFrame:
    """Of the imports of a name in a file or module the last counts; stars bind no name."""
    b = imports.where("NOT is_star").groupBy(by, "local").agg(F.max_by(F.struct("target_module", "target_name"), F.struct("ord", "path")).alias("b"))
    return b.select(by, "local", "b.target_module", "b.target_name")


def reexports(asks: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """module, name, target: what asks(module, name) lead to: the name itself, or what its module binds it to, or else what its star imports show.

    known(qname) ends a branch; several targets are alternatives. Cycles end, as a name is looked for in a module once for each ask.
    """
    bound = _last(imports, "module").where("target_name IS NOT NULL").select(F.col("module").alias("m"), F.col("local").alias("n"), "target_module", "target_name")
    stars = imports.where("is_star").select(F.col("module").alias("m"), F.col("target_module").alias("sm")).distinct()
    is_known = known.select(F.col("qname").alias("target"), F.lit(True).alias("hit")).distinct()
    level = saved(asks.select("module", "name").distinct().select("*", F.col("module").alias("m"), F.col("name").alias("n")))
    done, found = level, None
    while not level.isEmpty():
        looked = saved(level.withColumn("target", member(F.col("m"), F.col("n"))).join(is_known, "target", "left"))
        hit = looked.where("hit").select("module", "name", "target")
        found = hit if found is None else found.unionByName(hit)
        rest = looked.where("hit IS NULL").join(bound, ["m", "n"], "left")
        by_name = rest.where("target_name IS NOT NULL").select("module", "name", F.col("target_module").alias("m"), F.col("target_name").alias("n"))
        by_star = rest.where("target_name IS NULL").join(stars, "m").select("module", "name", F.col("sm").alias("m"), "n")
        level = saved(by_name.unionByName(by_star).distinct().join(done, ["module", "name", "m", "n"], "left_anti"))
        done = done.unionByName(level)
    return (asks.select("module", "name", F.col("name").alias("target")).where("false") if found is None else found).distinct()


def star_names(asks: DataFrame, imports: DataFrame, symbols: DataFrame, listed: DataFrame | None) -> DataFrame:
    """path, name, target: what asks(path, name) may be through star imports; listed(module, names) show their names alone."""
    stars = imports.where("is_star").select("path", F.col("target_module").alias("module")).distinct()
    # only names that something has are asked of every star import
    names = asks.select("path", "name").distinct().join(symbols.select("name").distinct(), "name", "left_semi")
    hits = names.join(stars, "path").join(symbols.select("module", "name", "qname"), ["module", "name"])
    if listed is not None:
        hits = hits.join(listed.select("module", "names"), "module", "left").where("names IS NULL OR array_contains(names, name)")
    return hits.select("path", "name", F.col("qname").alias("target")).distinct()


def enclosing_classes(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """source, cls: the innermost class around each source, scopes of functions in between passed over."""
    at = F.char_length(module(F.col("source"))) + 3
    steps = F.transform(prefixes(F.substring("source", at, F.lit(1 << 30))), lambda p: F.concat_ws("::", module(F.col("source")), p))
    e = sources.select("source").distinct().where("contains(source, '::')").select("source", F.explode(steps).alias("cls")).where("cls <> source")
    return e.join(classes.select(F.col("qname").alias("cls")), "cls", "left_semi").groupBy("source").agg(F.max_by("cls", F.char_length("cls")).alias("cls"))


def _inside(mod: Column, rest: Column) -> tuple[Column, Column]:
    """The module and the member on which a dotted walk over an imported module lands: `pkg.b.fn` of `import pkg.b` is fn of pkg.b, `pkg.fn` is fn of pkg."""
    m, r = F.split(mod, r"\."), F.split(rest, r"\.")
    most = F.least(F.size(r), F.size(m) - 1)
    i = F.array_max(F.filter(F.sequence(F.lit(0), most), lambda k: F.slice(r, F.lit(1), k) == F.slice(m, F.lit(2), k)))
    return F.array_join(F.slice(m, F.lit(1), i + 1), "."), F.array_join(F.slice(r, i + 1, F.size(r)), ".")


def resolve_python(
    calls: DataFrame, nodes: DataFrame, imports: DataFrame, types: DataFrame, extends: DataFrame, listed: DataFrame | None = None
) -> DataFrame:
    """path, source, expr, form, target, resolution, channel, site_id, n_candidates: an edge for each call and target.

    calls(path, module, source, receiver, name, form). simple: a function or class of the module, an imported name (through
    re-exports to where it is), a name of a star import, else unresolved. attribute: super() by the ancestors, an imported
    module's member (never dynamic), a class of the module, the longest receiver with a declared type (scope, receiver,
    type), self and cls, a name of a star import, the member of an imported name, else dynamic. Other forms are unresolved.
    A channel with one target decides, with several gives an edge `candidate` for each, at most CANDIDATES, with one site_id.
    Unresolved edges keep the name that was looked for. extends(source, target) are resolved bases. Equal calls give one
    edge a target; nulls in a receiver are none; calls of unknown files only miss their imports.
    """
    receiver = F.coalesce("receiver", F.lit(""))
    text = F.when(receiver == "", F.col("name")).otherwise(F.concat_ws(".", receiver, "name"))
    c = calls.select("path", "module", "source", "name", "form", text.alias("expr"), receiver.alias("receiver")).distinct()
    head = F.substring_index("expr", ".", 1)
    c = saved(c.withColumn("call", F.struct("path", "source", "expr", "form")).withColumn("head", head).withColumn("rest", F.expr("substr(expr, length(head) + 2)")))
    simple, attr = c.where("form = 'simple'"), c.where("form = 'attribute'")
    known = nodes.select("qname").distinct()
    hit = known.select(F.col("qname").alias("target"), F.lit(True).alias("hit"))
    symbols = saved(
        nodes.where("kind IN ('function', 'class')").groupBy("module", short(F.col("qname")).alias("name")).agg(F.max_by("qname", F.struct("path", "start_line", "qname")).alias("qname"))
    )
    classes = nodes.where("kind = 'class'")
    bound = saved(_last(imports, "path"))
    by_local = bound.select("path", F.col("local").alias("name"), "target_module", "target_name")
    by_head = by_local.withColumnRenamed("name", "head")

    # questions that re-exports answer: imported names, members of imported modules, imported types
    named = simple.join(by_local, ["path", "name"])
    into, mem = _inside(F.col("target_module"), F.col("rest"))
    members = attr.join(by_head.where("target_name IS NULL"), ["path", "head"]).select("call", into.alias("m"), mem.alias("n"))
    typed = types.select(F.col("scope").alias("source"), F.col("receiver").alias("prefix"), "type").distinct()
    tries = attr.select("call", "path", "module", "source", "expr", F.explode(prefixes(F.col("receiver"))).alias("prefix")).join(typed, ["source", "prefix"])
    receivers = tries.groupBy("call", "path", "module", "expr").agg(F.max_by(F.struct("prefix", "type"), F.char_length("prefix")).alias("t")).select(
        "call", "path", "module", F.col("t.type").alias("name"), F.expr("substr(expr, length(t.prefix) + 2)").alias("rest"))
    receivers = saved(receivers)
    type_imports = receivers.select("path", "name").distinct().join(by_local, ["path", "name"]).where("target_name IS NOT NULL")
    asks = named.where("target_name IS NOT NULL").select(F.col("target_module").alias("module"), F.col("target_name").alias("name")).unionByName(
        members.where("n <> ''").select(F.col("m").alias("module"), F.col("n").alias("name"))).unionByName(
        type_imports.select(F.col("target_module").alias("module"), F.col("target_name").alias("name")))
    led = saved(reexports(asks, imports, known))
    to = led.select(F.col("module").alias("m"), F.col("name").alias("n"), F.col("target").alias("led"))

    def decided(rows: DataFrame, channel: str) -> DataFrame:
        """Rows (call, target, hit) of a channel; a target that isn't hit decides too, as unresolved."""
        return rows.select("call", F.lit(CHANNELS.index(channel)).alias("o"), "target", F.coalesce("hit", F.lit(False)).alias("hit"))

    yes = F.lit(True).alias("hit")
    local = simple.join(symbols, ["module", "name"]).select("call", F.col("qname").alias("target"), yes)
    whole = named.where("target_name IS NULL").select("call", F.col("target_module").alias("target")).join(hit, "target", "left")
    single = named.where("target_name IS NOT NULL").select("call", F.col("target_module").alias("m"), F.col("target_name").alias("n")).join(to, ["m", "n"], "left")
    landed = lambda d: d.select("call", F.coalesce("led", F.when(F.col("n") == "", F.col("m")).otherwise(member(F.col("m"), F.col("n")))).alias("target"), F.col("led").isNotNull().alias("hit"))
    on_module = members.where("n = ''").select("call", F.col("m").alias("target")).join(hit, "target", "left")
    of_module = landed(members.where("n <> ''").join(to, ["m", "n"], "left"))
    star_asks = simple.select("path", "name").unionByName(attr.select("path", F.col("head").alias("name"))).unionByName(receivers.select("path", "name"))
    shown = saved(star_names(star_asks, imports, symbols, listed))
    star = simple.join(shown, ["path", "name"]).select("call", "target", yes)
    of_class = attr.join(symbols.select("module", F.col("name").alias("head"), "qname"), ["module", "head"]).select("call", F.concat_ws(".", "qname", "rest").alias("target")).join(hit, "target", "left")

    around = saved(enclosing_classes(attr.where("startswith(expr, 'super().') OR head IN ('self', 'cls')"), classes))
    supers = attr.where("startswith(expr, 'super().')").join(around, "source").select("call", "cls", F.expr("substr(expr, 9)").alias("name"))
    owned = nodes.select(F.expr("substr(qname, 1, length(qname) - length(substring_index(qname, '.', -1)) - 1)").alias("owner"), short(F.col("qname")).alias("name")).where("contains(owner, '::')").distinct()
    ups = ancestor_members(supers, extends, owned).join(supers.select("call", "name"), "call").select("call", F.concat_ws(".", "owner", "name").alias("target"), yes).distinct()

    own_types = receivers.join(symbols, ["module", "name"]).select("call", "rest", F.col("qname").alias("cls"))
    far_types = receivers.join(type_imports.join(to.select(F.col("m").alias("target_module"), F.col("n").alias("target_name"), "led"), ["target_module", "target_name"]).select("path", "name", F.col("led").alias("cls")), ["path", "name"])
    direct = own_types.unionByName(far_types.select("call", "rest", "cls"))
    by_star = receivers.join(direct.select("call").distinct(), "call", "left_anti").join(shown, ["path", "name"]).select("call", "rest", F.col("target").alias("cls"))
    of_type = saved(direct.unionByName(by_star).distinct().select("call", F.concat_ws(".", "cls", "rest").alias("target")).distinct())
    several = of_type.groupBy("call").agg((F.count("*") > 1).alias("several"))
    # one class without the member says nothing, several are alternatives whatever they define
    of_type = of_type.join(several, "call").join(hit, "target", "left").where("several OR hit").select("call", "target", yes)

    own = attr.where("head IN ('self', 'cls')").join(around, "source").select("call", F.concat_ws(".", "cls", "rest").alias("target")).join(hit, "target")
    from_star = saved(attr.join(shown.select("path", F.col("name").alias("head"), "target"), ["path", "head"]).select("call", F.concat_ws(".", "target", "rest").alias("target")).distinct())
    from_star = from_star.join(from_star.groupBy("call").agg((F.count("*") > 1).alias("several")), "call").join(hit, "target", "left").select(
        "call", "target", (F.col("several") | F.coalesce("hit", F.lit(False))).alias("hit"))
    of_name = attr.join(by_head.where("target_name IS NOT NULL"), ["path", "head"]).select(
        "call", member(member(F.col("target_module"), F.col("target_name")), F.col("rest")).alias("target")).join(hit, "target")

    found = None
    for rows, channel in (
        (local, "local"), (whole, "import"), (landed(single), "import"), (star, "star"), (ups, "super"), (on_module, "module"), (of_module, "module"),
        (of_class, "class"), (of_type, "type"), (own, "self"), (from_star, "star_member"), (of_name, "imported_member"),
    ):
        part = decided(rows, channel)
        found = part if found is None else found.unionByName(part)
    found = saved(found.distinct())
    first = found.groupBy("call").agg(F.min("o").alias("o"))
    best = found.join(first, ["call", "o"])
    best = best.join(best.groupBy("call").agg(F.count_if("hit").alias("n")), "call").where("hit OR n = 0")
    label = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("candidate")
    channel = F.get(F.array(*[F.lit(x) for x in CHANNELS]), F.col("o"))
    best = saved(best.select("call", "target", label.alias("resolution"), channel.alias("channel"), F.col("n").alias("n_candidates")))
    few = candidate_fanout(best.where("resolution = 'candidate'").select("call.source", "call.expr", "target")).select("source", "expr", "target").distinct()
    kept = best.where("resolution <> 'candidate'").unionByName(
        best.where("resolution = 'candidate'").withColumn("source", F.col("call.source")).withColumn("expr", F.col("call.expr")).join(few, ["source", "expr", "target"], "left_semi").drop("source", "expr"))
    none = F.when(F.col("form") == "attribute", "dynamic").otherwise("unresolved")
    site = F.when(F.col("resolution") == "candidate", site_id(F.col("source"), F.col("expr")))
    return c.select("call", "path", "source", "expr", "form").join(kept, "call", "left").select(
        "path", "source", "expr", "form", F.coalesce("target", "expr").alias("target"), F.coalesce("resolution", none).alias("resolution"), "channel"
    ).withColumn("site_id", site).join(
        best.select("call.path", "call.source", "call.expr", "call.form", "n_candidates").distinct(), ["path", "source", "expr", "form"], "left"
    ).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def truncated(n_candidates: Column) -> Column:
    return n_candidates > CANDIDATES
