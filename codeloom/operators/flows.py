"""Call flows: breadth-first reachability with exact discovery order, and slices around a symbol."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import glob_match, short
from codeloom.operators.graph import is_traversable
from codeloom.operators.sizes import spread


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-codeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    target = f"{shared_dir(spark)}/flows-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing lazy still reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("flows-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Levels after which the visited nodes are written as one table.
MERGE = 16


def is_entry(names: list[str], decorators: list[str]) -> Column:
    """Whether a node of any kind is a declared entry: its short name or any of its decorators matches a glob."""
    decorated = F.coalesce(F.exists("decorators", lambda d: glob_match(d, decorators)), F.lit(False))
    return glob_match(short(F.col("qname")), names) | decorated


def traversable_calls(edges: DataFrame, rules: dict[str, bool] | None = None) -> DataFrame:
    """Resolved calls, and semantic ones by a registered rule."""
    rule = F.col("rule_id") if "rule_id" in edges.columns else None
    return edges.where((F.col("kind") == "call") & is_traversable(F.col("resolution"), rule, rules))


def entry_nodes(nodes: DataFrame, edges: DataFrame, names: list[str], decorators: list[str], rules: dict[str, bool] | None = None) -> DataFrame:
    """Functions and methods that are declared entries, or that no traversable call enters: qname, named.

    Self-loops and calls from unknown sources enter too, so a cycle that nothing else calls has no entry.
    """
    entered = traversable_calls(edges, rules).select(F.col("target").alias("qname")).distinct()
    n = nodes.where("kind IN ('function', 'method')").join(entered.withColumn("entered", F.lit(1)), "qname", "left")
    named = is_entry(names, decorators)
    return n.where(named | F.col("entered").isNull()).select("qname", named.cast("int").alias("named"))


def adjacency(edges: DataFrame, rules: dict[str, bool] | None = None) -> DataFrame:
    """Traversable calls as src, dst, ord with the first ord of parallel edges."""
    return traversable_calls(edges, rules).groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.min("ord").alias("ord"))


def start(entries: DataFrame) -> DataFrame:
    """The first level of flows: each entry(qname) at position 0."""
    zero = F.lit(0).cast("long")
    return entries.select(F.col("qname").alias("entry"), F.col("qname").alias("node"), zero.alias("position"), F.lit(0).alias("depth"), zero.alias("top"))


def grow(level: DataFrame, done: DataFrame, adj: DataFrame, max_depth: int | None = None) -> DataFrame:
    """done(entry, node, position, depth) and all that is reached from its last levels, which may be of another depth in each flow.

    `level` holds the last level of each flow that grows, with the flow's last position as `top`; `adj` is src, dst, ord.
    """
    levels = 0
    while not level.isEmpty():
        levels += 1
        if max_depth is not None:
            level = level.where(F.col("depth") < max_depth)
        found = level.join(adj, F.col("node") == F.col("src")).groupBy("entry", F.col("dst").alias("node")).agg(
            F.min(F.struct("position", "ord", "dst")).alias("at"), F.max("top").alias("top"), (F.max("depth") + 1).alias("depth")
        ).join(done.select("entry", "node"), ["entry", "node"], "left_anti")
        # one entry's new nodes of one level are ranked together
        w = W.partitionBy("entry")
        level = saved(found.select(
            "entry", "node", (F.col("top") + F.row_number().over(w.orderBy("at"))).alias("position"), "depth", (F.col("top") + F.count("*").over(w)).alias("top"),
        ))
        done = done.unionByName(level.drop("top"))
        if levels % MERGE == 0:
            done = saved(done)
    return done


#: Rows of a flow that travel together to the entries that call its first node, and rows that a task makes of them.
BLOCK, MADE = 64, 500_000


def lifted(begun: DataFrame, callers: DataFrame, inner: DataFrame, rows: int, max_depth: int | None = None) -> DataFrame:
    """entry, node, position, depth of entries that nothing calls, from their first rows, callers(src, dst, ord) and the flows of what they call.

    A queue takes nodes by depth, and those of one depth by the least path of ords to them; so a node comes by the first call that reaches
    it soonest, in its place in that call's flow. Flows travel in blocks and are unpacked where their entry lies. `rows` is about how many they hold.
    Other columns of `inner` go along with their node.
    """
    more = [c for c in inner.columns if c not in ("entry", "node", "position", "depth")]
    known = inner if max_depth is None else inner.where(F.col("depth") < max_depth)
    # positions of a flow follow each other and depths rise by steps of one, so a block needs its first ones and small numbers
    packs = known.groupBy(F.col("entry").alias("dst"), F.floor(F.col("position") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("position", "node", "depth", *more))).alias("items"))
    part = lambda c: F.transform("items", lambda x: x[c])
    low = F.col("items")[0].depth
    packs = packs.select("dst", F.col("items")[0].position.alias("first"), low.alias("low"), F.transform("items", lambda x: (x.depth - low).cast("tinyint")).alias("depth"),
                         part("node").alias("node"), *[part(c).alias(c) for c in more])
    one = lambda c, kind: F.array(F.lit(c) if c is None or isinstance(c, int) else c).cast(kind)
    kinds = {c: packs.schema[c].dataType for c in packs.columns}
    alone = {"first": F.lit(0).cast("long"), "low": F.lit(0), "depth": one(0, kinds["depth"]), "node": one(F.col("dst"), kinds["node"]), **{c: one(None, kinds[c]) for c in more}}
    packed = ["first", "low", "depth", "node", *more]
    met = callers.join(packs.withColumn("met", F.lit(True)), "dst", "left").select(
        F.col("src").alias("entry"), "dst", "ord", *[F.when(F.col("met"), F.col(c)).otherwise(alone[c]).alias(c) for c in packed])
    # the entry itself goes before all
    own = {"first": F.lit(0).cast("long"), "low": F.lit(-1), "depth": one(0, kinds["depth"]), **{c: one(F.col(c), kinds[c]) for c in ("node", *more)}}
    met = met.unionByName(begun.select("entry", F.lit(None).cast("string").alias("dst"), F.lit(None).cast(callers.schema["ord"].dataType).alias("ord"), *[own[c].alias(c) for c in packed]))
    each = spread(met, ["entry"], rows, MADE).select("entry", "dst", "ord", "first", "low", F.posexplode(F.arrays_zip("depth", "node", *more)).alias("i", "x"))
    at = F.min(F.struct((F.col("low") + F.col("x.depth")).alias("depth"), "ord", "dst", (F.col("first") + F.col("i")).alias("position"))).alias("at")
    found = each.groupBy("entry", F.col("x.node").alias("node")).agg(at, *[F.first(f"x.{c}").alias(c) for c in more])
    place = F.row_number().over(W.partitionBy("entry").orderBy("at")).cast("long") - 1
    return found.select("entry", "node", place.alias("position"), (F.col("at.depth") + 1).alias("depth"), *more)


def flows_over(entries: DataFrame, adj: DataFrame, max_depth: int | None = None, about: DataFrame | None = None) -> DataFrame:
    """The flows of `build_flows` over a saved adjacency, with the columns that `about` (node, ...) has of each node."""
    return sized_flows(entries, adj, max_depth, about)[0]


def sized_flows(entries: DataFrame, adj: DataFrame, max_depth: int | None = None, about: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The flows of `flows_over` and about how many rows they have."""
    called = adj.select(F.col("dst").alias("qname"), F.lit(True).alias("called")).distinct()
    first = saved(entries.select("qname").distinct().join(called, "qname", "left"))
    uncalled = first.where("called IS NULL").select("qname")
    callers = saved(adj.join(uncalled.select(F.col("qname").alias("src")), "src", "left_semi"))
    below = callers.select(F.col("dst").alias("qname")).where("qname IS NOT NULL")
    seeds = saved(first.where("called").select("qname").union(below).distinct())
    noted = lambda d: d if about is None else d.join(about, "node", "left")
    n, found = seeds.count(), first.count()
    # no level meets the calls of nodes that nothing calls, unless they are entries that are searched from
    entered = adj.select(F.col("dst").alias("src"))
    if 4 * n > 3 * found:
        level = saved(start(first.select("qname")))
        within = saved(adj.join(entered.union(first.select("qname")).distinct(), "src", "left_semi"))
        grown = grow(level, level.drop("top"), within, max_depth)
        return noted(grown), grown.count()
    level = saved(start(seeds))
    within = saved(adj.join(entered.distinct(), "src", "left_semi"))
    inner = saved(noted(grow(level, level.drop("top"), within, max_depth)))
    known = inner.count()
    rows = callers.count() * known // max(n, 1)
    begun = noted(start(uncalled).drop("top")).select(inner.columns)
    up = begun if max_depth == 0 else lifted(begun, callers, inner, rows, max_depth).select(inner.columns)
    own = first.where("called").select(F.col("qname").alias("entry"))
    # without entries that are called, all rows of an entry lie in one partition
    if own.isEmpty():
        return up, rows + found
    return up.unionByName(inner.join(own, "entry", "left_semi").select(inner.columns)), rows + found + known


def build_flows(
    entries: DataFrame, edges: DataFrame, max_depth: int | None = None, rules: dict[str, bool] | None = None, about: DataFrame | None = None
) -> DataFrame:
    """entry, node, position, depth: what each entry reaches, in the order of a first-in-first-out search.

    The search goes level by level for all entries at once. A node found twice on a level keeps the smaller (position of
    its parent, ord of the edge); new nodes of a level are numbered in that order after all earlier ones, which is
    the order in which a queue would take them. Cycles end as visited nodes are not found again. Rows carry the last
    position of their flow, so no level counts the earlier ones; every MERGE levels the visited are written as one table.
    Where many entries that nothing calls share few callees, the callees are searched from, and each of these entries gets its flow from theirs.
    """
    return flows_over(entries, saved(adjacency(edges, rules)), max_depth, about)


def flow_stats(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes and distinct files of each flow; flows that have their nodes' file already are not joined."""
    f = flows.where("file IS NOT NULL") if "file" in flows.columns else flows.join(nodes.select(F.col("qname").alias("node"), "file"), "node")
    return f.groupBy("entry").agg(F.count("*").alias("node_count"), F.countDistinct("file").alias("file_count"))


def _placed(flows: DataFrame, symbols: DataFrame | None, keep: Column) -> DataFrame:
    """entry, node, position, kept, asked; flows that have `asked` (1 or else) of their nodes already are not joined."""
    flows = flows.withColumn("kept", F.coalesce(keep, F.lit(False)).cast("int"))
    if "asked" not in flows.columns:
        flows = flows.join(symbols.select(F.col("qname").alias("node"), F.lit(1).alias("asked")).distinct(), "node", "left")
    return flows.select("entry", "node", "position", "kept", "asked")


def nearby(flows: DataFrame, symbols: DataFrame | None, keep: Column, cap: int = 20) -> DataFrame:
    """symbol, entry, up, down of the symbols that `keep` keeps: the names of the last `cap` kept nodes before and the first `cap` after, in their order."""
    order = W.partitionBy("entry").orderBy("position")
    side = lambda lo, hi: F.collect_list("node").over(order.rowsBetween(lo, hi))
    own = _placed(flows, symbols, keep).where("kept = 1").withColumns({"up": side(-cap, -1), "down": side(1, cap)}).where("asked = 1")
    return own.select(F.col("node").alias("symbol"), "entry", "up", "down")


def slices(flows: DataFrame, symbols: DataFrame | None, keep: Column, cap: int = 20) -> DataFrame:
    """symbol, entry, direction, node, position: the last `cap` nodes before and the first `cap` after a symbol in each flow.

    The symbol is placed in the whole flow; `keep` (over the flow's columns) filters before the cap. A kept symbol takes its neighbours
    from a window of `cap` rows to each side, so pairs are made as they are read and none is shuffled; one that isn't kept asks for blocks of numbers.
    Flows that have `asked` (1 or else) of their nodes already need no symbols.
    """
    flow, order = W.partitionBy("entry"), W.partitionBy("entry").orderBy("position")
    placed = _placed(flows, symbols, keep)
    placed = placed.withColumn("nth", F.coalesce(F.sum("kept").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    item = F.struct("node", "position")
    near = lambda side, lo, hi: F.transform(F.collect_list(item).over(order.rowsBetween(lo, hi)), lambda x: F.struct(F.lit(side).alias("direction"), x.node.alias("node"), x.position.alias("position")))
    own = placed.where("kept = 1").withColumn("near", F.concat(near("up", -cap, -1), near("down", 1, cap))).where("asked = 1")
    own = own.select(F.col("node").alias("symbol"), "entry", F.explode("near").alias("x")).select("symbol", "entry", "x.direction", "x.node", "x.position")
    # a symbol that isn't kept meets the kept nodes by blocks of numbers
    block = lambda c: F.floor(c / (2 * cap)).alias("block")
    first, last = F.greatest(F.col("nth") - cap, F.lit(0)), F.least(F.col("nth") + cap, F.col("total")) - 1
    pivot = placed.withColumn("total", F.sum("kept").over(flow)).where("kept = 0 AND asked = 1 AND total > 0").select(
        "entry", F.col("node").alias("symbol"), F.col("nth").alias("at"), F.explode(F.sequence(block(first), block(last))).alias("block"))
    met = pivot.join(placed.where("kept = 1").select("entry", block(F.col("nth")), "nth", "node", "position"), ["entry", "block"])
    side = F.when(F.col("nth") < F.col("at"), "up").otherwise("down").alias("direction")
    return own.unionByName(met.where(F.col("nth").between(F.col("at") - cap, F.col("at") + cap - 1)).select("symbol", "entry", side, "node", "position"))
