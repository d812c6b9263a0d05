"""Neighbours, degrees, details and predicates over edges(source, target, kind, resolution, ord[, rule_id])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.sizes import spread

CAP = 20
#: Ends of edges in a partition at most where they are counted by symbol.
EACH = 500_000
#: Rules whose semantic edges may be followed besides resolved edges.
TRAVERSABLE_RULES: dict[str, bool] = {}
EDGE_KINDS = ("call", "contains", "import", "extends", "implements", "all")
DIRECTIONS = ("in", "out", "both")


def is_traversable(resolution: Column, rule_id: Column | None = None, rules: dict[str, bool] | None = None) -> Column:
    """Resolved edges always; semantic ones if their rule is registered; the kind doesn't matter."""
    allowed = [k for k, v in (TRAVERSABLE_RULES if rules is None else rules).items() if v]
    semantic = (resolution == "semantic") & rule_id.isin(allowed) if rule_id is not None and allowed else F.lit(False)
    return F.coalesce((resolution == "resolved") | semantic, F.lit(False))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def directed(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: symbol, direction, other."""
    out = edges.select("*", F.col("source").alias("symbol"), F.lit("out").alias("direction"), F.col("target").alias("other"))
    into = edges.select("*", F.col("target").alias("symbol"), F.lit("in").alias("direction"), F.col("source").alias("other"))
    return out.unionByName(into)


def neighbors(
    edges: DataFrame, nodes: DataFrame, symbols: DataFrame | None = None, kind: str = "call", direction: str = "both", cap: int = CAP
) -> DataFrame:
    """symbol, direction, other, rank: distinct resolved neighbours that exist, at most `cap` a direction.

    Neighbours are ordered by their first edge (ord, then name) and capped after being made distinct. The cap
    is the feature; rank keeps the order. Without `symbols` all symbols are asked for.
    """
    if kind not in EDGE_KINDS or direction not in DIRECTIONS:
        raise ValueError(f"unknown edge kind or direction: {kind}, {direction}")
    e = edges.where("resolution = 'resolved'")
    if kind != "all":
        e = e.where(F.col("kind") == kind)
    d = directed(e).select("symbol", "direction", "other", "ord")
    if direction != "both":
        d = d.where(F.col("direction") == direction)
    if symbols is not None:
        d = d.join(symbols.select(F.col("qname").alias("symbol")).distinct(), "symbol", "left_semi")
    d = d.groupBy("symbol", "direction", "other").agg(F.min("ord").alias("ord"))
    d = d.join(nodes.select(F.col("qname").alias("other")), "other", "left_semi")
    rank = F.row_number().over(W.partitionBy("symbol", "direction").orderBy("ord", "other"))
    return d.withColumn("rank", rank).where(F.col("rank") <= cap).select("symbol", "direction", "other", F.col("rank").cast("long"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """qname, in_degree, out_degree: distinct callers and callees over resolved calls, 0 where there are none."""
    pairs = edges.where("kind = 'call' AND resolution = 'resolved'").select("source", "target").distinct()
    into = pairs.groupBy(F.col("target").alias("qname")).agg(F.count("*").alias("in_degree"))
    out = pairs.groupBy(F.col("source").alias("qname")).agg(F.count("*").alias("out_degree"))
    return nodes.select("qname").join(into, "qname", "left").join(out, "qname", "left").na.fill(0)


def symbol_detail(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per symbol with a call: its node, and its callers and callees joined in order."""
    pairs = directed(edges.where("kind = 'call' AND resolution = 'resolved'")).select("symbol", "direction", "other").distinct()
    sides = pairs.groupBy("symbol").agg(
        *[F.count_if(F.col("direction") == d).alias(n) for d, n in (("in", "in_degree"), ("out", "out_degree"))],
        *[F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.col("other"))))).alias(n) for d, n in (("in", "callers"), ("out", "callees"))],
    )
    return nodes.join(sides, F.col("qname") == F.col("symbol")).select(
        "qname", "kind", "file", "start_line", "signature", "in_degree", "out_degree", "callers", "callees"
    )


#: Why an edge is uncertain, and the order in which uncertain edges are shown (fixed values).
REASONS = {
    "dynamic": "receiver type not statically known", "candidate": "one of several possible targets",
    "unresolved": "target not found in repo", "external": "external dependency",
}


def _ends(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge once for each of its symbols; a self-loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("symbol"), *columns)


def coverage(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """Call edges around each symbol by resolution, in five fixed counts; truncated if `cap` or more edges of any kind are uncertain."""
    from codeloom.operators.flows import saved  # flows imports this module

    ends = saved(_ends(edges, "kind", "resolution"))
    d = spread(ends, ["symbol"], ends.count(), EACH)
    names = ("resolved", "semantic", "candidate", "dynamic", "unresolved")
    return d.groupBy("symbol").agg(
        *[F.count_if((F.col("kind") == "call") & (F.col("resolution") == n)).alias(f"{n}_edges") for n in names],
        (F.count_if(F.col("resolution") != "resolved") >= cap).cast("int").alias("truncated"),
    )


def resolution_rate(edges: DataFrame) -> DataFrame:
    """Calls by resolution and the share that is resolved (0 without calls)."""
    c = edges.where("kind = 'call'")
    return c.agg(
        F.count("*").alias("calls"), F.count_if(F.col("resolution") == "resolved").alias("resolved"),
        F.count_if(F.col("resolution") == "dynamic").alias("dynamic"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"),
        F.count_if(F.col("resolution") == "candidate").alias("candidate"),
    ).withColumn("rate", F.coalesce(F.try_divide(F.col("resolved"), F.col("calls")), F.lit(0.0)))


def uncertainty(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """The uncertain edges of any kind around each symbol, dynamic ones first: symbol, rank, source, expression, resolution, rule_id, reason, truncated.

    Of one label the order is by source, then edge. truncated is set where the list reached `cap`.
    """
    e = _ends(edges.where("resolution <> 'resolved'"), "source", "target", "resolution", "rule_id", "ord")
    weight, reason = F.lit(len(REASONS)), F.lit("uncertain edge")
    for k, (label, text) in enumerate(REASONS.items()):
        weight, reason = F.when(F.col("resolution") == label, k).otherwise(weight), F.when(F.col("resolution") == label, text).otherwise(reason)
    w = W.partitionBy("symbol")
    e = e.withColumn("rank", F.row_number().over(w.orderBy(weight, "source", "ord", "target")).cast("long")).where(F.col("rank") <= cap)
    return e.select(
        "symbol", "rank", "source", F.col("target").alias("expression"), "resolution", "rule_id", reason.alias("reason"),
        (F.max("rank").over(w) >= cap).cast("int").alias("truncated"),
    )


def top_degree(edges: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """The nodes with most edges of any kind; a self-loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("qname"))
    return ends.groupBy("qname").agg(F.count("*").alias("degree")).join(nodes.select("qname", "kind"), "qname").orderBy(
        F.desc("degree"), "qname"
    ).limit(limit)


def edges_within(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges with both ends among the chosen nodes, counted by pair."""
    c = chosen.select("qname")
    e = edges.join(c.withColumnRenamed("qname", "source"), "source", "left_semi").join(c.withColumnRenamed("qname", "target"), "target", "left_semi")
    return e.groupBy("source", "target", "kind").agg(F.count("*").alias("n"))
