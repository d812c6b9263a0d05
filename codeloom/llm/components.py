"""Connected components of a link table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.io import materialise, spread_join


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links`; nodes of one component share a root, which is one of them.

    In each round every node moves to the neighbour (or itself) of least random rank, and links between
    nodes that meet vanish, so the rounds grow with the logarithm of the longest path. Minima are taken before
    the shuffle, and the links of a node with very many of them are joined by `spread_join`, so it is no hot
    spot. Nulls in a link drop it; an empty link table gives an empty result.
    """
    edges = materialise(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    )
    roots = None
    step = 0
    while not edges.isEmpty():
        step += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("r"), F.col(c).alias("v"))
        moved = materialise(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count("*").alias("rows")).select(
                F.col("a").alias("node"), F.least("m", rank("a")).getField("v").alias("root"), "rows"
            )
        )
        if roots is None:
            roots = moved.select("node", "root")
        else:
            to = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = materialise(
                roots.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            )
        ends = moved.select(F.col("node").alias("a"), F.col("root").alias("ra"), "rows")
        other = moved.select(F.col("node").alias("b"), F.col("root").alias("rb"), "rows")
        edges = materialise(
            spread_join(spread_join(edges, ends, "a"), other, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()
        )
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
