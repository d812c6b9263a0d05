"""Upkeep of what hangs on nodes after they changed: search postings, community members, the manifest of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.search import FIELDS, postings, searchable


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, state of what isn't the same in both tables: `new`, `gone` or `changed`. Columns are compared by a digest; keys are unique."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    b, a = before.select(key, row.alias("was")), after.select(key, row.alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return b.join(a, key, "full").select(key, state.alias("state")).where("state IS NOT NULL")


def update_postings(old: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """id, field, pos, token after symbols came, went or changed: only theirs are made again, a changed signature's words included."""
    was, now = searchable(before), searchable(after)
    moved = changed_rows(was, now, "qname", list(FIELDS))
    fresh = now.join(moved.where("state <> 'gone'"), "qname", "left_semi")
    return old.join(moved.select(F.col("qname").alias("id")), "id", "left_anti").unionByName(postings(fresh, "qname", list(FIELDS)))


def keep_members(members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members(qname, community) whose node is still there, and community, node_count of the communities that have any."""
    kept = members.join(nodes.select("qname").distinct(), "qname", "left_semi")
    return kept, kept.groupBy("community").agg(F.count("*").alias("node_count"))


def update_manifest(old: DataFrame, seen: DataFrame, touched: DataFrame) -> DataFrame:
    """The manifest after touched(path) were looked at again: what was seen of them replaces their rows, what wasn't seen is gone."""
    return old.join(touched.select("path").distinct(), "path", "left_anti").unionByName(
        seen.join(touched.select("path").distinct(), "path", "left_semi").select(old.columns))


def classify_hints(hints: DataFrame, manifest: DataFrame, there: DataFrame) -> DataFrame:
    """path, state of files that are said to have changed: `added`, `modified`, `deleted`, or `ignored` if neither known nor there."""
    known = manifest.select("path", F.lit(True).alias("known")).distinct()
    exists = there.select("path", F.lit(True).alias("exists")).distinct()
    state = F.when(F.col("exists") & F.col("known"), "modified").when(F.col("exists"), "added").when(F.col("known"), "deleted").otherwise("ignored")
    return hints.select("path").distinct().join(known, "path", "left").join(exists, "path", "left").select("path", state.alias("state"))
