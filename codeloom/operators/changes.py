"""Changes: diff text, hunks over symbols, deletions, manifests and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the line buckets by which ranges of one file are joined.
BUCKET = 64


def parse_diff(lines: DataFrame) -> DataFrame:
    """file, start, count of new-side hunks from diff lines (diff_id, line_no, line).

    The current file is carried forward over the lines of its diff; a missing count is 1, start and count are at least 1;
    /dev/null marks a deleted file and gives no hunk.
    """
    w = W.partitionBy("diff_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+)$", 1)
    d = lines.withColumn("file", F.last(F.when(header != "", header), ignorenulls=True).over(w))
    at, n = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1), F.regexp_extract("line", r"^@@ -\S+ \+\d+,(\d+)", 1)
    d = d.where(at != "").where("file <> '/dev/null'")
    return d.select("file", F.greatest(at.cast("long"), F.lit(1)).alias("start"), F.greatest(F.when(n == "", F.lit("1")).otherwise(n).cast("long"), F.lit(1)).alias("count"))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """file, added, removed from numstat lines; binary files count 0 and keep their row."""
    p = F.split("line", "\t", 3)
    number = lambda c: F.when(c == "-", F.lit(0)).otherwise(c.try_cast("long"))
    return lines.where(F.size(p) == 3).select(p[2].alias("file"), number(p[0]).alias("added"), number(p[1]).alias("removed"))


def hunk_overlaps(hunks: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """file, start, count, qname where a hunk meets a symbol's lines.

    Ranges are dealt into buckets of 64 lines, so the join is on file and bucket and a long file is no hot key. Equal hunks are
    joined once, and a pair that meets in several buckets is taken in the first of them.
    """
    low = lambda c: F.floor(c / BUCKET)
    bucket = lambda a, b: F.explode(F.sequence(low(a), low(b))).alias("bucket")
    h = hunks.select("file", "start", "count").distinct()
    h = h.select("file", "start", "count", bucket(F.col("start"), F.col("start") + F.col("count") - 1))
    n = nodes.where(F.col("kind").isin(list(kinds))).select("file", "qname", "start_line", "end_line", bucket(F.col("start_line"), F.col("end_line")))
    both = h.join(n, ["file", "bucket"]).where("start <= end_line AND start + count - 1 >= start_line")
    both = both.where(F.col("bucket") == F.greatest(low(F.col("start")), low(F.col("start_line"))))
    return both.select("file", "start", "count", "qname").distinct()


#: Kinds whose lines cover a hunk.
COVERING = ("function", "method", "class")


def uncovered_hunks(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hunks that meet no function, method or class."""
    return hunks.join(hunk_overlaps(hunks, nodes, COVERING), ["file", "start", "count"], "left_anti").select("file", "start", "count")


def changed_symbols(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy("qname", "file").agg(F.count("*").alias("n_hunks"))


def uncovered_changes(hunks: DataFrame, numstat: DataFrame, deleted: DataFrame, nodes: DataFrame, told: DataFrame) -> DataFrame:
    """file, start, count, deleted: every change that no symbol accounts for.

    Those are uncovered hunks of surviving files, files that changed without hunks (binary, renamed) and deleted files, both
    with null lines. Files of `told` (file), whose deletions are reported otherwise, are left out of the last two.
    """
    told, gone = told.select("file").distinct(), deleted.select("file").distinct()
    live = hunks.join(gone, "file", "left_anti")
    lines = uncovered_hunks(live, nodes).select("file", "start", "count", F.lit(0).alias("deleted"))
    none = F.lit(None).cast("long")
    files = numstat.select("file").union(hunks.select("file")).distinct().join(told, "file", "left_anti")
    bare = files.join(gone, "file", "left_anti").join(hunks.select("file").distinct(), "file", "left_anti").select("file", none.alias("start"), none.alias("count"), F.lit(0).alias("deleted"))
    whole = files.join(gone, "file", "left_semi").select("file", none.alias("start"), none.alias("count"), F.lit(1).alias("deleted"))
    return lines.unionByName(bare).unionByName(whole)


def changed_functions(hunks: DataFrame, deleted: DataFrame, nodes: DataFrame, risks: DataFrame) -> DataFrame:
    """qname, kind, file, start_line, end_line, risk of the functions, methods and classes that a hunk of a surviving file meets."""
    live = hunks.join(deleted.select("file"), "file", "left_anti")
    met = hunk_overlaps(live, nodes, COVERING).select("qname").distinct()
    shown = nodes.join(met, "qname", "left_semi").select("qname", "kind", "file", "start_line", "end_line")
    return shown.join(risks.select("qname", "risk"), "qname", "left").na.fill(50, ["risk"])


def change_summary(numstat: DataFrame, functions: DataFrame, uncovered: DataFrame, stones: DataFrame) -> DataFrame:
    """One row of totals: files, lines, changed functions, files with uncovered changes, deleted functions."""
    return numstat.agg(
        F.count("*").alias("files_changed"), F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("lines_removed")
    ).crossJoin(functions.agg(F.count("*").alias("changed_functions"))).crossJoin(uncovered.agg(F.countDistinct("file").alias("uncovered_changes"))).crossJoin(
        stones.agg(F.count("*").alias("delete_change"))
    )


def deletion_candidates(stones: DataFrame, numstat: DataFrame, deleted: DataFrame) -> DataFrame:
    """Tombstones of deleted files and of files that lost lines."""
    files = deleted.select("file").union(numstat.where("removed > 0").select("file")).distinct()
    return stones.join(files, "file", "left_semi")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, changed, deleted) by a full outer join of path, stamp, size, hash; files of equal stamp and size are unchanged without a look at the hash."""
    side = lambda d, n: d.select("path", *[F.col(c).alias(f"{c}{n}") for c in ("stamp", "size", "hash")], F.lit(1).alias(f"has{n}"))
    j = side(old, 0).join(side(new, 1), "path", "full_outer")
    same = (F.abs(F.col("stamp0") - F.col("stamp1")) < 1e-6) & (F.col("size0") == F.col("size1"))
    status = F.when(F.col("has0").isNull(), "added").when(F.col("has1").isNull(), "deleted").when(~same & ~F.col("hash0").eqNullSafe(F.col("hash1")), "changed")
    return j.select("path", status.alias("status")).where("status IS NOT NULL")


def tombstones(old_nodes: DataFrame, new_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qname, file, n_upstream, upstream: nodes that vanished, with their callers, importers and heirs that did not vanish too."""
    gone = old_nodes.join(new_nodes.select("qname"), "qname", "left_anti").select("qname", "file")
    up = edges.where("kind IN ('call', 'import', 'extends', 'implements')").select(F.col("target").alias("qname"), F.col("source"))
    up = up.join(gone.select("qname"), "qname", "left_semi").join(gone.select(F.col("qname").alias("source")), "source", "left_anti").distinct()
    listed = up.groupBy("qname").agg(F.count("*").alias("n_upstream"), F.concat_ws(",", F.sort_array(F.collect_list("source"))).alias("upstream"))
    return gone.join(listed, "qname", "left").na.fill(0, ["n_upstream"]).na.fill("", ["upstream"])


def deleted_symbols(stones: DataFrame, live: DataFrame) -> DataFrame:
    """The latest tombstone (by id) of each file and name that has not come back, at risk 90."""
    last = stones.groupBy("file", "qname").agg(F.max_by(F.struct("id", "start_line"), "id").alias("t"))
    return last.join(live.select("qname"), "qname", "left_anti").select(
        "file", "qname", F.col("t.id").alias("id"), F.coalesce("t.start_line", F.lit(0)).alias("start_line"), F.lit(90).alias("risk")
    )


def repair_resolutions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels resolved and unresolved set by whether the target exists; other labels and call targets outside of modules stay."""
    known = nodes.select(F.col("qname").alias("target"), F.lit(1).alias("known")).distinct()
    e = edges.join(known, "target", "left")
    flips = F.col("resolution").isin("resolved", "unresolved") & ((F.col("kind") != "call") | F.col("target").contains("::"))
    label = F.when(flips, F.when(F.col("known") == 1, "resolved").otherwise("unresolved")).otherwise(F.col("resolution"))
    return e.withColumn("resolution", label).drop("known")


def apply_delta(nodes: DataFrame, touched_files: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes after the touched files were read again: survivors keep their ids, new ones go on from the largest.

    New ids are numbered by name within blocks of a hash of the name whose sizes are summed first, so no single task orders
    all new nodes.
    """
    kept = nodes.join(touched_files.select("file"), "file", "left_anti")
    known = fresh.join(nodes.select("qname", "id"), "qname", "left")
    survivors, new = known.where("id IS NOT NULL"), known.where("id IS NULL").drop("id")
    block = F.pmod(F.xxhash64("qname"), F.lit(256))
    new = new.withColumn("_b", block)
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = new.join(F.broadcast(starts), "_b").crossJoin(F.broadcast(top)).withColumn(
        "id", F.col("_top") + F.col("_s") + F.row_number().over(W.partitionBy("_b").orderBy("qname"))
    )
    return kept.unionByName(survivors.select(nodes.columns)).unionByName(new.select(nodes.columns))
