"""Context of a case under a budget of characters, counted as its JSON text, by running sums over what goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a long source loses at a time, and the length that it keeps at least.
PIECE = 500
#: Parts of a context in the order in which they go; those from SOURCE on stay.
NEAR, NODE, PIECES, SOURCE, HULL, CASE = range(6)


def string_chars(text: Column) -> Column:
    """Characters of a JSON string: quotes, a backslash before quotes, backslashes and \\b \\f \\n \\r \\t, six for other control characters."""
    # {"t":} around the string are six; most strings have nothing to escape
    escaped = F.length(F.to_json(F.struct(text.alias("t")))) - 6
    return F.when(F.rlike(text, F.lit(r'["\\\x00-\x1F]')), escaped).otherwise(F.length(text) + 2)


def number_chars(number: Column) -> Column:
    return F.length(number.cast("string"))


def object_chars(**members: Column) -> Column:
    """Characters of a JSON object with a space after each colon and comma, from those of its members' values."""
    total = F.lit(2 + 2 * max(len(members) - 1, 0) + sum(len(k) + 4 for k in members))
    for chars in members.values():
        total = total + chars
    return total


def _snippet_chars(source: Column, truncated: Column) -> Column:
    """Characters of a snippet with the given ones for its source."""
    return object_chars(
        qname=string_chars(F.col("qname")), file=string_chars(F.col("file")), start_line=number_chars(F.col("start_line")),
        end_line=number_chars(F.col("end_line")), source=source, truncated=F.when(truncated, 4).otherwise(5))


def fit_context(cases: DataFrame, changed: DataFrame, neighbors: DataFrame, impacts: DataFrame, nodes: DataFrame, limit: int) -> dict[str, DataFrame]:
    """What of each case's context fits `limit` characters of JSON: cases, changed, neighbors, nodes.

    Given cases(case, symbols), changed and neighbors(case, ord, qname, file, start_line, end_line, source, truncated), impacts(case, ord, symbol,
    found, entries) and nodes(case, ord of the impact, direction, rank, qname, file, line). What goes, until the rest fits: neighbours, the last first; then
    for each impact in order its nodes downstream, then upstream, the last first; then 500 characters at a time from the end of the
    longest changed source (of equal ones the first) that has over 500. An item goes exactly if all that go before it leave too much, so a running sum over the order decides
    at once. Results have the given columns; cut sources are marked truncated; cases come with serialized_chars, and
    may stay over the limit when nothing more can go. Null lists count as empty. Texts become numbers of characters where they are; these meet in one exchange by case.
    """
    strings = lambda c: F.coalesce(
        F.aggregate(c, F.lit(0), lambda a, x: a + string_chars(x)) + 2 * F.greatest(F.size(c) - 1, F.lit(0)), F.lit(0)) + 2

    def row(items: DataFrame, part: int, chars: Column, a: Column, b: Column | None = None, c: Column | None = None, lost: Column | None = None) -> DataFrame:
        """What counts of an item: its part, its place among what goes (a, b, c), its characters, and those that its pieces lose."""
        zero = F.lit(0)
        place = [(zero if x is None else x).cast("long").alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
        return items.select("case", F.lit(part).alias("part"), *place, chars.alias("chars"), (F.lit(None) if lost is None else lost).cast("array<int>").alias("lost"))

    # a source is read once: its characters are those of its pieces and of what stays before them
    piece = lambda nth: string_chars(F.substr(F.col("source"), F.col("_size") - PIECE * (nth + 1) + 1, F.lit(PIECE))) - 2
    cut = changed.withColumn("_size", F.length("source")).withColumn(
        "_lost", F.when(F.col("_size") > PIECE, F.transform(F.sequence(F.lit(0), F.ceil((F.col("_size") - PIECE) / PIECE).cast("int") - 1), piece)))
    lost = F.coalesce("_lost", F.array().cast("array<int>"))
    stays = string_chars(F.substr(F.col("source"), F.lit(1), F.col("_size") - PIECE * F.size(lost)))
    flag = F.when(F.col("truncated"), 0).otherwise(1)
    side = F.when(F.col("direction") == "downstream", 0).otherwise(1)
    rows = row(neighbors, NEAR, _snippet_chars(string_chars(F.col("source")), F.col("truncated")), -F.col("ord"))
    rows = rows.unionByName(row(nodes, NODE, object_chars(qname=string_chars(F.col("qname")), file=string_chars(F.col("file")), line=number_chars(F.col("line"))),
                                F.col("ord"), side, -F.col("rank")))
    rows = rows.unionByName(row(cut, SOURCE, _snippet_chars(stays, F.col("truncated")) + F.aggregate(lost, F.lit(0), lambda x, y: x + y), F.col("ord"), F.col("_size"), flag, F.col("_lost")))
    rows = rows.unionByName(row(impacts, HULL, object_chars(
        symbol=string_chars(F.col("symbol")), found=F.when(F.col("found"), 4).otherwise(5), affected_entries=strings(F.col("entries")), upstream=F.lit(2), downstream=F.lit(2)), F.lit(0)))
    rows = rows.unionByName(row(cases, CASE, strings(F.col("symbols")), F.lit(0))).repartition("case")
    # a source stays as a row for its own characters besides those of its pieces
    rows = rows.select("case", "part", "a", "b", "c", "chars", F.posexplode(F.concat(F.array(F.lit(0)), F.coalesce("lost", F.array().cast("array<int>")))).alias("nth", "loses"))
    at = lambda piece, other: F.when(F.col("nth") > 0, piece).otherwise(other)
    # with the first piece "false" becomes "true"
    rows = rows.select(
        "case", at(F.lit(PIECES), F.col("part")).alias("part"), at(PIECE * (F.col("nth") - 1) - F.col("b"), F.col("a")).alias("a"), at(F.col("a"), F.col("b")).alias("b"),
        at(F.lit(0).cast("long"), F.col("c")).alias("c"), at(F.col("loses") + F.when(F.col("nth") == 1, F.col("c")).otherwise(0), F.col("chars")).alias("chars"))

    turn, per = W.partitionBy("case").orderBy("part", "a", "b", "c"), W.partitionBy("case")
    # the last item of a list to go has no comma
    after = F.lead("part").over(turn) == F.col("part")
    after = F.coalesce(after & ((F.col("part") == NEAR) | ((F.lead("a").over(turn) == F.col("a")) & (F.lead("b").over(turn) == F.col("b")))), F.lit(False))
    rows = rows.withColumn("comma", F.when(F.col("part").isin(NEAR, NODE) & after, 2).otherwise(0))
    frees = F.when(F.col("part").isin(NEAR, NODE, PIECES), F.col("chars") + F.col("comma"))
    earlier = F.coalesce(F.sum(frees).over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("earlier", earlier).withColumn("frees", frees)
    of = lambda part, x: F.when(F.col("part") == part, x)
    listed = lambda part: F.coalesce(F.sum(of(part, F.col("chars"))).over(per) + 2 * (F.count(of(part, F.lit(1))).over(per) - 1), F.lit(0))
    below = F.coalesce(F.sum(of(NODE, F.col("chars") + F.col("comma"))).over(per), F.lit(0))
    evidence = object_chars(changed_symbols=F.max(of(CASE, F.col("chars"))).over(per), impacts=listed(HULL) + 2 + below)
    total = object_chars(
        changed_symbol_source=listed(SOURCE) + 2, direct_neighbor_source=listed(NEAR) + 2, graph_evidence=evidence,
        max_chars=F.lit(len(str(limit))), serialized_chars=F.lit(1)).cast("long")
    rows = rows.withColumn("total", total).withColumn("gone", F.col("frees").isNotNull() & (F.col("total") - F.col("earlier") > limit))
    gone = rows.where("gone")
    pieces = gone.where(F.col("part") == PIECES).groupBy("case", F.col("b").alias("ord")).agg(F.count("*").cast("int").alias("pieces"))
    # numbers are looked up for the texts, which are not sorted
    kept = changed.join(pieces.hint("shuffle_hash"), ["case", "ord"], "left").na.fill(0, ["pieces"])
    sizes = rows.groupBy("case").agg(F.max("total").alias("total"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("frees"))), F.lit(0)).alias("freed"))
    return {
        "cases": sizes.where("total IS NOT NULL").select("case", (F.col("total") - F.col("freed")).alias("serialized_chars")),
        "changed": kept.withColumn("source", F.substr(F.col("source"), F.lit(1), F.length("source") - PIECE * F.col("pieces"))).withColumn(
            "truncated", F.col("truncated") | (F.col("pieces") > 0)).select(changed.columns),
        "neighbors": neighbors.join(gone.where(F.col("part") == NEAR).select("case", (-F.col("a")).alias("ord")), ["case", "ord"], "left_anti").select(neighbors.columns),
        "nodes": nodes.withColumn("_s", side).join(gone.where(F.col("part") == NODE).select("case", F.col("a").alias("ord"), F.col("b").alias("_s"), (-F.col("c")).alias("rank")),
                                                   ["case", "ord", "_s", "rank"], "left_anti").select(nodes.columns),
    }
